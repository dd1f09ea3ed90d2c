"""Sorts, limits, top-k and reshaping."""

_TOP = "SELECT lo, hi, episode, score, ts, row_number() OVER (PARTITION BY lo, hi ORDER BY score DESC, ts, episode) AS r FROM {scored}"

_FIVE = range(1, 6)

OPERATORS = {
    # five episodes as columns; pairs without one keep a row
    "top_k_per_pair": "SELECT p.lo, p.hi, " + ", ".join(f"max(CASE WHEN t.r = {k} THEN t.episode END) AS ep{k}" for k in range(1, 6)) + f" FROM {{pair_labels}} p LEFT JOIN ({_TOP}) t ON t.lo = p.lo AND t.hi = p.hi AND t.r <= 5 AND t.score > 0e0 GROUP BY p.lo, p.hi",
    # the first pairs of a pool, with all that tie with the last of them
    "budget_gate": "WITH g AS (SELECT pool, round(score, 2) AS value, min(r) AS r FROM {pair_order} GROUP BY pool, round(score, 2) HAVING min(r) <= 30) SELECT o.pool, o.lo, o.hi, g.r FROM {pair_order} o JOIN g ON g.pool = o.pool AND g.value = round(o.score, 2)",
    # twenty by one score, of which again by another
    "candidate_pool": f"SELECT lo, hi, episode, CAST(k AS BIGINT) AS k FROM (SELECT lo, hi, episode, row_number() OVER (PARTITION BY lo, hi ORDER BY score / (1e0 + r) DESC, ts, episode) AS k FROM ({_TOP}) t WHERE r <= 20) u WHERE k <= 20",
    # F4
    "rank_to_unit_score": "SELECT pool, lo, hi, round((n_all - r + 1) / CAST(n_all AS DOUBLE), 8) AS unit_score FROM {pair_order}",
    # routed pairs placed after the tenth of the others, unless they stand above already
    "insert_block": """
SELECT pool, lo, hi, CASE WHEN others < 10 OR (family <> 2 AND others = 10) THEN r WHEN family = 2 THEN 10 + r - others ELSE others + n_all - others_all END AS place FROM {pair_order}""",
    # a second score orders the first block only
    "cascade": """
SELECT pool, lo, hi, CAST(row_number() OVER (PARTITION BY pool ORDER BY -top, lo, hi) AS BIGINT) AS place FROM {pair_order} WHERE r <= 20 UNION ALL SELECT pool, lo, hi, r AS place FROM {pair_order} WHERE r > 20""",
    # lists of routed pairs are replaced, others stay; risk and family are carried over, and rows that changed are told
    "patch_rows": f"""
WITH b AS (SELECT p.lo, p.hi, p.risk, p.family, p.routed, {", ".join(f"max(CASE WHEN t.r = {k} THEN t.episode END) AS ep{k}" for k in _FIVE)} FROM (SELECT lo, hi, round(score / (score + 1e0), 8) AS risk, family, CASE WHEN family <> 2 AND score > 1e-1 THEN 1 ELSE 0 END AS routed FROM {{pair_scores}}) p LEFT JOIN ({_TOP}) t ON t.lo = p.lo AND t.hi = p.hi AND t.r <= 5 GROUP BY p.lo, p.hi, p.risk, p.family, p.routed),
n AS (SELECT lo, hi, {", ".join(f"max(CASE WHEN evidence_rank = {k} THEN episode END) AS ep{k}" for k in _FIVE)} FROM {{listed}} GROUP BY lo, hi),
x AS (SELECT b.lo, b.hi, b.risk, b.family, {", ".join(f"b.ep{k} AS old{k}, CASE WHEN n.lo IS NULL OR b.routed = 0 THEN b.ep{k} ELSE n.ep{k} END AS ep{k}" for k in _FIVE)} FROM b LEFT JOIN n ON n.lo = b.lo AND n.hi = b.hi)
SELECT lo, hi, risk, family, {", ".join(f"ep{k}" for k in _FIVE)}, CAST({" OR ".join(f"coalesce(ep{k}, -1) <> coalesce(old{k}, -1)" for k in _FIVE)} AS INT) AS changed FROM x""",
    # F8: columns to rows, without the empty ones
    "unpivot_evidence": " UNION ".join(f"SELECT lo, hi, {k} AS slot, episode FROM ({_TOP}) t WHERE r = {k} AND score > 0e0" for k in _FIVE),
    # windows as columns, and true families against predicted ones
    "pivot_counts": f"""
WITH s AS (SELECT s.pool, s.win, s.episode, l.family, CASE WHEN l.label = 1 THEN 1 ELSE 0 END AS y, CASE WHEN s.lean > 0e0 THEN 0 WHEN s.lean < 0e0 THEN 1 ELSE 2 END AS predicted FROM {{scored}} s JOIN {{pair_labels}} l ON l.lo = s.lo AND l.hi = s.hi)
SELECT pool, count(CASE WHEN win = 'development' THEN 1 END) AS development, count(CASE WHEN win = 'evaluation' THEN 1 END) AS evaluation, min(episode) AS first_episode, max(episode) AS last_episode, {", ".join(f"count(CASE WHEN y = 1 AND family = {f} AND predicted = {p} THEN 1 END) AS family{f}_as{p}" for f in range(3) for p in range(3))} FROM s GROUP BY pool""",
}

#: Windows over whole pools, for the engine that checks.
ORACLES = {
    "budget_gate": "SELECT pool, lo, hi, r FROM (SELECT pool, lo, hi, CAST(rank() OVER (PARTITION BY pool ORDER BY round(score, 2) DESC) AS BIGINT) AS r FROM {pair_scores}) t WHERE r <= 30",
    "insert_block": """
WITH r AS (SELECT pool, lo, hi, CASE WHEN family = 2 THEN 1 ELSE 0 END AS routed, row_number() OVER (PARTITION BY pool ORDER BY score DESC, lo, hi) AS r FROM {pair_scores}),
c AS (SELECT r.*, sum(1 - routed) OVER (PARTITION BY pool ORDER BY r) AS others FROM r)
SELECT pool, lo, hi, CAST(row_number() OVER (PARTITION BY pool ORDER BY CASE WHEN routed = 0 OR others < 10 THEN others ELSE 10 END, CASE WHEN routed = 1 AND others >= 10 THEN 1 ELSE 0 END, r) AS BIGINT) AS place FROM c""",
    "cascade": """
WITH r AS (SELECT pool, lo, hi, score, top, row_number() OVER (PARTITION BY pool ORDER BY score DESC, lo, hi) AS r FROM {pair_scores})
SELECT pool, lo, hi, CAST(row_number() OVER (PARTITION BY pool ORDER BY CASE WHEN r <= 20 THEN 0 ELSE 1 END, CASE WHEN r <= 20 THEN -top ELSE r END, lo, hi) AS BIGINT) AS place FROM r""",
}
