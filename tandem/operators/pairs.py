"""Pairs: profiles, contrasts, concentration and graph."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.operators.decoders import SLOT, many
from tandem.plans.ordered import OnSpark, counted, ordered, quantiles, stored

#: What an episode is compared by (D50), the cells (D56), and the features whose drift is told (D57), as SQL over transfers and pair_features1.
TEMPLATE = ("t_ab", "t_ba", "put_lo / unit", "put_hi / unit", "s_lo", "s_hi")
CELLS = {
    "gave_lo": "t_ab > 0e0 AND exited_lo = 1", "gave_hi": "t_ba > 0e0 AND exited_hi = 1", "both_entered": "match_lo + push_lo > 0 AND match_hi + push_hi > 0", "big": "put_units_lo >= 20 AND put_units_hi >= 20", "alone": "both_stayed = 1 AND stayed = 2", "mutual": "mutual_pushes = 1",
    "squeezed_out": "outsider_exits_after_lo + outsider_exits_after_hi > 0",
}
DRIFTING = ("t_max", "t_sum", "net_gap", "put_total", "push_rate_lo", "push_rate_hi", "exit_rate_lo", "exit_rate_hi", "mean_pot", "players", "both_stayed", "risk_proxy")


def _template(columns: Sequence[str]) -> str:
    own = ", ".join(f"{c} AS x{i}" for i, c in enumerate(columns))
    rest = ", ".join(f"(sum(w * x{i}) OVER (PARTITION BY lo, hi) - w * x{i}) / nullif(sum(w) OVER (PARTITION BY lo, hi) - w, 0e0) AS m{i}" for i in range(len(columns)))
    each = lambda form: " + ".join(form.format(i=i) for i in range(len(columns)))
    return f"""
WITH w AS (SELECT lo, hi, episode, greatest(t_ab, t_ba) * greatest(t_ab, t_ba) AS w, {own} FROM {{transfers}} WHERE unit > 0e0), c AS (SELECT w.*, sum(w) OVER (PARTITION BY lo, hi) - w AS mass, {rest} FROM w)
SELECT lo, hi, episode, round(mass, 4) AS mass, CASE WHEN mass > 1e-3 THEN round(sqrt(({each("(x{i} - m{i}) * (x{i} - m{i})")}) / {len(columns)}e0), 4) END AS distance,
  CASE WHEN mass > 1e-3 THEN round(({each("x{i} * m{i}")}) / (sqrt({each("x{i} * x{i}")}) * sqrt({each("m{i} * m{i}")}) + 1e-9), 4) END AS cosine FROM c"""


def _cells(cells: Mapping[str, str]) -> str:
    marks = " UNION ALL ".join(f"SELECT '{c}' AS cell" for c in cells)
    which = " ".join(f"WHEN '{c}' THEN {cond}" for c, cond in cells.items())
    return f"""
WITH f AS (SELECT f.*, c.cell FROM {{pair_features1}} f CROSS JOIN ({marks}) c WHERE CASE c.cell {which} END),
k AS (SELECT lo, hi, episode, cell, row_number() OVER (PARTITION BY lo, hi, cell ORDER BY ts, episode) - 1 AS earlier, count(*) OVER (PARTITION BY lo, hi, cell) AS total FROM f)
SELECT lo, hi, episode, cell, earlier, total, round((earlier + 5e-1) / total, 6) AS at, greatest(5 - earlier, 0) AS places_left FROM k"""


def _drift(columns: Sequence[str]) -> str:
    rows = " UNION ALL ".join(f"SELECT win, '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM {{pair_features1}}" for c in columns)
    return f"""
WITH u AS ({rows}), d AS (SELECT feature, (avg(CASE WHEN win = 'evaluation' THEN x END) - avg(CASE WHEN win = 'development' THEN x END)) / nullif(stddev_samp(CASE WHEN win = 'development' THEN x END), 0e0) AS drift FROM u GROUP BY feature)
SELECT feature, round(drift, 6) AS drift, count(CASE WHEN abs(drift) > 25e-2 THEN 1 END) OVER () AS over_quarter, count(CASE WHEN abs(drift) > 5e-1 THEN 1 END) OVER () AS over_half FROM d"""


def exposure_replicas(seeds: Sequence[int] = (11, 12, 13), sixteenths: int = 11) -> str:
    """SQL for the pairs' totals over a part of all episodes, the same part for all pairs and another for each seed; listed episodes always stay."""
    draws = ", ".join(f"({s})" for s in seeds)
    return f"""
WITH k AS (SELECT DISTINCT episode FROM {{listed}}), d AS (SELECT seed FROM (VALUES {draws}) AS v(seed))
SELECT d.seed, s.lo, s.hi, count(*) AS n, round(sum(s.score), 5) AS total FROM {{scored}} s CROSS JOIN d LEFT JOIN k ON k.episode = s.episode
WHERE k.episode IS NOT NULL OR instr('0123456789abcdef', substr(md5(concat(CAST(s.episode AS VARCHAR(20)), '-', CAST(d.seed AS VARCHAR(20)))), 1, 1)) <= {sixteenths} GROUP BY d.seed, s.lo, s.hi"""


_TAILS = """
SELECT s.pool, s.lo, s.hi, s.episode, s.score, s.label, s.family, 1e0 - d.upto / CAST(d.c_all AS DOUBLE) + 5e-1 / d.c_all AS tail FROM {labelled_scores} s JOIN {score_counts} d ON d.score = s.score"""


def _tails(frame: Callable[[str], DataFrame], slot: int = SLOT) -> DataFrame:
    """tails on Spark: a score that more than `slot` episodes share, as 0 is, would bring them all to one task, so the counts of such scores go to where the episodes lie. They are one in `slot` of the episodes at the most."""
    rows, counts = frame("SELECT * FROM {labelled_scores}"), frame("SELECT * FROM {score_counts}")
    hot = F.broadcast(many(rows, ("score",), slot))
    met = lambda how, c: rows.join(hot, "score", how).join(c, "score")
    both = met("left_anti", counts).unionByName(met("left_semi", F.broadcast(counts.join(hot, "score", "left_semi"))))
    return both.select("pool", "lo", "hi", "episode", "score", "label", "family", F.expr("1e0 - upto / CAST(c_all AS DOUBLE) + 5e-1 / c_all AS tail"))


OPERATORS = {
    # Rate with the partner less the rate with everybody else
    "partner_specificity": """
SELECT lo, hi, round(n_lo_hi / CAST(greatest(n, 1) AS DOUBLE) - (n_lo - n_lo_hi) / CAST(greatest(5 * hands_lo - n, 1) AS DOUBLE), 8) AS lo_toward_hi, round(n_hi_lo / CAST(greatest(n, 1) AS DOUBLE) - (n_hi - n_hi_lo) / CAST(greatest(5 * hands_hi - n, 1) AS DOUBLE), 8) AS hi_toward_lo FROM {rolled}""",
    # D34
    "conditional_rate_contrast": """
SELECT lo, hi, round((exit_lo_hi + 5e-1) / (n_lo_hi + 1e0) - (exit_lo - exit_lo_hi + 5e-1) / (n_lo - n_lo_hi + 1e0), 8) AS lo_exits, round((exit_hi_lo + 5e-1) / (n_hi_lo + 1e0) - (exit_hi - exit_hi_lo + 5e-1) / (n_hi - n_hi_lo + 1e0), 8) AS hi_exits,
  round((exit_lo_hi + exit_hi_lo + 5e-1) / (n_lo_hi + n_hi_lo + 1e0), 8) AS both_exit FROM {rolled}""",
    # D35
    "binomial_z": """
WITH p AS (SELECT *, (exit_lo - exit_lo_hi + 5e-1) / (n_lo - n_lo_hi + 1e0) AS p_lo, (exit_hi - exit_hi_lo + 5e-1) / (n_hi - n_hi_lo + 1e0) AS p_hi FROM {rolled}),
z AS (SELECT lo, hi, (exit_lo_hi - n_lo_hi * p_lo) / sqrt(n_lo_hi * p_lo * (1e0 - p_lo) + 1e0) AS z_lo, (exit_hi_lo - n_hi_lo * p_hi) / sqrt(n_hi_lo * p_hi * (1e0 - p_hi) + 1e0) AS z_hi FROM p)
SELECT lo, hi, round(greatest(z_lo, z_hi), 6) AS z_max, round(least(z_lo, z_hi), 6) AS z_min FROM z""",
    # Against the pool's median
    "context_residual": """
SELECT s.lo, s.hi, s.pool, round((s.score - m.mid) / (abs(m.mid) + 1e0), 6) AS residual, round(CASE WHEN v.c_all > 1 THEN (v.upto - v.c) / CAST(v.c_all - 1 AS DOUBLE) ELSE 0e0 END, 6) AS pool_rank, v.c_all AS pool_pairs
FROM {stored_scores} s JOIN {pool_middles} m ON m.pool = s.pool JOIN {pool_values} v ON v.pool = s.pool AND v.score = s.score""",
    "pool_center": """
SELECT lo, hi, round(score - avg(score) OVER (PARTITION BY pool), 8) AS centred, round((score - avg(score) OVER (PARTITION BY pool)) / nullif(stddev_samp(score) OVER (PARTITION BY pool), 0e0), 6) AS z, round(score - 5e-1 * avg(score) OVER (PARTITION BY pool), 8) AS half_centred FROM {pair_scores}""",
    # The best other pair of either member, by each member's two best
    "best_other_edge": """
WITH m AS (SELECT lo AS member, lo, hi, score FROM {pair_scores} UNION ALL SELECT hi AS member, lo, hi, score FROM {pair_scores}),
r AS (SELECT m.*, row_number() OVER (PARTITION BY member ORDER BY score DESC, lo, hi) AS r FROM m),
t AS (SELECT member, max(CASE WHEN r = 1 THEN lo END) AS lo1, max(CASE WHEN r = 1 THEN hi END) AS hi1, max(CASE WHEN r = 1 THEN score END) AS s1, max(CASE WHEN r = 2 THEN score END) AS s2 FROM r WHERE r <= 2 GROUP BY member)
SELECT s.lo, s.hi, round(s.score, 6) AS score, round(greatest(CASE WHEN a.lo1 = s.lo AND a.hi1 = s.hi THEN a.s2 ELSE a.s1 END, CASE WHEN b.lo1 = s.lo AND b.hi1 = s.hi THEN b.s2 ELSE b.s1 END), 6) AS best_other
FROM {pair_scores} s JOIN t a ON a.member = s.lo JOIN t b ON b.member = s.hi""",
    # Demoted where a higher pair has one of the members
    "shares_higher_ranked": """
WITH r AS (SELECT lo, hi, score, r FROM {pair_order}),
m AS (SELECT member, min(r) AS best FROM (SELECT lo AS member, r FROM r UNION ALL SELECT hi AS member, r FROM r) u GROUP BY member)
SELECT r.lo, r.hi, CAST(least(a.best, b.best) < r.r AS INT) AS shared, round(CASE WHEN least(a.best, b.best) < r.r THEN score * 5e-1 ELSE score END, 8) AS demoted FROM r JOIN m a ON a.member = r.lo JOIN m b ON b.member = r.hi""",
    # D43
    "touch_positive": """
WITH p AS (SELECT lo AS member FROM {pair_labels} WHERE label = 1 UNION SELECT hi AS member FROM {pair_labels} WHERE label = 1)
SELECT lo, hi, CASE WHEN lo IN (SELECT member FROM p) OR hi IN (SELECT member FROM p) THEN 1 ELSE 0 END AS touches FROM {pair_labels}""",
    # D44
    "excess_coseating": """
SELECT r.lo, r.hi, round(r.n * CAST(t.total AS DOUBLE) / (CAST(r.hands_lo AS DOUBLE) * r.hands_hi), 8) AS ratio FROM {rolled} r CROSS JOIN (SELECT count(*) AS total FROM {episodes}) t""",
    # A bag of episode scores as one row
    "bag_reduce": """
WITH q AS (SELECT q99, q999 FROM {negative_quantiles}),
r AS (SELECT lo, hi, score, row_number() OVER (PARTITION BY lo, hi ORDER BY score DESC, episode) AS r FROM {scored})
SELECT lo, hi, count(*) AS n, round(sum(score), 5) AS total, round(avg(score), 8) AS mean, round(max(score), 6) AS top, count(CASE WHEN score > q99 THEN 1 END) AS n99, count(CASE WHEN score > q999 THEN 1 END) AS n999, round(count(CASE WHEN score > q99 THEN 1 END) / CAST(count(*) AS DOUBLE), 8) AS rate99, round(count(CASE WHEN score > q999 THEN 1 END) / CAST(count(*) AS DOUBLE), 8) AS rate999,
  round(avg(CASE WHEN r <= 3 THEN score END), 8) AS top3, round(avg(CASE WHEN r <= 5 THEN score END), 8) AS top5 FROM r CROSS JOIN q GROUP BY lo, hi""",
    # Softmax weights over a pair's episodes
    "attention_bag": """
WITH w AS (SELECT lo, hi, score, lean, exp(score - max(score) OVER (PARTITION BY lo, hi)) AS w FROM {scored}), g AS (SELECT w.*, w / sum(w) OVER (PARTITION BY lo, hi) AS g, count(*) OVER (PARTITION BY lo, hi) AS n FROM w)
SELECT lo, hi, round(sum(g * lean), 6) AS lean, round(max(g), 6) AS gate_max, round(CASE WHEN max(n) > 1 THEN -sum(g * ln(g + 1e-12)) / ln(max(n)) ELSE 0e0 END, 6) AS entropy FROM g GROUP BY lo, hi""",
    # Share of the reference, the negatives' episodes, that is above, with half of one
    "tail_probability": "SELECT lo, hi, episode, round(tail, 8) AS tail FROM {tails}",
    # Likelihood ratios of binned tail probabilities, from the other folds, over a grid of rates; which family's ratios fit; and how far the best episode is before the second
    "mixture_lr_bag": """
WITH g AS (SELECT * FROM (VALUES (5e-3), (1e-2), (2e-2), (3e-2), (5e-2), (8e-2), (12e-2), (2e-1), (3e-1), (5e-1)) AS v(rate)),
b AS (SELECT t.lo, t.hi, g.rate, sum(ln(1e0 - g.rate + g.rate * t.lr)) AS llr, sum(ln(1e0 - g.rate + g.rate * t.lr0)) AS llr0, sum(ln(1e0 - g.rate + g.rate * t.lr1)) AS llr1, sum(ln(1e0 - g.rate + g.rate * t.lr2)) AS llr2 FROM {tail_ratios} t CROSS JOIN g GROUP BY t.lo, t.hi, g.rate),
o AS (SELECT lo, hi, max(tail) AS highest, min(tail) AS lowest, max(CASE WHEN r = 2 THEN tail END) AS second FROM (SELECT lo, hi, tail, row_number() OVER (PARTITION BY lo, hi ORDER BY tail, episode) AS r FROM {tail_ratios}) t GROUP BY lo, hi),
m AS (SELECT lo, hi, max(llr) AS best, max_by(rate, round(llr, 8) - rate * 1e-9) AS best_rate, max(CASE WHEN rate = 12e-2 THEN llr END) AS at_eighth, max(CASE WHEN rate = 1e-2 THEN llr END) AS at_hundredth, max(CASE WHEN rate = 5e-2 THEN llr0 END) AS l0, max(CASE WHEN rate = 5e-2 THEN llr1 END) AS l1, max(CASE WHEN rate = 5e-2 THEN llr2 END) AS l2 FROM b GROUP BY lo, hi)
SELECT m.lo, m.hi, round(best, 6) AS best, best_rate, round(at_eighth, 6) AS at_eighth, round(at_hundredth, 6) AS at_hundredth, round(exp(l0 - greatest(l0, l1, l2)) / (exp(l0 - greatest(l0, l1, l2)) + exp(l1 - greatest(l0, l1, l2)) + exp(l2 - greatest(l0, l1, l2))), 6) AS family0,
  round(exp(l1 - greatest(l0, l1, l2)) / (exp(l0 - greatest(l0, l1, l2)) + exp(l1 - greatest(l0, l1, l2)) + exp(l2 - greatest(l0, l1, l2))), 6) AS family1, round(greatest(l0, l1, l2) - (l0 + l1 + l2 - greatest(l0, l1, l2) - least(l0, l1, l2)), 6) AS family_gap,
  round(ln(coalesce(second, lowest)) - ln(lowest), 6) AS top2_gap FROM m JOIN o ON o.lo = m.lo AND o.hi = m.hi""",
    # Distance and cosine to the weighted centre of the pair's other episodes
    "leave_one_out_template": _template(TEMPLATE),
    # Likeness of a candidate to a pair's other candidates
    "within_pair_consistency": """
WITH k AS (SELECT lo, hi, episode, lean, score FROM (SELECT s.*, row_number() OVER (PARTITION BY lo, hi ORDER BY score DESC, episode) AS r FROM {scored} s) t WHERE r <= 20 AND score > 0e0),
p AS (SELECT a.lo, a.hi, a.episode, round((a.lean * b.lean + a.score * b.score) / (sqrt(a.lean * a.lean + a.score * a.score) * sqrt(b.lean * b.lean + b.score * b.score)), 9) AS c FROM k a JOIN k b ON b.lo = a.lo AND b.hi = a.hi AND b.episode <> a.episode),
r AS (SELECT p.*, row_number() OVER (PARTITION BY lo, hi, episode ORDER BY c DESC) AS r, row_number() OVER (PARTITION BY lo, hi, episode ORDER BY c) AS from_low FROM p)
SELECT lo, hi, episode, round(avg(CASE WHEN r <= 3 THEN c END), 5) AS top3, round(max(c), 5) AS top, round(avg(CASE WHEN from_low <= 5 THEN c END), 5) AS low5, round(avg(c * c), 5) AS mean_square, count(*) AS others FROM r GROUP BY lo, hi, episode""",
    # One pushes, an outsider matches, the partner pushes; in one stage, outsider still there
    "sandwich_pattern": """
SELECT q.lo, q.hi, q.episode, count(*) AS n FROM {pair_episodes} q JOIN {ev} a ON a.episode = q.episode AND a.act = 'push' AND a.member IN (q.lo, q.hi)
JOIN {ev} o ON o.episode = q.episode AND o.stage = a.stage AND o.ordinal > a.ordinal AND o.act = 'match' AND o.member NOT IN (q.lo, q.hi)
JOIN {ev} b ON b.episode = q.episode AND b.stage = a.stage AND b.ordinal > o.ordinal AND b.act = 'push' AND b.member IN (q.lo, q.hi) AND b.member <> a.member
JOIN {participants} p ON p.episode = q.episode AND p.member = o.member AND (p.exit_ordinal IS NULL OR p.exit_ordinal > b.ordinal) GROUP BY q.lo, q.hi, q.episode""",
    # D54
    "dispersion_index": """
WITH g AS (SELECT win, lo, hi, count(*) AS n, count(CASE WHEN score > 5e-1 THEN 1 END) AS k FROM {scored} GROUP BY win, lo, hi), p AS (SELECT win, sum(k) / CAST(sum(n) AS DOUBLE) AS p FROM g GROUP BY win)
SELECT g.win, count(*) AS pairs, round(sum((k - n * p) * (k - n * p) / nullif(n * p * (1e0 - p), 0e0)) / nullif(count(*) - 1, 0), 6) AS dispersion FROM g JOIN p ON p.win = g.win GROUP BY g.win""",
    # The strength of the partner where a member leaves, less that of outsiders; for either member
    "placebo_contrast": """
WITH s AS (SELECT q.lo, q.hi, a.member AS actor, avg(CASE WHEN o.member IN (q.lo, q.hi) THEN o.strength END) - avg(CASE WHEN o.member NOT IN (q.lo, q.hi) THEN o.strength END) AS contrast, count(*) AS n
  FROM {pair_episodes} q JOIN {participants} a ON a.episode = q.episode AND a.member IN (q.lo, q.hi) AND a.exit_ordinal IS NOT NULL JOIN {participants} o ON o.episode = q.episode AND o.member <> a.member GROUP BY q.lo, q.hi, a.member)
SELECT lo, hi, max(CASE WHEN actor = lo THEN contrast END) AS lo_contrast, max(CASE WHEN actor = hi THEN contrast END) AS hi_contrast, max(contrast) AS most, coalesce(max(CASE WHEN actor = lo THEN n END), 0) AS n_lo, coalesce(max(CASE WHEN actor = hi THEN n END), 0) AS n_hi FROM s GROUP BY lo, hi""",
    # Named cells, with how many the pair had before, has in all, where this one is among them, and how many places of five are left
    "pattern_cells": _cells(CELLS),
    # Change of each feature between windows in standard deviations, and how many change by more than a quarter and a half
    "feature_drift": _drift(DRIFTING),
    # Class sizes are a table of two rows
    "balanced_weights": """
WITH r AS (SELECT s.lo, s.hi, s.episode, l.label, count(*) OVER (PARTITION BY s.lo, s.hi) AS n FROM {scored} s JOIN {pair_labels} l ON l.lo = s.lo AND l.hi = s.hi AND l.label IS NOT NULL),
c AS (SELECT label, count(*) AS n FROM r GROUP BY label), t AS (SELECT sum(n) AS n, count(*) AS classes FROM c)
SELECT /*+ BROADCAST(c), BROADCAST(t) */ r.lo, r.hi, r.episode, round(t.n / (CAST(t.classes AS DOUBLE) * c.n), 6) AS class_weight, round(1e0 / r.n, 8) AS pair_weight FROM r JOIN c ON c.label = r.label CROSS JOIN t""",
    # D59
    "exposure_replicas": exposure_replicas(),
    # D60
    "window_contrast": """
SELECT a.lo, a.hi, round(a.m - b.m, 8) AS contrast FROM (SELECT lo, hi, avg(score) AS m FROM {scored} WHERE win = 'evaluation' GROUP BY lo, hi) a LEFT JOIN (SELECT lo, hi, avg(score) AS m FROM {scored} WHERE win = 'development' GROUP BY lo, hi) b ON b.lo = a.lo AND b.hi = a.hi""",
    # Nearness in the pool's episode order to an episode listed for another pair of a member. Each episode finds the last and the next listing of a member, and where that is its own
    # pair's the last or next one of another pair, which every listing knows: one row for each episode and listing of a member, never all of one with all of the other
    "neighbor_listing_gap": """
WITH i AS (SELECT pool, episode, r AS idx FROM {pool_episodes}),
g AS (SELECT l.lo, l.hi, l.lo AS member, i.idx FROM {listed} l JOIN i ON i.pool = l.pool AND i.episode = l.episode UNION ALL SELECT l.lo, l.hi, l.hi AS member, i.idx FROM {listed} l JOIN i ON i.pool = l.pool AND i.episode = l.episode),
b AS (SELECT g.*, lag(idx) OVER (PARTITION BY member ORDER BY idx, lo, hi) AS idx_b, lag(lo) OVER (PARTITION BY member ORDER BY idx, lo, hi) AS lo_b, lag(hi) OVER (PARTITION BY member ORDER BY idx, lo, hi) AS hi_b, lead(idx) OVER (PARTITION BY member ORDER BY idx, lo, hi) AS idx_a, lead(lo) OVER (PARTITION BY member ORDER BY idx, lo, hi) AS lo_a, lead(hi) OVER (PARTITION BY member ORDER BY idx, lo, hi) AS hi_a FROM g),
k AS (SELECT member, idx, lo, hi, last_value(CASE WHEN lo <> lo_b OR hi <> hi_b THEN idx_b END) IGNORE NULLS OVER (PARTITION BY member ORDER BY idx, lo, hi) AS other_before, last_value(CASE WHEN lo <> lo_a OR hi <> hi_a THEN idx_a END) IGNORE NULLS OVER (PARTITION BY member ORDER BY idx DESC, lo DESC, hi DESC) AS other_after FROM b),
u AS (SELECT member, idx, 0 AS kind, lo, hi, CAST(NULL AS BIGINT) AS episode, other_before, other_after FROM k
  UNION ALL SELECT s.lo AS member, i.idx, 1 AS kind, s.lo, s.hi, s.episode, NULL, NULL FROM {scored} s JOIN i ON i.pool = s.pool AND i.episode = s.episode UNION ALL SELECT s.hi AS member, i.idx, 1 AS kind, s.lo, s.hi, s.episode, NULL, NULL FROM {scored} s JOIN i ON i.pool = s.pool AND i.episode = s.episode),
n AS (SELECT u.*, last_value(CASE WHEN kind = 0 THEN struct(lo, hi, idx, other_before AS other) END) IGNORE NULLS OVER (PARTITION BY member ORDER BY idx, kind, lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b,
  last_value(CASE WHEN kind = 0 THEN struct(lo, hi, idx, other_after AS other) END) IGNORE NULLS OVER (PARTITION BY member ORDER BY idx DESC, kind, lo DESC, hi DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a FROM u),
m AS (SELECT lo, hi, episode, min(least(idx - CASE WHEN b.lo = lo AND b.hi = hi THEN b.other ELSE b.idx END, CASE WHEN a.lo = lo AND a.hi = hi THEN a.other ELSE a.idx END - idx)) AS gap FROM n WHERE kind = 1 GROUP BY lo, hi, episode)
SELECT m.lo, m.hi, m.episode, gap, CAST(gap <= 10 AS INT) AS near, CAST(l.episode IS NOT NULL AS INT) AS is_listed FROM m LEFT JOIN {listed} l ON l.lo = m.lo AND l.hi = m.hi AND l.episode = m.episode WHERE gap IS NOT NULL""",
    # Weighted share of a flag among the pair's other candidates
    "loo_context_share": """
WITH w AS (SELECT lo, hi, episode, score, CASE WHEN lean > 0e0 THEN 1e0 ELSE 0e0 END AS f FROM {scored})
SELECT lo, hi, episode, CASE WHEN sum(score) OVER (PARTITION BY lo, hi) - score > 1e-3 THEN round((sum(score * f) OVER (PARTITION BY lo, hi) - score * f) / (sum(score) OVER (PARTITION BY lo, hi) - score), 5) END AS share FROM w""",
    # Degrees among each pool's best pairs, mean rank of the pairs at a hub, and the same degrees for ten shufflings of the pool's scores
    "star_structure": """
WITH c AS (SELECT s.pool, s.lo, s.hi, k.draw, row_number() OVER (PARTITION BY s.pool, k.draw ORDER BY CASE WHEN k.draw = 0 THEN -s.score END, CASE WHEN k.draw > 0 THEN md5(concat(CAST(s.lo AS VARCHAR(20)), '-', CAST(s.hi AS VARCHAR(20)), '-', CAST(k.draw AS VARCHAR(20)))) END, s.lo, s.hi) AS r, count(*) OVER (PARTITION BY s.pool, k.draw) AS n
  FROM {pair_scores} s CROSS JOIN (SELECT draw FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10)) AS v(draw)) k),
t AS (SELECT * FROM c WHERE r <= 20), d AS (SELECT pool, draw, member, count(*) AS degree FROM (SELECT pool, draw, lo AS member FROM t UNION ALL SELECT pool, draw, hi AS member FROM t) u GROUP BY pool, draw, member),
h AS (SELECT pool, draw, count(*) AS members, count(CASE WHEN degree >= 2 THEN 1 END) AS hubs, max(degree) AS max_degree FROM d GROUP BY pool, draw),
p AS (SELECT c.pool, avg((c.r - 1) / CAST(greatest(c.n - 1, 1) AS DOUBLE)) AS hub_rank, count(*) AS hub_pairs FROM c WHERE c.draw = 0 AND EXISTS (SELECT 1 FROM d WHERE d.pool = c.pool AND d.draw = 0 AND d.degree >= 2 AND (d.member = c.lo OR d.member = c.hi)) GROUP BY c.pool)
SELECT h.pool, max(CASE WHEN draw = 0 THEN members END) AS members, coalesce(max(CASE WHEN draw = 0 THEN hubs END), 0) AS hubs, max(CASE WHEN draw = 0 THEN max_degree END) AS max_degree, round(avg(CASE WHEN draw > 0 THEN hubs END), 6) AS hubs_by_chance, round(avg(CASE WHEN draw > 0 THEN max_degree END), 6) AS degree_by_chance,
  round(max(p.hub_rank), 6) AS hub_rank, coalesce(max(p.hub_pairs), 0) AS hub_pairs FROM h LEFT JOIN p ON p.pool = h.pool GROUP BY h.pool""",
}
RELATIONS = {
    # shares of the negatives' episodes above a score; counted in bins of the score, so that no task sees all
    "tails": OnSpark(_TAILS, lambda frame: _tails(frame)),
    "labelled_scores": stored("SELECT s.pool, s.lo, s.hi, s.episode, coalesce(s.score, 0e0) AS score, l.label, l.family FROM {scored} s JOIN {pair_labels} l ON l.lo = s.lo AND l.hi = s.hi"),
    # negatives' episodes up to each distinct score, with one row for a score whatever number of episodes has it
    "score_counts": counted("SELECT * FROM {labelled_scores}", (), "score", "CASE WHEN label = 0 THEN 1 ELSE 0 END"),
    "negative_quantiles": quantiles("SELECT s.score FROM {scored} s JOIN {pair_labels} l ON l.lo = s.lo AND l.hi = s.hi AND l.label = 0", (), "score", {"q99": 0.99, "q999": 0.999}),
    # pairs that are read more than once, so that their sums are the same each time
    "stored_scores": stored("SELECT * FROM {pair_scores}"),
    "pool_values": counted("SELECT * FROM {stored_scores}", ("pool",), "score"),
    "pool_middles": quantiles("SELECT pool, score FROM {stored_scores}", ("pool",), "score", {"mid": 0.5}),
    # the pairs of a pool from the highest score on, with the positives so far and those that aren't of family 2
    "pair_order": ordered("SELECT * FROM {pair_scores}", ("pool",), ("score desc", "lo", "hi"), {"hits": "CASE WHEN label = 1 THEN 1 ELSE 0 END", "others": "CASE WHEN family = 2 THEN 0 ELSE 1 END"}),
    # the episodes of a pool in time
    "pool_episodes": ordered("SELECT pool, episode, min(ts) AS ts FROM {scored} GROUP BY pool, episode", ("pool",), ("ts", "episode")),
    # thirty bins of the tail's logarithm and their ratios of positives to negatives, counted without the pair's own fold; for all positives and by family
    "tail_ratios": """
WITH t AS (SELECT t.*, CAST(least(floor(-ln(least(tail, 1e0)) / ln(1e1) * 8e0), 29e0) AS INT) AS bin, ascii(substr(md5(CAST(pool AS VARCHAR(20))), 1, 1)) % 3 AS fold FROM {tails} t),
k AS (SELECT fold, bin, count(CASE WHEN label = 0 THEN 1 END) AS neg, count(CASE WHEN label = 1 THEN 1 END) AS pos, count(CASE WHEN label = 1 AND family = 0 THEN 1 END) AS p0, count(CASE WHEN label = 1 AND family = 1 THEN 1 END) AS p1, count(CASE WHEN label = 1 AND family = 2 THEN 1 END) AS p2 FROM t GROUP BY fold, bin),
f AS (SELECT DISTINCT fold FROM k), b AS (SELECT DISTINCT bin FROM k),
o AS (SELECT f.fold, b.bin, coalesce(sum(k.neg), 0) + 5e-1 AS neg, coalesce(sum(k.pos), 0) + 5e-1 AS pos, coalesce(sum(k.p0), 0) + 5e-1 AS p0, coalesce(sum(k.p1), 0) + 5e-1 AS p1, coalesce(sum(k.p2), 0) + 5e-1 AS p2 FROM f CROSS JOIN b LEFT JOIN k ON k.bin = b.bin AND k.fold <> f.fold GROUP BY f.fold, b.bin),
z AS (SELECT fold, sum(neg) AS neg, sum(pos) AS pos, sum(p0) AS p0, sum(p1) AS p1, sum(p2) AS p2 FROM o GROUP BY fold)
SELECT /*+ BROADCAST(o), BROADCAST(z) */ t.lo, t.hi, t.episode, t.tail, (o.pos / z.pos) / (o.neg / z.neg) AS lr, (o.p0 / z.p0) / (o.neg / z.neg) AS lr0, (o.p1 / z.p1) / (o.neg / z.neg) AS lr1, (o.p2 / z.p2) / (o.neg / z.neg) AS lr2 FROM t JOIN o ON o.fold = t.fold AND o.bin = t.bin JOIN z ON z.fold = t.fold""",
    "rolled": """
SELECT s.lo, s.hi, s.n, coalesce(f.n, 0) AS n_lo_hi, coalesce(g.n, 0) AS n_hi_lo, coalesce(f.n_exit, 0) AS exit_lo_hi, coalesce(g.n_exit, 0) AS exit_hi_lo, coalesce(a.n, 0) AS n_lo, coalesce(b.n, 0) AS n_hi, coalesce(a.n_exit, 0) AS exit_lo, coalesce(b.n_exit, 0) AS exit_hi, x.n AS hands_lo, y.n AS hands_hi
FROM {pair_scores} s LEFT JOIN {facing_pairs} f ON f.actor = s.lo AND f.target = s.hi LEFT JOIN {facing_pairs} g ON g.actor = s.hi AND g.target = s.lo LEFT JOIN {facing_members} a ON a.actor = s.lo LEFT JOIN {facing_members} b ON b.actor = s.hi
JOIN (SELECT member, count(*) AS n FROM {participants} GROUP BY member) x ON x.member = s.lo JOIN (SELECT member, count(*) AS n FROM {participants} GROUP BY member) y ON y.member = s.hi""",
}
#: rolled on Spark, from sums of faced and exit_to by actor and partner, and by actor alone.
ROLLED_FROM_PARTNERS = """
WITH h AS (SELECT m.member, m.n AS hands, t.faced, t.exit_to FROM (SELECT member, count(*) AS n FROM {participants} GROUP BY member) m LEFT JOIN {partners} t ON t.actor = m.member AND t.other IS NULL),
f AS (SELECT least(actor, other) AS lo, greatest(actor, other) AS hi, """ + ", ".join(f"max(CASE WHEN actor {o} other THEN {c} END) AS {c}_{n}" for o, n in (("<", "lo_hi"), (">", "hi_lo")) for c in ("faced", "exit_to")) + """ FROM {partners} WHERE other IS NOT NULL GROUP BY least(actor, other), greatest(actor, other))
SELECT s.lo, s.hi, s.n, """ + ", ".join(f"CAST(coalesce({k}, 0e0) AS BIGINT) AS {n}" for k, n in (("f.faced_lo_hi", "n_lo_hi"), ("f.faced_hi_lo", "n_hi_lo"), ("f.exit_to_lo_hi", "exit_lo_hi"), ("f.exit_to_hi_lo", "exit_hi_lo"), ("x.faced", "n_lo"), ("y.faced", "n_hi"), ("x.exit_to", "exit_lo"), ("y.exit_to", "exit_hi"))) + """, x.hands AS hands_lo, y.hands AS hands_hi
FROM {stored_scores} s LEFT JOIN f ON f.lo = s.lo AND f.hi = s.hi JOIN h x ON x.member = s.lo JOIN h y ON y.member = s.hi"""
_RATES = ("5e-3", "1e-2", "2e-2", "3e-2", "5e-2", "8e-2", "12e-2", "2e-1", "3e-1", "5e-1")


def _mixture() -> str:
    """mixture_lr_bag on Spark: a pair's episodes are sent once, as they are, and the grid's sums are columns beside one another."""
    total = lambda rate, lr: f"sum(ln(1e0 - {rate} + {rate} * {lr}))"
    sums = ", ".join(f"{total(r, 'lr')} AS b{i}" for i, r in enumerate(_RATES))
    best = ", ".join(f"struct(round(b{i}, 8) - {r} * 1e-9 AS s, {r} AS rate)" for i, r in enumerate(_RATES))
    highest = "greatest(l0, l1, l2)"
    share = lambda i: f"round(exp(l{i} - {highest}) / (exp(l0 - {highest}) + exp(l1 - {highest}) + exp(l2 - {highest})), 6)"
    return f"""
WITH r AS (SELECT t.*, row_number() OVER (PARTITION BY lo, hi ORDER BY tail, episode) AS r FROM {{tail_ratios}} t),
m AS (SELECT lo, hi, {sums}, {", ".join(f"{total('5e-2', f'lr{k}')} AS l{k}" for k in range(3))}, min(tail) AS lowest, max(CASE WHEN r = 2 THEN tail END) AS second FROM r GROUP BY lo, hi)
SELECT lo, hi, round(greatest({", ".join(f"b{i}" for i in range(len(_RATES)))}), 6) AS best, CAST(array_max(array({best})).rate AS DOUBLE) AS best_rate, round(b{_RATES.index("12e-2")}, 6) AS at_eighth, round(b{_RATES.index("1e-2")}, 6) AS at_hundredth, {share(0)} AS family0, {share(1)} AS family1,
  round({highest} - (l0 + l1 + l2 - {highest} - least(l0, l1, l2)), 6) AS family_gap, round(ln(coalesce(second, lowest)) - ln(lowest), 6) AS top2_gap FROM m"""


MIXTURE_ON_SPARK = _mixture()


def _mixture_lr_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tandem import catalog

    return catalog.relations().frame(spark, MIXTURE_ON_SPARK, catalog.Tables(spark, sf_dir))


QUERIES = {"mixture_lr_bag": _mixture_lr_bag}
#: The same over pair_scores that are made once, for what reads them more than once.
RELATIONS["stored_rolled"] = stored(RELATIONS["rolled"].replace("{pair_scores}", "{stored_scores}"))
ORACLES = {
    # every episode of a member against every listing of the member
    "neighbor_listing_gap": """
WITH i AS (SELECT pool, episode, r AS idx FROM {pool_episodes}),
g AS (SELECT l.lo, l.hi, l.lo AS member, i.idx FROM {listed} l JOIN i ON i.pool = l.pool AND i.episode = l.episode UNION ALL SELECT l.lo, l.hi, l.hi AS member, i.idx FROM {listed} l JOIN i ON i.pool = l.pool AND i.episode = l.episode),
s AS (SELECT s.lo, s.hi, s.episode, i.idx, s.lo AS member FROM {scored} s JOIN i ON i.pool = s.pool AND i.episode = s.episode UNION ALL SELECT s.lo, s.hi, s.episode, i.idx, s.hi AS member FROM {scored} s JOIN i ON i.pool = s.pool AND i.episode = s.episode),
m AS (SELECT s.lo, s.hi, s.episode, min(abs(s.idx - g.idx)) AS gap FROM s JOIN g ON g.member = s.member AND NOT (g.lo = s.lo AND g.hi = s.hi) GROUP BY s.lo, s.hi, s.episode)
SELECT m.lo, m.hi, m.episode, gap, CAST(gap <= 10 AS INT) AS near, CAST(l.episode IS NOT NULL AS INT) AS is_listed FROM m LEFT JOIN {listed} l ON l.lo = m.lo AND l.hi = m.hi AND l.episode = m.episode""",
}
