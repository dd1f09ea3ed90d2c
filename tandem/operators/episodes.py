"""Aggregations for each episode and member."""

from tandem.plans.ordered import quantiles, stored

OPERATORS = {
    "episode_member_counts": """
SELECT episode, member, count(*) AS n, count(CASE WHEN act = 'exit' THEN 1 END) AS n_exit, count(CASE WHEN act = 'match' THEN 1 END) AS n_match, count(CASE WHEN act = 'hold' THEN 1 END) AS n_hold,
  count(CASE WHEN act = 'push' THEN 1 END) AS n_push, round(coalesce(sum(CASE WHEN act = 'push' THEN amount END), 0e0), 3) AS push_amount, round(sum(amount), 3) AS amount,
  round(avg(to_call), 4) AS mean_to_call, min(ordinal) AS first_ordinal, max(ordinal) AS last_ordinal
FROM {ev} GROUP BY episode, member""",
    "background_rates": "SELECT member, win, n, round(push_rate, 6) AS push_rate, round(exit_rate, 6) AS exit_rate, round(match_rate, 6) AS match_rate FROM {background}",
    "first_events": "SELECT * FROM {firsts}",
    "response_counts": """
SELECT f.lo, f.hi, f.episode, count(CASE WHEN v.member = f.hi AND v.ordinal > f.push_lo THEN 1 END) AS hi_after_lo_push, count(CASE WHEN v.member = f.lo AND v.ordinal > f.push_hi THEN 1 END) AS lo_after_hi_push,
  count(CASE WHEN v.member <> f.lo AND v.member <> f.hi AND v.act = 'exit' AND v.ordinal > least(f.push_lo, f.push_hi) THEN 1 END) AS outsider_exits
FROM {firsts} f JOIN {ev} v ON v.episode = f.episode GROUP BY f.lo, f.hi, f.episode""",
    "stage_push_counts": """
SELECT q.lo, q.hi, q.episode, count(CASE WHEN v.member = q.lo AND stage = 0 THEN 1 END) AS lo_0, count(CASE WHEN v.member = q.lo AND stage = 1 THEN 1 END) AS lo_1, count(CASE WHEN v.member = q.lo AND stage = 2 THEN 1 END) AS lo_2,
  count(CASE WHEN v.member = q.lo AND stage = 3 THEN 1 END) AS lo_3, count(CASE WHEN v.member = q.hi AND stage = 0 THEN 1 END) AS hi_0, count(CASE WHEN v.member = q.hi AND stage = 1 THEN 1 END) AS hi_1,
  count(CASE WHEN v.member = q.hi AND stage = 2 THEN 1 END) AS hi_2, count(CASE WHEN v.member = q.hi AND stage = 3 THEN 1 END) AS hi_3
FROM {pair_episodes} q LEFT JOIN {ev} v ON v.episode = q.episode AND v.act = 'push' AND v.member IN (q.lo, q.hi) GROUP BY q.lo, q.hi, q.episode""",
    "style_profile": """
SELECT v.member, e.win, round(count(CASE WHEN act = 'push' THEN 1 END) / CAST(greatest(count(*), 1) AS DOUBLE), 6) AS push_rate, round(count(CASE WHEN act = 'exit' AND to_call > 0e0 THEN 1 END) / CAST(greatest(count(CASE WHEN to_call > 0e0 THEN 1 END), 1) AS DOUBLE), 6) AS exit_facing,
  round(count(CASE WHEN act = 'match' AND to_call > 0e0 THEN 1 END) / CAST(greatest(count(CASE WHEN to_call > 0e0 THEN 1 END), 1) AS DOUBLE), 6) AS match_facing,
  round(count(CASE WHEN stage = 0 AND act IN ('match', 'push') THEN 1 END) / CAST(greatest(count(CASE WHEN stage = 0 THEN 1 END), 1) AS DOUBLE), 6) AS entry_rate
FROM {ev} v JOIN {episodes} e ON e.episode = v.episode GROUP BY v.member, e.win""",
    "context_action_shares": """
SELECT v.member, e.win, CAST(v.stage >= 2 AS INT) AS late, CAST(v.to_call > 0e0 AS INT) AS facing, round((count(CASE WHEN act = 'exit' THEN 1 END) + 1) / CAST(count(*) + 4 AS DOUBLE), 6) AS q_exit,
  round((count(CASE WHEN act = 'hold' THEN 1 END) + 1) / CAST(count(*) + 4 AS DOUBLE), 6) AS q_hold, round((count(CASE WHEN act = 'match' THEN 1 END) + 1) / CAST(count(*) + 4 AS DOUBLE), 6) AS q_match, round((count(CASE WHEN act = 'push' THEN 1 END) + 1) / CAST(count(*) + 4 AS DOUBLE), 6) AS q_push
FROM {ev} v JOIN {episodes} e ON e.episode = v.episode GROUP BY v.member, e.win, CAST(v.stage >= 2 AS INT), CAST(v.to_call > 0e0 AS INT)""",
    # Rates smoothed from all events to a stage, and from there to stage, place in the order of first decisions, and whether something is to be called; pool 0 is held out
    "shrunken_rate": """
WITH b AS (SELECT v.stage, least(v.place, 3) AS place, CAST(v.to_call > 0e0 AS INT) AS facing, v.pool, CASE WHEN v.act = 'push' THEN 1 ELSE 0 END AS y FROM (SELECT s.*, CAST(min(members_seen) OVER (PARTITION BY episode, s.member) - 1 AS INT) AS place, m.pool FROM {steps} s JOIN {members} m ON m.member = s.member) v WHERE v.pool <> 0),
g AS (SELECT avg(y) AS p FROM b), s AS (SELECT stage, sum(y) AS k, count(*) AS n FROM b GROUP BY stage), f AS (SELECT stage, place, facing, sum(y) AS k, count(*) AS n FROM b GROUP BY stage, place, facing),
r AS (SELECT s.stage, (s.k + 2e1 * g.p) / (s.n + 2e1) AS p FROM s CROSS JOIN g)
SELECT f.stage, f.place, f.facing, f.n, round(least(greatest((f.k + 2e1 * r.p) / (f.n + 2e1), 1e-5), 1e0 - 1e-5), 6) AS rate FROM f JOIN r ON r.stage = f.stage""",
    # Policy of a member in a cell, with the decile of strength, from the other half of the episodes, blended with the stage's shares; and its log loss
    "member_cell_policy": """
WITH c AS (SELECT member, stage, CAST(to_call > 0e0 AS INT) AS facing, CAST(floor(strength * 99e-1) AS INT) AS decile, episode % 2 AS half, count(CASE WHEN act = 'push' THEN 1 END) AS k, count(*) AS n FROM {ev} GROUP BY member, stage, CAST(to_call > 0e0 AS INT), CAST(floor(strength * 99e-1) AS INT), episode % 2),
o AS (SELECT member, stage, facing, decile, 1 - half AS half, k AS other_k, n AS other_n FROM c),
q AS (SELECT c.*, (coalesce(o.other_k, 0) + 5e0 * s.share) / (coalesce(o.other_n, 0) + 5e0) AS q_push FROM c LEFT JOIN o ON o.member = c.member AND o.stage = c.stage AND o.facing = c.facing AND o.decile = c.decile AND o.half = c.half
  JOIN {class_shares} s ON s.stage = c.stage AND s.facing = c.facing AND s.act = 'push')
SELECT member, stage, facing, decile, half, round(q_push, 6) AS q_push, n, round(-(k * ln(q_push) + (n - k) * ln(1e0 - q_push)) / n, 6) AS log_loss FROM q""",
    # How rare the size of a push is for its stage, number left, size of the pot and odds; six sizes, half a count added to each
    "size_histogram_surprisal": """
WITH s AS (SELECT v.episode, v.member, v.stage, least(v.active, 5) AS active, CAST(least(floor(ln(1e0 + v.pot / e.unit) * 2e0), 5e0) AS INT) AS scale, CAST(floor(v.to_call / (v.to_call + v.pot + 1e0) * 39e-1) AS INT) AS odds, v.amount / greatest(v.pot, 1e0) AS ratio
  FROM {steps} v JOIN {episodes} e ON e.episode = v.episode AND e.unit > 0e0 WHERE v.act = 'push'),
b AS (SELECT s.*, CASE WHEN ratio < 33e-2 THEN 0 WHEN ratio < 6e-1 THEN 1 WHEN ratio < 9e-1 THEN 2 WHEN ratio < 12e-1 THEN 3 WHEN ratio < 2e0 THEN 4 ELSE 5 END AS bin FROM s),
h AS (SELECT stage, active, scale, odds, bin, count(*) + 5e-1 AS c FROM b GROUP BY stage, active, scale, odds, bin), t AS (SELECT stage, active, scale, odds, sum(c) + 5e-1 * (6 - count(*)) AS total FROM h GROUP BY stage, active, scale, odds),
x AS (SELECT b.episode, b.member, b.bin, -ln(h.c / t.total) AS bits FROM b JOIN h ON h.stage = b.stage AND h.active = b.active AND h.scale = b.scale AND h.odds = b.odds AND h.bin = b.bin JOIN t ON t.stage = b.stage AND t.active = b.active AND t.scale = b.scale AND t.odds = b.odds)
SELECT q.lo, q.hi, q.episode, round(max(CASE WHEN x.member = q.lo THEN bits END), 6) AS max_lo, round(max(CASE WHEN x.member = q.hi THEN bits END), 6) AS max_hi, round(sum(CASE WHEN x.member = q.lo THEN bits END), 6) AS sum_lo, round(sum(CASE WHEN x.member = q.hi THEN bits END), 6) AS sum_hi, count(CASE WHEN x.member = q.lo THEN 1 END) AS n_lo, count(CASE WHEN x.member = q.hi THEN 1 END) AS n_hi,
  round(max(CASE WHEN x.bin >= 4 THEN bits END), 6) AS overbet_max FROM {pair_episodes} q JOIN x ON x.episode = q.episode AND x.member IN (q.lo, q.hi) GROUP BY q.lo, q.hi, q.episode""",
    "first_decision": "SELECT * FROM {first_decisions}",
    # Counts by enumerations, and percentiles of amounts, contributions and pots
    "distribution_report": """
SELECT n.what, n.value, n.n, round(q.p01, 4) AS p01, round(q.p50, 4) AS p50, round(q.p99, 4) AS p99 FROM (SELECT what, value, count(*) AS n FROM {reported} GROUP BY what, value) n JOIN {reported_quantiles} q ON q.what = n.what AND q.value = n.value""",
    # Sizes of pools, possible pairs, shares that are labelled and evaluated, and the mix of labels
    "population_summary": """
SELECT m.pool, m.n AS members, CAST(m.n * (m.n - 1) / 2 AS BIGINT) AS possible_pairs, coalesce(l.pairs, 0) AS seen_pairs, coalesce(l.labelled, 0) AS labelled, coalesce(l.positives, 0) AS positives, coalesce(l.unlabelled, 0) AS unlabelled, coalesce(w.pairs, 0) AS evaluated,
  round(coalesce(l.labelled, 0) / nullif(m.n * (m.n - 1) / 2e0, 0e0), 6) AS labelled_share, round(coalesce(w.pairs, 0) / nullif(m.n * (m.n - 1) / 2e0, 0e0), 6) AS evaluated_share, coalesce(l.family0, 0) AS family0, coalesce(l.family1, 0) AS family1, coalesce(l.family2, 0) AS family2
FROM (SELECT pool, count(*) AS n FROM {members} GROUP BY pool) m LEFT JOIN (SELECT pool, count(*) AS pairs, count(label) AS labelled, count(CASE WHEN label = 1 THEN 1 END) AS positives, count(CASE WHEN label IS NULL THEN 1 END) AS unlabelled, count(CASE WHEN label = 1 AND family = 0 THEN 1 END) AS family0,
  count(CASE WHEN label = 1 AND family = 1 THEN 1 END) AS family1, count(CASE WHEN label = 1 AND family = 2 THEN 1 END) AS family2 FROM {pair_labels} GROUP BY pool) l ON l.pool = m.pool
LEFT JOIN (SELECT pool, count(*) AS pairs FROM (SELECT DISTINCT pool, lo, hi FROM {scored} WHERE win = 'evaluation') t GROUP BY pool) w ON w.pool = m.pool""",
}

RELATIONS = {
    "reported": stored("""
SELECT 'act' AS what, act AS value, amount AS x FROM {ev} UNION ALL SELECT 'action' AS what, action AS value, amount AS x FROM {ev} UNION ALL SELECT 'stage' AS what, CAST(stage AS VARCHAR(20)) AS value, amount AS x FROM {ev}
UNION ALL SELECT 'contribution' AS what, win AS value, contribution AS x FROM {participants} p JOIN {episodes} e ON e.episode = p.episode
UNION ALL SELECT 'pot' AS what, win AS value, pot AS x FROM (SELECT episode, sum(amount) AS pot FROM {ev} GROUP BY episode) t JOIN {episodes} e ON e.episode = t.episode"""),
    "reported_quantiles": quantiles("SELECT * FROM {reported}", ("what", "value"), "x", {"p01": 0.01, "p50": 0.5, "p99": 0.99}),
    "member_counts": "SELECT episode, member, count(*) AS n, count(CASE WHEN act = 'exit' THEN 1 END) AS n_exit, count(CASE WHEN act = 'push' THEN 1 END) AS n_push FROM {ev} GROUP BY episode, member",
    "firsts": """
SELECT q.lo, q.hi, q.episode, min(CASE WHEN v.member = q.lo AND act = 'push' THEN ordinal END) AS push_lo, min(CASE WHEN v.member = q.hi AND act = 'push' THEN ordinal END) AS push_hi,
  min(CASE WHEN v.member = q.lo AND act = 'exit' THEN ordinal END) AS exit_lo, min(CASE WHEN v.member = q.hi AND act = 'exit' THEN ordinal END) AS exit_hi,
  min(CASE WHEN v.member = q.lo AND act = 'match' THEN ordinal END) AS match_lo, min(CASE WHEN v.member = q.hi AND act = 'match' THEN ordinal END) AS match_hi
FROM {pair_episodes} q JOIN {ev} v ON v.episode = q.episode AND v.member IN (q.lo, q.hi) GROUP BY q.lo, q.hi, q.episode""",
    "first_decisions": "SELECT episode, member, min(ordinal) AS ordinal, min_by(act, ordinal) AS act, min_by(strength, ordinal) AS strength, min_by(to_call, ordinal) AS to_call FROM {ev} WHERE stage = 0 GROUP BY episode, member",
}
