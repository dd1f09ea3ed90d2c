"""Windows and sequences over a pair's or an episode's order."""

from pyspark.sql import functions as F

from tandem.operators.features import _ranks
from tandem.plans.ordered import counted, ordered, quantiles, stored

_P = "PARTITION BY lo, hi"
_T = "PARTITION BY lo, hi ORDER BY ts, episode"

OPERATORS = {
    "next_event": "SELECT episode, ordinal, member, lead(member) OVER (PARTITION BY episode ORDER BY ordinal) AS next_member, lead(act) OVER (PARTITION BY episode ORDER BY ordinal) AS next_act, lead(stage) OVER (PARTITION BY episode ORDER BY ordinal) AS next_stage FROM {ev}",
    # Five percent ranks, ties in the order of episodes
    "percent_rank_by": "SELECT lo, hi, episode, " + ", ".join(_ranks()) + " FROM {pair_features1}",
    "frame_stats": f"""
SELECT lo, hi, episode, round(coalesce(avg(score) OVER ({_T} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), score), 6) AS before5, round(coalesce(avg(score) OVER ({_T} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), score), 6) AS after5,
  round(avg(score) OVER ({_T} ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING), 6) AS near10, round(avg(score) OVER ({_T} ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING), 6) AS near25, round(max(score) OVER ({_T} ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING), 6) AS max10 FROM {{scored}}""",
    "cumulative_before": f"""
SELECT lo, hi, episode, round(sum(score) OVER ({_T} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - score, 5) AS before, count(CASE WHEN score > 5e-1 THEN 1 END) OVER ({_T} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - CASE WHEN score > 5e-1 THEN 1 ELSE 0 END AS high_before,
  count(*) OVER ({_P}) - row_number() OVER ({_T}) AS after FROM {{scored}}""",
    "rank_within": f"""
SELECT lo, hi, episode, rank() OVER ({_P} ORDER BY score) + (count(*) OVER (PARTITION BY lo, hi, score) - 1) / 2e0 AS average_rank, CAST(row_number() OVER ({_P} ORDER BY score, episode) AS BIGINT) AS first_rank,
  round((rank() OVER ({_P} ORDER BY score) + (count(*) OVER (PARTITION BY lo, hi, score) - 1) / 2e0) / count(*) OVER ({_P}), 6) AS pct_rank FROM {{scored}}""",
    "within_z": f"SELECT lo, hi, episode, round((score - avg(score) OVER ({_P})) / sqrt(var_pop(score) OVER ({_P}) + 1e-6), 6) AS z FROM {{scored}}",
    "relative_clock": f"SELECT lo, hi, episode, CAST(row_number() OVER ({_T}) - 1 AS BIGINT) AS k, count(*) OVER ({_P}) AS n, round((row_number() OVER ({_T}) - 5e-1) / count(*) OVER ({_P}), 8) AS at, round(1e0 / count(*) OVER ({_P}), 8) AS step FROM {{scored}}",
    # Strictly earlier values of the same member
    "running_state": """
SELECT event_id, user_id, round(coalesce(sum(value - 1e1) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0e0), 6) AS last10, lag(value - 1e1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_net,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS seen FROM {events}""",
    "aggression_before": "SELECT episode, ordinal, count(CASE WHEN act = 'push' THEN 1 END) OVER (PARTITION BY episode ORDER BY ordinal) - CASE WHEN act = 'push' THEN 1 ELSE 0 END AS pushes_before FROM {ev}",
    # Thirds of a pool's time, with the scores in them and how well the best of each pair tells positives
    "pool_time_position": """
WITH x AS (SELECT pool, third, count(*) AS n, avg(score) AS mean, max(score) AS top FROM {third_scores} GROUP BY pool, third),
a AS (SELECT pool, third, coalesce(sum(CASE WHEN y = 1 THEN hits / CAST(r AS DOUBLE) END) / nullif(max(hits_all), 0), 0e0) AS ap FROM {third_order} GROUP BY pool, third),
u AS (SELECT p.pool, p.third, (sum(CASE WHEN y = 1 THEN v.upto - v.c + 1 + (v.c - 1) / 2e0 END) - sum(y) * (sum(y) + 1) / 2e0) / nullif(CAST(sum(y) AS DOUBLE) * (count(*) - sum(y)), 0e0) AS auc FROM {third_pairs} p JOIN {third_values} v ON v.pool = p.pool AND v.third = p.third AND v.score = p.score GROUP BY p.pool, p.third)
SELECT x.pool, x.third, x.n, round(x.mean, 6) AS mean, round(x.top, 6) AS top, round(q.q90, 6) AS q90, round(a.ap, 8) AS ap, round(u.auc, 8) AS auc FROM x JOIN a ON a.pool = x.pool AND a.third = x.third JOIN u ON u.pool = x.pool AND u.third = x.third JOIN {third_quantiles} q ON q.pool = x.pool AND q.third = x.third""",
    # A session goes on while the next episode follows within the gap
    "sessionize": f"""
WITH i AS (SELECT s.pool, s.lo, s.hi, s.episode, s.ts, e.r AS idx FROM {{scored}} s JOIN {{pool_episodes}} e ON e.pool = s.pool AND e.episode = s.episode), g AS (SELECT i.*, CASE WHEN idx - lag(idx) OVER ({_T}) <= 20 THEN 0 ELSE 1 END AS fresh FROM i),
s AS (SELECT g.*, CAST(sum(fresh) OVER ({_T}) AS BIGINT) AS session FROM g) SELECT lo, hi, episode, session, count(*) OVER (PARTITION BY lo, hi, session) AS length FROM s""",
    "ascending_runs": f"""
WITH g AS (SELECT lo, hi, episode, ts, CASE WHEN score < lag(score) OVER ({_T}) THEN 1 ELSE 0 END AS fell FROM {{scored}}) SELECT lo, hi, episode, CAST(sum(fell) OVER ({_T}) AS BIGINT) AS run FROM g""",
    "rolling_max_sum": f"""
WITH r AS (SELECT lo, hi, sum(score) OVER ({_T} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS s FROM {{scored}}) SELECT lo, hi, round(max(s), 5) AS max_sum FROM r GROUP BY lo, hi""",
    "longest_run": f"""
WITH g AS (SELECT lo, hi, ts, episode, sign(lean) AS s, CASE WHEN sign(lean) = lag(sign(lean)) OVER ({_T}) THEN 0 ELSE 1 END AS fresh FROM {{scored}}), r AS (SELECT g.*, sum(fresh) OVER ({_T}) AS run FROM g),
c AS (SELECT lo, hi, run, max(s) AS s, count(*) AS n FROM r GROUP BY lo, hi, run) SELECT lo, hi, coalesce(max(CASE WHEN s <> 0 THEN n END), 0) AS longest FROM c GROUP BY lo, hi""",
    # Chance that an observed class was rewritten from another: activation a half, rate six tenths
    "visible_edit_posterior": """
SELECT v.episode, v.member, round(max(5e-1 * 6e-1 * s.share / (5e-1 * 6e-1 * s.share + d.share)), 6) AS most, round(sum(5e-1 * 6e-1 * s.share / (5e-1 * 6e-1 * s.share + d.share)), 6) AS total
FROM {ev} v JOIN {class_shares} d ON d.stage = v.stage AND d.facing = CAST(v.to_call > 0e0 AS INT) AND d.act = v.act JOIN {class_shares} s ON s.stage = v.stage AND s.facing = CAST(v.to_call > 0e0 AS INT) AND s.act = 'push' WHERE v.act = 'match' GROUP BY v.episode, v.member""",
    # From the pair's first decision: by whom, which, the reply, what outsiders did before and after, and who is left
    "trigger_sequence": """
WITH f AS (SELECT lo, hi, episode, min(CASE WHEN partner IS NOT NULL AND stage = 0 THEN ordinal END) AS start, min_by(member, CASE WHEN partner IS NOT NULL AND stage = 0 THEN ordinal END) AS actor, min_by(act, CASE WHEN partner IS NOT NULL AND stage = 0 THEN ordinal END) AS act FROM {pair_acts} GROUP BY lo, hi, episode),
g AS (SELECT * FROM f WHERE start IS NOT NULL)
SELECT f.lo, f.hi, f.episode, f.actor, f.act, min_by(v.act, CASE WHEN v.partner = f.actor AND v.ordinal > f.start THEN v.ordinal END) AS reply, count(CASE WHEN v.partner IS NULL AND v.ordinal < f.start THEN 1 END) AS outsiders_before, count(CASE WHEN v.partner IS NULL AND v.ordinal > f.start THEN 1 END) AS outsiders_after,
  CAST(max(v.stage) < 3 AS INT) AS ended_early, max(CASE WHEN (f.actor = f.lo AND v.exit_lo IS NULL) OR (f.actor = f.hi AND v.exit_hi IS NULL) THEN 1 ELSE 0 END) AS actor_at_end, max(CASE WHEN (f.actor = f.hi AND v.exit_lo IS NULL) OR (f.actor = f.lo AND v.exit_hi IS NULL) THEN 1 ELSE 0 END) AS partner_at_end, max(v.stayed) AS left_at_end
FROM g f JOIN {pair_acts} v ON v.lo = f.lo AND v.hi = f.hi AND v.episode = f.episode GROUP BY f.lo, f.hi, f.episode, f.actor, f.act""",
    "earlier_vs_last_listed": """
WITH l AS (SELECT g.lo, g.hi, max(e.ts) AS last_ts FROM {listed} g JOIN {episodes} e ON e.episode = g.episode GROUP BY g.lo, g.hi)
SELECT s.lo, s.hi, s.episode, CAST(g.episode IS NOT NULL AS INT) AS is_listed, CAST(g.episode IS NULL AND s.ts < l.last_ts AS INT) AS hard_negative, CAST(s.ts > l.last_ts AS INT) AS after_last
FROM {scored} s JOIN l ON l.lo = s.lo AND l.hi = s.hi LEFT JOIN {listed} g ON g.lo = s.lo AND g.hi = s.hi AND g.episode = s.episode""",
}

def _token_sequence(spark, sf_dir, last: int = 32):  # noqa: ANN001, ANN202
    """The last events of each episode of a pair, in order, with the role of their member, and what stays the same in the episode."""
    from tandem import catalog

    steps = "SELECT lo, hi, episode, ordinal, stage, act, CASE WHEN member = lo THEN 'A' WHEN member = hi THEN 'B' ELSE 'O' END AS role, players, stayed, s_lo, s_hi FROM {pair_steps}"
    found = catalog.relations().frame(spark, steps, catalog.Tables(spark, sf_dir)).groupBy("lo", "hi", "episode", "players", "stayed", "s_lo", "s_hi")
    rows = found.agg(F.slice(F.array_sort(F.collect_list(F.struct("ordinal", "stage", "role", "act"))), F.greatest(F.lit(1), F.count(F.lit(1)) - (last - 1)).cast("int"), last).alias("events"))
    token = lambda e: F.concat_ws(":", e["role"], e["act"], e["stage"].cast("string"))
    return rows.select("lo", "hi", "episode", F.size("events").cast("long").alias("length"), F.concat_ws(" ", F.transform("events", token)).alias("tokens"), "players", "stayed", "s_lo", "s_hi")


QUERIES = {"token_sequence": _token_sequence}
ORACLES = {
    "token_sequence": """
SELECT q.lo, q.hi, q.episode, count(*) AS length, string_agg(role || ':' || act || ':' || stage, ' ' ORDER BY ordinal) AS tokens, max(q.players) AS players, max(q.stayed) AS stayed, max(q.s_lo) AS s_lo, max(q.s_hi) AS s_hi FROM (
  SELECT q.lo, q.hi, v.episode, v.ordinal, v.act, v.stage, CASE WHEN v.member = q.lo THEN 'A' WHEN v.member = q.hi THEN 'B' ELSE 'O' END AS role, row_number() OVER (PARTITION BY q.lo, q.hi, v.episode ORDER BY v.ordinal DESC) AS r
  FROM {pair_episodes} q JOIN {ev} v ON v.episode = q.episode) t JOIN {pair_wide} q ON q.lo = t.lo AND q.hi = t.hi AND q.episode = t.episode WHERE r <= 32 GROUP BY q.lo, q.hi, q.episode""",
}

#: Scores by thirds of a pool's time, the best of each pair in them, and their orders.
RELATIONS = {
    "third_scores": stored("""
WITH e AS (SELECT pool, episode, (r - 1) / CAST(greatest(n_all - 1, 1) AS DOUBLE) AS at FROM {pool_episodes})
SELECT s.pool, CASE WHEN e.at < 1e0 / 3e0 THEN 'early' WHEN e.at < 2e0 / 3e0 THEN 'middle' ELSE 'late' END AS third, s.lo, s.hi, s.score FROM {scored} s JOIN e ON e.pool = s.pool AND e.episode = s.episode"""),
    "third_pairs": stored("""
SELECT x.pool, x.third, x.lo, x.hi, max(x.score) AS score, max(CASE WHEN l.label = 1 THEN 1 ELSE 0 END) AS y FROM {third_scores} x JOIN {pair_labels} l ON l.lo = x.lo AND l.hi = x.hi GROUP BY x.pool, x.third, x.lo, x.hi"""),
    "third_order": ordered("SELECT * FROM {third_pairs}", ("pool", "third"), ("score desc", "lo", "hi"), {"hits": "y"}),
    "third_values": counted("SELECT * FROM {third_pairs}", ("pool", "third"), "score"),
    "third_quantiles": quantiles("SELECT pool, third, score FROM {third_scores}", ("pool", "third"), "score", {"q90": 0.9}),
}
