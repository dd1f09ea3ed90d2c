"""Ranking metrics with fixed tie rules, and resampling."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions.orders import in_order
from tandem.plans.ordered import ordered

_FIVE = "SELECT lo, hi, episode, row_number() OVER (PARTITION BY lo, hi ORDER BY score DESC, ts, episode) AS r FROM {scored} WHERE win = 'development'"
_AP5 = f"""SELECT g.lo, g.hi, coalesce(sum(h.gain), 0e0) / least(5, max(g.n)) AS ap FROM (SELECT lo, hi, count(*) AS n FROM {{listed}} GROUP BY lo, hi) g
LEFT JOIN (SELECT f.lo, f.hi, count(*) OVER (PARTITION BY f.lo, f.hi ORDER BY f.r) / CAST(f.r AS DOUBLE) AS gain FROM ({_FIVE}) f JOIN {{listed}} l ON l.lo = f.lo AND l.hi = f.hi AND l.episode = f.episode WHERE f.r <= 5) h ON h.lo = g.lo AND h.hi = g.hi GROUP BY g.lo, g.hi"""
_AP = "SELECT pool, coalesce(sum(CASE WHEN label = 1 THEN hits / CAST(r AS DOUBLE) END) / nullif(max(hits_all), 0), 0e0) AS ap FROM {pair_order} GROUP BY pool"
_FAMILY = """SELECT f.family, coalesce(b.ap, 0e0) AS ap FROM (SELECT family FROM (VALUES (0), (1), (2)) AS v(family)) f
LEFT JOIN (SELECT family, sum(CASE WHEN label = 1 THEN hits / CAST(r AS DOUBLE) END) / nullif(max(hits_all), 0) AS ap FROM {family_order} GROUP BY family) b ON b.family = f.family"""


def exposure_reweighted(metrics: Mapping[str, str], window: str = "development", other: str = "evaluation") -> str:
    """SQL for the means of metrics by exposure, and with the exposures of another window.

    metrics: by name SQL for (lo, hi, x). Exposure is a pair's number of episodes in window, in bins that double; other's distribution is that of all pairs seen there. A bin without measured pairs can't be weighed, so
    the others' shares are raised to a sum of 1. reweighted is the weight of a bin's pairs; in the row of bin -1, which has the whole, it is the mean with those weights, and other_share how much of the other window the bins cover.
    """
    bin_ = lambda n: f"CAST(floor(ln({n}) / ln(2e0) + 1e-9) AS INT)"
    x = " UNION ALL ".join(f"SELECT '{name}' AS metric, lo, hi, x FROM ({sql}) m{i}" for i, (name, sql) in enumerate(metrics.items()))
    return f"""
WITH s AS (SELECT lo, hi, win, {bin_("count(*)")} AS bin FROM {{scored}} GROUP BY lo, hi, win), o AS (SELECT bin, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM s WHERE win = '{other}' GROUP BY bin), x AS ({x}),
b AS (SELECT x.metric, s.bin, count(*) AS n, avg(x.x) AS mean FROM x JOIN s ON s.lo = x.lo AND s.hi = x.hi AND s.win = '{window}' GROUP BY x.metric, s.bin),
w AS (SELECT b.*, n / CAST(sum(n) OVER (PARTITION BY metric) AS DOUBLE) AS here, coalesce(o.share, 0e0) AS there FROM b LEFT JOIN o ON o.bin = b.bin)
SELECT metric, bin, n, round(here, 8) AS share, round(there, 8) AS other_share, round(mean, 8) AS mean, round(there / here, 6) AS reweighted FROM w
UNION ALL SELECT metric, -1 AS bin, CAST(sum(n) AS BIGINT) AS n, round(sum(here), 8) AS share, round(sum(there), 8) AS other_share, round(sum(here * mean), 8) AS mean, round(sum(there * mean) / nullif(sum(there), 0e0), 6) AS reweighted FROM w GROUP BY metric"""


OPERATORS = {
    "stable_ap": f"SELECT pool, round(ap, 8) AS ap FROM ({_AP}) t",
    "ap_at_5": f"SELECT lo, hi, round(ap, 8) AS ap FROM ({_AP5}) t",
    "evidence_map5": f"SELECT p.family, count(*) AS positives, round(avg(coalesce(a.ap, 0e0)), 8) AS map5 FROM {{pair_labels}} p LEFT JOIN ({_AP5}) a ON a.lo = p.lo AND a.hi = p.hi WHERE p.label = 1 GROUP BY p.family",
    "behavior_macro_ap": f"SELECT count(*) AS families, round(avg(ap), 8) AS macro_ap FROM ({_FAMILY}) t",
    "composite": f"""
SELECT round(7e-1 * a.ap + 2e-1 * e.ap + 1e-1 * m.ap, 8) AS composite FROM (SELECT avg(ap) AS ap FROM ({_AP}) t) a
CROSS JOIN (SELECT avg(coalesce(x.ap, 0e0)) AS ap FROM {{pair_labels}} p LEFT JOIN ({_AP5}) x ON x.lo = p.lo AND x.hi = p.hi WHERE p.label = 1) e CROSS JOIN (SELECT avg(ap) AS ap FROM ({_FAMILY}) t) m""",
    # Rank-sum AUC with average ranks, for documents' quality by length
    "auc": """
WITH t AS (SELECT l.quality AS y, d.source, rank() OVER (PARTITION BY d.source ORDER BY d.n_chars) + (count(*) OVER (PARTITION BY d.source, d.n_chars) - 1) / 2e0 AS r FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id WHERE l.quality IS NOT NULL)
SELECT source, count(*) AS n, round((sum(CASE WHEN y = 1 THEN r END) - CAST(sum(y) AS DOUBLE) * (sum(y) + 1) / 2e0) / nullif(CAST(sum(y) AS DOUBLE) * (count(*) - sum(y)), 0e0), 8) AS auc FROM t GROUP BY source""",
    "recall_at_k": f"""
SELECT g.k, count(*) AS listed, round(avg(CASE WHEN f.r <= g.k THEN 1e0 ELSE 0e0 END), 8) AS recall FROM {{listed}} l JOIN ({_FIVE}) f ON f.lo = l.lo AND f.hi = l.hi AND f.episode = l.episode CROSS JOIN (SELECT k FROM (VALUES (5), (10), (20), (40)) AS v(k)) g GROUP BY g.k""",
    # Shifts between two orders of a pool's pairs, and what they change of the average precision
    "rank_change_audit": """
WITH c AS (SELECT o.pool, o.lo, o.hi, o.label, o.r AS a, t.r AS b, CASE WHEN o.label = 1 THEN o.hits / CAST(o.r AS DOUBLE) END AS gain_a, CASE WHEN o.label = 1 THEN t.hits / CAST(t.r AS DOUBLE) END AS gain_b FROM {pair_order} o JOIN {top_order} t ON t.lo = o.lo AND t.hi = o.hi)
SELECT pool, count(*) AS pairs, round(avg(abs(a - b)), 6) AS mean_shift, max(abs(a - b)) AS max_shift, count(CASE WHEN a <= 20 AND b <= 20 THEN 1 END) AS common_top, count(CASE WHEN a <= 20 AND label IS NULL THEN 1 END) AS unknown_top_a, count(CASE WHEN b <= 20 AND label IS NULL THEN 1 END) AS unknown_top_b,
  round(avg(gain_a), 8) AS ap_a, round(avg(gain_b), 8) AS ap_b, round(sum(gain_b - gain_a), 6) AS contribution_change, round(max(gain_b - gain_a), 6) AS best_change, round(min(gain_b - gain_a), 6) AS worst_change FROM c GROUP BY pool""",
    # What is lost because a listed episode is not among the first twenty, not chosen, or chosen late: the precision at five with the chosen in the right order, and with the right choice from the twenty
    "loss_decomposition": f"""
WITH c AS (SELECT l.lo, l.hi, count(*) AS n, count(CASE WHEN f.r <= 20 THEN 1 END) AS in_pool, count(CASE WHEN f.r <= 5 THEN 1 END) AS chosen, count(CASE WHEN f.r <= 5 AND f.r > l.evidence_rank THEN 1 END) AS late FROM {{listed}} l JOIN ({_FIVE}) f ON f.lo = l.lo AND f.hi = l.hi AND f.episode = l.episode GROUP BY l.lo, l.hi),
x AS (SELECT p.family, c.*, a.ap, chosen / CAST(least(5, n) AS DOUBLE) AS best_of_chosen, least(in_pool, 5) / CAST(least(5, n) AS DOUBLE) AS best_of_pool FROM c JOIN {{pair_labels}} p ON p.lo = c.lo AND p.hi = c.hi JOIN ({_AP5}) a ON a.lo = c.lo AND a.hi = c.hi)
SELECT family, count(*) AS pairs, CAST(sum(n) AS BIGINT) AS listed, CAST(sum(n - in_pool) AS BIGINT) AS outside_pool, CAST(sum(in_pool - chosen) AS BIGINT) AS not_selected, CAST(sum(late) AS BIGINT) AS ordered_late, round(avg(ap), 8) AS map5, round(avg(best_of_chosen), 8) AS map5_ordered_right, round(avg(best_of_pool), 8) AS map5_chosen_right,
  round(avg(best_of_chosen - ap), 8) AS lost_by_order, round(avg(best_of_pool - best_of_chosen), 8) AS lost_by_choice, round(avg(1e0 - best_of_pool), 8) AS lost_by_pool FROM x GROUP BY family""",
    # Orders by three scores: the precision at five of each, of the best one for each pair, and of the right choice from what any has among its first five or eight
    "union_oracles": """
WITH b AS (SELECT lo, hi, y, n, least(r_score, r_gap, r_put) AS r, r_score, r_gap, r_put FROM {model_ranks}),
h AS (SELECT lo, hi, m, CASE WHEN y = 1 AND r <= 5 THEN sum(y) OVER (PARTITION BY lo, hi, m ORDER BY r) / CAST(r AS DOUBLE) ELSE 0e0 END AS gain FROM (SELECT lo, hi, y, m, CASE m WHEN 0 THEN r_score WHEN 1 THEN r_gap ELSE r_put END AS r FROM b CROSS JOIN (SELECT m FROM (VALUES (0), (1), (2)) AS v(m)) g) t),
g AS (SELECT lo, hi, sum(CASE WHEN m = 0 THEN gain ELSE 0e0 END) AS g0, sum(CASE WHEN m = 1 THEN gain ELSE 0e0 END) AS g1, sum(CASE WHEN m = 2 THEN gain ELSE 0e0 END) AS g2 FROM h GROUP BY lo, hi),
u AS (SELECT lo, hi, CAST(least(max(n), 5) AS DOUBLE) AS most, least(sum(CASE WHEN r <= 5 THEN y ELSE 0 END), 5) AS union5, least(sum(CASE WHEN r <= 8 THEN y ELSE 0 END), 5) AS union8 FROM b GROUP BY lo, hi)
SELECT p.family, count(*) AS pairs, round(avg(g0 / most), 8) AS map5_score, round(avg(g1 / most), 8) AS map5_gap, round(avg(g2 / most), 8) AS map5_put, round(avg(greatest(g0, g1, g2) / most), 8) AS best_model, round(avg(union5 / most), 8) AS union5, round(avg(union8 / most), 8) AS union8
FROM u JOIN g ON g.lo = u.lo AND g.hi = u.hi JOIN {pair_labels} p ON p.lo = u.lo AND p.hi = u.hi GROUP BY p.family""",
    # Predicted against observed shares by bins of the chance, numbers of listed episodes, and expected against achieved average precision
    "score_calibration": f"""
WITH b AS (SELECT c.lo, c.hi, c.p, CAST(floor(c.p * 1e1) AS INT) AS bin, CASE WHEN g.episode IS NOT NULL THEN 1e0 ELSE 0e0 END AS y, row_number() OVER (PARTITION BY c.lo, c.hi ORDER BY c.p DESC, c.episode) AS r
  FROM {{chances}} c JOIN {{pair_labels}} l ON l.lo = c.lo AND l.hi = c.hi AND l.label = 1 LEFT JOIN {{listed}} g ON g.lo = c.lo AND g.hi = c.hi AND g.episode = c.episode),
e AS (SELECT lo, hi, sum(CASE WHEN r <= 5 THEN p * (1e0 + before) / r END) / least(sum(p), 5e0) AS expected, sum(CASE WHEN r <= 5 THEN y * hits / r END) / nullif(least(sum(y), 5e0), 0e0) AS achieved, sum(p) AS mass, sum(y) AS listed
  FROM (SELECT b.*, sum(p) OVER (PARTITION BY lo, hi ORDER BY r) - p AS before, sum(y) OVER (PARTITION BY lo, hi ORDER BY r) AS hits FROM b) t GROUP BY lo, hi)
SELECT 'bin' AS what, bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS observed FROM b GROUP BY bin
UNION ALL SELECT 'listed' AS what, 0 AS bin, count(*) AS n, round(avg(mass), 6) AS predicted, round(avg(listed), 6) AS observed FROM e UNION ALL SELECT 'ap' AS what, 0 AS bin, count(*) AS n, round(avg(expected), 6) AS predicted, round(avg(coalesce(achieved, 0e0)), 6) AS observed FROM e""",
    # A metric by exposure, and again with the weights of all pairs
    "exposure_strata": """
WITH b AS (SELECT CAST(least(floor(n / 10), 3) AS INT) AS bin, label, score FROM {pair_scores}), w AS (SELECT bin, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS w FROM b GROUP BY bin)
SELECT b.bin, count(*) AS n, round(max(w.w), 6) AS weight, round(avg(b.score), 8) AS mean, round(avg(b.score) * max(w.w), 8) AS part FROM b JOIN w ON w.bin = b.bin WHERE b.label IS NOT NULL GROUP BY b.bin""",
    # The precision at five of positive pairs, and the mean score of pairs with a label, by exposure in their window, and as they would be with the other window's exposures
    "exposure_reweighted": exposure_reweighted({"ap5": f"SELECT a.lo, a.hi, a.ap AS x FROM ({_AP5}) a", "score": "SELECT lo, hi, score AS x FROM {pair_scores} WHERE label IS NOT NULL"}),
}


def cluster_bootstrap(scores: DataFrame, replicas: int = 100, seed: int = 11) -> DataFrame:
    """Average precision, and mean score of positives less that of negatives, with pools drawn again with replacement.

    scores: pool, lo, hi, label, score. A pool's multiplicity in a replica is Poisson of mean 1, from a hash of both, so any partitioning gives the same. A replica's average precision
    is the mean over its drawn pools that have a positive. Returns for either measure the number of replicas that have one, mean, 5% and 95% quantiles, and the share above 0. Rows are summed for each
    pool before they meet the replicas.
    """
    known = scores.where("label is not null")
    sums = known.groupBy("pool").agg(*(F.sum(F.when(F.col("label") == y, x)).alias(n) for y, x, n in ((1, F.col("score"), "s1"), (0, F.col("score"), "s0"), (1, F.lit(1.0), "n1"), (0, F.lit(1.0), "n0"))))
    pools = sums.join(average_precision(known, "label", "score", ("lo", "hi"), ("pool",)), "pool").withColumn("has", (F.coalesce("n1", F.lit(0.0)) > 0).cast("double"))
    u: Column = F.conv(F.substring(F.md5(F.concat_ws("-", F.col("pool").cast("string"), F.col("b").cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / 2.0**32
    tails, p, total = [], 0.36787944117144233, 0.0
    for k in range(8):
        total += p
        tails.append(F.when(u >= total, 1).otherwise(0))
        p /= k + 1
    times = sum(tails[1:], tails[0])
    drawn = pools.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicas)))).withColumn("w", times)
    each = drawn.groupBy("b").agg(*(F.sum(F.col("w") * F.coalesce(c, F.lit(0.0))).alias(c) for c in ("s1", "s0", "n1", "n0")), (F.sum(F.col("w") * F.col("has") * F.col("ap")) / F.nullif(F.sum(F.col("w") * F.col("has")), F.lit(0.0))).alias("ap"))
    values = each.select(F.explode(F.array(F.struct(F.lit("gap").alias("measure"), F.when((F.col("n1") > 0) & (F.col("n0") > 0), F.col("s1") / F.col("n1") - F.col("s0") / F.col("n0")).alias("x")), F.struct(F.lit("ap").alias("measure"), F.col("ap").alias("x")))).alias("v")).select("v.*").where("x is not null")
    return values.groupBy("measure").agg(F.count(F.lit(1)).alias("replicas"), F.avg("x").alias("mean"), F.percentile("x", 0.05).alias("low"), F.percentile("x", 0.95).alias("high"), F.avg((F.col("x") > 0).cast("double")).alias("above"))


def average_precision(df: DataFrame, label: str, score: str, ids: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """L1 for any columns: average precision in each group of `by`, ties in score in the order of ids; 0 without a positive."""
    rows = df.select(*by, *ids, F.col(score).alias("_score"), F.coalesce(F.col(label), F.lit(0)).alias("_y"))
    ranked = in_order(rows, by, ("_score desc", *ids), {"_k": F.col("_y")})
    return ranked.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("_y") == 1, F.col("_k") / F.col("r"))) / F.nullif(F.sum("_y"), F.lit(0)), F.lit(0.0)).alias("ap"))


def _bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tandem import catalog

    out = cluster_bootstrap(catalog.relations().frame(spark, "SELECT pool, lo, hi, label, round(score, 9) AS score FROM {pair_scores}", catalog.Tables(spark, sf_dir)))
    return out.select("measure", "replicas", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high", "above")))


QUERIES = {"cluster_bootstrap": _bootstrap}
_HITS = {"hits": "CASE WHEN label = 1 THEN 1 ELSE 0 END"}
RELATIONS = {
    # places of a positive pair's episodes in the orders of three scores, whether each is listed (y), and how many are
    "model_ranks": """
WITH k AS (SELECT lo, hi, count(*) AS n FROM {listed} GROUP BY lo, hi)
SELECT s.lo, s.hi, s.episode, k.n, CASE WHEN g.episode IS NOT NULL THEN 1 ELSE 0 END AS y, row_number() OVER (PARTITION BY s.lo, s.hi ORDER BY greatest(s.t_ab, s.t_ba) DESC, s.ts, s.episode) AS r_score, row_number() OVER (PARTITION BY s.lo, s.hi ORDER BY abs(s.net_lo - s.net_hi) / nullif(s.unit, 0e0) DESC NULLS LAST, s.ts, s.episode) AS r_gap,
  row_number() OVER (PARTITION BY s.lo, s.hi ORDER BY (s.put_lo + s.put_hi) / nullif(s.unit, 0e0) DESC NULLS LAST, s.ts, s.episode) AS r_put
FROM {moved} s JOIN k ON k.lo = s.lo AND k.hi = s.hi LEFT JOIN {listed} g ON g.lo = s.lo AND g.hi = s.hi AND g.episode = s.episode WHERE s.win = 'development'""",
    "family_order": ordered("SELECT family, lo, hi, label, score FROM {pair_scores}", ("family",), ("score desc", "lo", "hi"), _HITS),
    "top_order": ordered("SELECT pool, lo, hi, label, top FROM {pair_scores}", ("pool",), ("top desc", "lo", "hi"), _HITS),
}
_TIMES = " + ".join(f"CASE WHEN u >= {t!r} THEN 1 ELSE 0 END" for t in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253))
ORACLES = {
    "cluster_bootstrap": f"""
WITH k AS (SELECT pool, label AS y, round(score, 9) AS score, row_number() OVER w AS r, sum(label) OVER w AS hits FROM {{pair_scores}} WHERE label IS NOT NULL WINDOW w AS (PARTITION BY pool ORDER BY round(score, 9) DESC, lo, hi)),
p AS (SELECT pool, sum(score) FILTER (y = 1) AS s1, sum(score) FILTER (y = 0) AS s0, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0, coalesce(sum(hits / CAST(r AS DOUBLE)) FILTER (y = 1) / nullif(count(*) FILTER (y = 1), 0), 0e0) AS ap FROM k GROUP BY pool),
d AS (SELECT p.*, b, ({_TIMES}) AS w FROM (SELECT p.*, b, CAST('0x' || substr(md5(CAST(pool AS VARCHAR) || '-' || CAST(b AS VARCHAR) || '-11'), 1, 8) AS BIGINT) / 4294967296e0 AS u FROM p CROSS JOIN range(1, 101) AS t(b)) p),
e AS (SELECT b, sum(w * coalesce(s1, 0e0)) AS s1, sum(w * coalesce(s0, 0e0)) AS s0, sum(w * n1) AS n1, sum(w * n0) AS n0, sum(CASE WHEN n1 > 0 THEN w * ap END) / nullif(sum(CASE WHEN n1 > 0 THEN w END), 0) AS ap FROM d GROUP BY b),
v AS (SELECT 'gap' AS measure, s1 / n1 - s0 / n0 AS x FROM e WHERE n1 > 0 AND n0 > 0 UNION ALL SELECT 'ap', ap FROM e WHERE ap IS NOT NULL)
SELECT measure, count(*) AS replicas, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.05), 6) AS low, round(quantile_cont(x, 0.95), 6) AS high, round(avg(CASE WHEN x > 0 THEN 1e0 ELSE 0e0 END), 6) AS above FROM v GROUP BY measure""",
}
