"""Folds, cross-fitted models and the use of their scores."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.functions import orders
from tandem.operators import pairs
from tandem.operators.decoders import SLOT
from tandem.operators.features import ACTS
from tandem.operators.interactions import partners
from tandem.operators.metrics import average_precision
from tandem.plans.ordered import OnSpark, counted, ordered, quantiles, stored
from tandem.sources.sinks import kept


def route_other(first: int = 60, first_floor: float = 2.5, second: int = 100, second_floor: float = 3.02) -> str:
    """SQL for the pairs that are called other: near the top of their pool and with a high best episode, or a little lower with a higher one."""
    return f"SELECT pool, lo, hi FROM {{pair_order}} WHERE (r <= {first} AND top > {first_floor}e0) OR (r <= {second} AND top > {second_floor}e0)"


def column_subset(columns: Sequence[str], seed: int, share: float = 0.5) -> list[str]:
    """The first columns in the order of a hash of their names and the seed, for models that differ."""
    order = sorted(columns, key=lambda c: hashlib.md5(f"{c}-{seed}".encode()).hexdigest())
    return order[: max(1, round(share * len(columns)))]


_PAIR = ("f_score", "f_top", "f_log_n", "f_lo_hi", "f_hi_lo")
_BLOCKS = ("f_spec_lo", "f_spec_hi", "f_exits_lo", "f_exits_hi", "f_exits", "f_z_max", "f_z_min", "f_total", "f_rate99", "f_rate999", "f_top3", "f_top5", "f_llr", "f_llr_rate", "f_llr_eighth", "f_llr_hundredth")
_VIEWS = (1, 2, 3)


def feature_views(relation: str, keys: Sequence[str], columns: Sequence[str], seeds: Sequence[int], share: float = 0.5) -> str:
    """SQL for the rows of a relation once for each seed (as view), with null in the columns that column_subset() leaves out there."""
    shown = ", ".join(f"CASE WHEN view IN ({', '.join(str(s) for s in seeds if c in column_subset(columns, s, share)) or 'NULL'}) THEN round({c}, 6) END AS {c}" for c in columns)
    return f"SELECT {', '.join(keys)}, view, {shown} FROM {{{relation}}} CROSS JOIN (SELECT view FROM (VALUES {', '.join(f'({s})' for s in seeds)}) AS v(view)) g"


OPERATORS = {
    # K1: folds of whole pools, the same in any engine
    "assign_folds": "SELECT pool, count(*) AS pairs, CAST(ascii(substr(md5(CAST(pool AS VARCHAR(20))), 1, 1)) % 3 AS BIGINT) AS fold FROM {pair_labels} GROUP BY pool",
    # K8: weights for training on positives and unlabelled rows, in three modes; rows below an exposure floor or with a member of a positive pair don't train
    "pu_clean": """
WITH c AS (SELECT high FROM {unknown_high}), t AS (SELECT lo AS member FROM {pair_labels} WHERE label = 1 UNION SELECT hi AS member FROM {pair_labels} WHERE label = 1),
x AS (SELECT p.lo, p.hi, p.n, p.label, CAST(p.label IS NULL AND p.score > c.high AS INT) AS doubtful, CASE WHEN p.label IS NULL AND (p.lo IN (SELECT member FROM t) OR p.hi IN (SELECT member FROM t)) THEN 1 ELSE 0 END AS touches FROM {stored_scores} p CROSS JOIN c)
SELECT lo, hi, doubtful, touches, CASE WHEN n < 12 OR touches = 1 THEN 0e0 ELSE 1e0 END AS w_none, CASE WHEN n < 12 OR touches = 1 OR doubtful = 1 THEN 0e0 ELSE 1e0 END AS w_drop, CASE WHEN n < 12 OR touches = 1 THEN 0e0 WHEN doubtful = 1 THEN 5e-1 ELSE 1e0 END AS w_pos, CASE WHEN label = 1 OR doubtful = 1 THEN 1 ELSE 0 END AS y_pos FROM x""",
    # K14
    "consensus_score": """
SELECT lo, hi, episode, round(p + 5e-1 * p * p + 1e-1 * ln(p / (1e0 - p)), 8) AS u, CAST(row_number() OVER (PARTITION BY lo, hi ORDER BY p + 5e-1 * p * p + 1e-1 * ln(p / (1e0 - p)) DESC, episode) AS BIGINT) AS r FROM {chances}""",
    # Sure rows, the mass of each pair bounded; and preferences: the surest event before the surest other row of the pair, and so on for five
    "pseudo_label": """
WITH s AS (SELECT lo, hi, episode, p, CASE WHEN p > 3e-1 THEN 1 WHEN p < 1e-3 THEN 0 END AS y FROM {chances}), k AS (SELECT s.*, count(*) OVER (PARTITION BY lo, hi) AS n, row_number() OVER (PARTITION BY lo, hi, y ORDER BY CASE WHEN y = 1 THEN -p ELSE p END, episode) AS r FROM s WHERE y IS NOT NULL)
SELECT a.lo, a.hi, a.episode, a.y, round(least(1e0, 3e0 / a.n), 8) AS weight, b.episode AS preferred_to, round(a.p - b.p, 8) AS margin FROM k a LEFT JOIN k b ON b.lo = a.lo AND b.hi = a.hi AND a.y = 1 AND b.y = 0 AND b.r = a.r AND a.r <= 5""",
    # Scores put together as means of standard scores, of ranks, of logits of ranks, and of groups of scores; the old one mixed with a new one; and ranks with weights
    "fuse_scores": """
WITH s AS (SELECT pool, lo, hi, score AS a, top AS b, n, ln(1e0 + n) AS size FROM {stored_scores}), m AS (SELECT avg(a) AS ma, stddev_samp(a) AS sa, avg(b) AS mb, stddev_samp(b) AS sb, avg(size) AS mc, stddev_samp(size) AS sc FROM s),
x AS (SELECT s.pool, s.lo, s.hi, coalesce((a - ma) / nullif(sa, 0e0), 0e0) AS za, coalesce((b - mb) / nullif(sb, 0e0), 0e0) AS zb, coalesce((size - mc) / nullif(sc, 0e0), 0e0) AS zc, va.upto / CAST(va.c_all AS DOUBLE) AS ra, vb.upto / CAST(vb.c_all AS DOUBLE) AS rb, vc.upto / CAST(vc.c_all AS DOUBLE) AS rc FROM s CROSS JOIN m
  JOIN {pool_values} va ON va.pool = s.pool AND va.score = s.a JOIN {top_values} vb ON vb.pool = s.pool AND vb.top = s.b JOIN {size_values} vc ON vc.pool = s.pool AND vc.n = s.n)
SELECT lo, hi, round((za + zb + zc) / 3e0, 6) AS z_mean, round((ra + rb + rc) / 3e0, 6) AS rank_mean, round((ln((ra * 998e-3 + 1e-3) / (999e-3 - ra * 998e-3)) + ln((rb * 998e-3 + 1e-3) / (999e-3 - rb * 998e-3)) + ln((rc * 998e-3 + 1e-3) / (999e-3 - rc * 998e-3))) / 3e0, 6) AS logit_mean, round(((za + zb) / 2e0 + zc) / 2e0, 6) AS group_mean,
  round(75e-2 * za + 25e-2 * zb, 6) AS mixed, round(5e-1 * ra + 25e-2 * rb + 25e-2 * rc, 6) AS weighted_rank FROM x""",
    # The family with the highest score, other below a confidence, none below a risk; for a grid of both thresholds how many fall where, and the macro average precision
    "assign_behavior": """
WITH a AS (SELECT t_family, t_risk, target, pool, coalesce(sum(CASE WHEN y = 1 THEN hits / CAST(r AS DOUBLE) END) / nullif(max(hits_all), 0), 0e0) AS ap FROM {assigned_order} GROUP BY t_family, t_risk, target, pool), m AS (SELECT t_family, t_risk, avg(ap) AS ap FROM a GROUP BY t_family, t_risk)
SELECT x.t_family, x.t_risk, count(CASE WHEN given = -1 THEN 1 END) AS n_none, count(CASE WHEN given = 3 THEN 1 END) AS n_other, count(CASE WHEN given = 0 THEN 1 END) AS n0, count(CASE WHEN given = 1 THEN 1 END) AS n1, count(CASE WHEN given = 2 THEN 1 END) AS n2, count(CASE WHEN label = 1 AND given = family THEN 1 END) AS right_family, round(max(m.ap), 8) AS macro_ap
FROM {assigned} x JOIN m ON m.t_family = x.t_family AND m.t_risk = x.t_risk GROUP BY x.t_family, x.t_risk""",
    # K19
    "route_other": route_other(),
    # Other families' positives get no weight, not label 0
    "target_view": "SELECT lo, hi, f.family AS target, CASE WHEN label = 1 AND l.family = f.family THEN 1 ELSE 0 END AS y, CASE WHEN label = 1 AND l.family <> f.family THEN 0e0 WHEN label IS NULL THEN 5e-1 ELSE 1e0 END AS weight FROM {pair_labels} l CROSS JOIN (SELECT family FROM (VALUES (0), (1), (2)) AS v(family)) f",
    # The pair table as models of different columns see it
    "feature_views": feature_views("pair_table", ("lo", "hi"), _PAIR, _VIEWS),
    # A pair's columns and blocks, for models of pairs
    "risk_table": f"SELECT lo, hi, label, fold, {', '.join(f'round({c}, 6) AS {c}' for c in _PAIR)}, {', '.join(_BLOCKS)} FROM {{risk_table}}",
    # Pairs of a listed and an unlisted candidate, by what swapping them changes of the precision at five
    "rerank_weights": """
WITH r AS (SELECT s.lo, s.hi, s.episode, row_number() OVER (PARTITION BY s.lo, s.hi ORDER BY s.score DESC, s.ts, s.episode) AS r, CASE WHEN g.episode IS NOT NULL THEN 1 ELSE 0 END AS y
  FROM {scored} s JOIN (SELECT DISTINCT lo, hi FROM {listed}) k ON k.lo = s.lo AND k.hi = s.hi LEFT JOIN {listed} g ON g.lo = s.lo AND g.hi = s.hi AND g.episode = s.episode WHERE s.win = 'development')
SELECT a.lo, a.hi, a.episode AS listed_episode, b.episode AS other_episode, round(abs(CASE WHEN a.r <= 5 THEN 1e0 / a.r ELSE 0e0 END - CASE WHEN b.r <= 5 THEN 1e0 / b.r ELSE 0e0 END), 8) AS weight FROM r a JOIN r b ON b.lo = a.lo AND b.hi = a.hi AND a.y = 1 AND b.y = 0 AND a.r <= 20 AND b.r <= 20""",
}

RELATIONS = {
    "unknown_high": quantiles("SELECT score FROM {stored_scores} WHERE label IS NULL", (), "score", {"high": 0.9}),
    "top_values": counted("SELECT * FROM {stored_scores}", ("pool",), "top"),
    "size_values": counted("SELECT * FROM {stored_scores}", ("pool",), "n"),
    "assigned": stored("""
WITH f AS (SELECT t.pool, t.lo, t.hi, avg(greatest(t_ab, t_ba)) AS risk, avg(t_ab) AS f0, avg(t_ba) AS f1, avg(abs(s_lo - s_hi)) AS f2, max(l.label) AS label, max(l.family) AS family FROM {transfers} t JOIN {pair_labels} l ON l.lo = t.lo AND l.hi = t.hi GROUP BY t.pool, t.lo, t.hi),
b AS (SELECT f.*, CASE WHEN f0 >= f1 AND f0 >= f2 THEN 0 WHEN f1 >= f2 THEN 1 ELSE 2 END AS best, greatest(f0, f1, f2) / nullif(f0 + f1 + f2, 0e0) AS sure FROM f),
g AS (SELECT a.t AS t_family, r.t AS t_risk FROM (SELECT t FROM (VALUES (0e0), (4e-1), (6e-1)) AS v(t)) a CROSS JOIN (SELECT t FROM (VALUES (1e-1), (5e-1)) AS v(t)) r)
SELECT g.*, b.*, CASE WHEN risk < t_risk THEN -1 WHEN sure < t_family THEN 3 ELSE best END AS given FROM b CROSS JOIN g"""),
    "assigned_order": ordered(
        "SELECT x.t_family, x.t_risk, k.k AS target, x.pool, x.lo, x.hi, CASE WHEN x.label = 1 AND x.family = k.k THEN 1 ELSE 0 END AS y, CASE WHEN x.given = k.k THEN x.risk ELSE 0e0 END AS shown FROM {assigned} x CROSS JOIN (SELECT k FROM (VALUES (0), (1), (2)) AS v(k)) k",
        ("t_family", "t_risk", "target", "pool"), ("shown desc", "lo", "hi"), {"hits": "y"},
    ),
    "decision_table": """
SELECT v.episode, v.ordinal, v.act, v.stage, CAST(v.to_call > 0e0 AS INT) AS facing, v.to_call / nullif(e.unit, 0e0) AS cost, CASE WHEN v.to_call > 0e0 THEN v.to_call / (v.pot + v.to_call) ELSE 0e0 END AS odds, v.active, v.pushes_before, v.own_pushes_before, v.strength, v.own_no, CAST(ascii(substr(md5(CAST(m.pool AS VARCHAR(20))), 1, 1)) % 3 AS INT) AS fold
FROM {steps} v JOIN {episodes} e ON e.episode = v.episode JOIN {members} m ON m.member = v.member""",
    "window_table": """
SELECT s.pool, s.win, s.lo, s.hi, max(l.label) AS label, CAST(ascii(substr(md5(CAST(s.pool AS VARCHAR(20))), 1, 1)) % 3 AS INT) AS fold, avg(s.score) AS f_score, max(s.score) AS f_top, ln(1e0 + count(*)) AS f_log_n FROM {scored} s JOIN {pair_labels} l ON l.lo = s.lo AND l.hi = s.hi GROUP BY s.pool, s.win, s.lo, s.hi""",
    "all_episodes": """
SELECT t.pool, t.lo, t.hi, t.episode, CASE WHEN l.label = 1 THEN CASE WHEN g.episode IS NOT NULL THEN 1 ELSE 0 END WHEN l.label = 0 THEN 0 END AS y, CAST(ascii(substr(md5(CAST(t.pool AS VARCHAR(20))), 1, 1)) % 3 AS INT) AS fold, greatest(t.t_ab, t.t_ba) AS f_score, t.t_ab - t.t_ba AS f_lean, t.s_lo AS f_s_lo, t.s_hi AS f_s_hi,
  (t.put_lo + t.put_hi) / t.unit AS f_put, t.players AS f_players, t.stayed AS f_stayed FROM {transfers} t JOIN {pair_labels} l ON l.lo = t.lo AND l.hi = t.hi LEFT JOIN {listed} g ON g.lo = t.lo AND g.hi = t.hi AND g.episode = t.episode WHERE t.unit > 0e0""",
    # the pairs of pair_table with what needs no look at the events
    "pair_folds": "SELECT pool, lo, hi, label, CAST(ascii(substr(md5(CAST(pool AS VARCHAR(20))), 1, 1)) % 3 AS INT) AS fold FROM {pair_scores}",
    "pair_table": """
SELECT s.pool, s.lo, s.hi, s.label, s.family, s.n, CAST(ascii(substr(md5(CAST(s.pool AS VARCHAR(20))), 1, 1)) % 3 AS INT) AS fold, s.score AS f_score, s.top AS f_top, ln(1e0 + s.n) AS f_log_n, r.n_lo_hi / CAST(greatest(s.n, 1) AS DOUBLE) AS f_lo_hi, r.n_hi_lo / CAST(greatest(s.n, 1) AS DOUBLE) AS f_hi_lo
FROM {pair_scores} s JOIN {rolled} r ON r.lo = s.lo AND r.hi = s.hi""",
    # a pair's columns beside the blocks of partner specificity, conditional rates, their z, bag sums and mixture ratios
    "risk_table": f"""
SELECT p.*, s.lo_toward_hi AS f_spec_lo, s.hi_toward_lo AS f_spec_hi, c.lo_exits AS f_exits_lo, c.hi_exits AS f_exits_hi, c.both_exit AS f_exits, z.z_max AS f_z_max, z.z_min AS f_z_min, b.total AS f_total, b.rate99 AS f_rate99, b.rate999 AS f_rate999, b.top3 AS f_top3, b.top5 AS f_top5,
  m.best AS f_llr, m.best_rate AS f_llr_rate, m.at_eighth AS f_llr_eighth, m.at_hundredth AS f_llr_hundredth FROM {{pair_table}} p LEFT JOIN ({pairs.OPERATORS["partner_specificity"]}) s ON s.lo = p.lo AND s.hi = p.hi LEFT JOIN ({pairs.OPERATORS["conditional_rate_contrast"]}) c ON c.lo = p.lo AND c.hi = p.hi
LEFT JOIN ({pairs.OPERATORS["binomial_z"]}) z ON z.lo = p.lo AND z.hi = p.hi LEFT JOIN ({pairs.OPERATORS["bag_reduce"]}) b ON b.lo = p.lo AND b.hi = p.hi LEFT JOIN ({pairs.OPERATORS["mixture_lr_bag"]}) m ON m.lo = p.lo AND m.hi = p.hi""",
    "episode_table": """
WITH l AS (SELECT g.lo, g.hi, max(e.ts) AS last_ts FROM {listed} g JOIN {episodes} e ON e.episode = g.episode GROUP BY g.lo, g.hi)
SELECT t.pool, t.lo, t.hi, t.episode, CASE WHEN g.episode IS NOT NULL THEN 1 ELSE 0 END AS y, CASE WHEN g.episode IS NULL AND t.ts < l.last_ts THEN 1 ELSE 0 END AS hard_negative, p.family, CAST(ascii(substr(md5(CAST(t.pool AS VARCHAR(20))), 1, 1)) % 3 AS INT) AS fold, greatest(t.t_ab, t.t_ba) AS f_score, t.t_ab - t.t_ba AS f_lean, t.s_lo AS f_s_lo, t.s_hi AS f_s_hi
FROM {transfers} t JOIN {pair_labels} p ON p.lo = t.lo AND p.hi = t.hi AND p.label = 1 LEFT JOIN l ON l.lo = t.lo AND l.hi = t.hi LEFT JOIN {listed} g ON g.lo = t.lo AND g.hi = t.hi AND g.episode = t.episode""",
}


_RISK = RELATIONS["risk_table"]
_RISK_ON_SPARK = _RISK.replace("{pair_table}", f"({RELATIONS['pair_table']})").replace(pairs.OPERATORS["mixture_lr_bag"], pairs.MIXTURE_ON_SPARK).replace("{pair_scores}", "{stored_scores}").replace("{rolled}", "{stored_rolled}")


def _risk_on_spark(frame: Callable[..., DataFrame]) -> DataFrame:
    """On Spark what several blocks read is found once and stored: pairs' episodes and their scores, labels, pairs' scores, and counts toward partners."""
    own: dict[str, DataFrame] = {}
    for name in ("pair_episodes", "scored", "pair_labels"):
        own[name] = kept(frame(f"SELECT * FROM {{{name}}}", own))
    own["stored_scores"] = frame("SELECT * FROM {stored_scores}", own)
    own["partners"] = kept(frame(partners(("faced", "exit_to"), "kernel", "faced > 0"), own))
    own["stored_rolled"] = kept(frame(pairs.ROLLED_FROM_PARTNERS, own))
    return frame(_RISK_ON_SPARK, own)


RELATIONS["risk_table"] = OnSpark(_RISK, _risk_on_spark)


def _ready(features: Sequence[str], standardize: bool, out: str = "features", missing: Sequence[str] | None = None) -> list[Estimator | Transformer]:
    """missing: the features that need filling, if that is known; the medians of others would go nowhere."""
    fill = [c for c in features if missing is None or c in missing]
    filled = {c: f"{c}_{out}_filled" for c in fill}
    steps = [Imputer(inputCols=fill, outputCols=list(filled.values()), strategy="median")] if fill else []
    steps.append(VectorAssembler(inputCols=[filled.get(c, c) for c in features], outputCol=f"{out}_raw" if standardize else out))
    if standardize:
        steps.append(StandardScaler(inputCol=f"{out}_raw", outputCol=out, withMean=True))
    return steps


def with_features(model: Estimator, features: Sequence[str], standardize: bool = False) -> Pipeline:
    """A pipeline that fills missing values by medians of the training rows, assembles features, and fits model on them."""
    return Pipeline(stages=[*_ready(features, standardize), model])


def _folds(df: DataFrame, fold: str) -> list:
    return sorted(r[0] for r in df.select(fold).distinct().collect())


def cross_fit(df: DataFrame, model: Estimator, features: Sequence[str], label: str = "label", fold: str = "fold", weight: str | None = None, out: str = "score", standardize: bool = False, other: DataFrame | None = None) -> DataFrame:
    """K2: df with a score for every row by a model that was fitted on the other folds.

    Rows without a label, or of weight 0, are scored but don't train. Folds must be of whole pools. Training rows of one class give that class's rate, the same for all
    rows of the fold. A model that has no probability, as of a regression, gives its prediction. other: rows of the other window, with df's columns, that are
    scored by a model of all of df's labelled rows and follow. One fit for each fold, and one for other; only the list of folds comes to the driver.
    """
    return cross_fits(df, {out: (model, features)}, label, fold, weight, standardize, other)


#: Models that are fitted at a time: most of a small fit is waiting for short jobs.
FITS = 4


def _at_once(spark: SparkSession, todo: Iterable[Callable[[], object]]) -> list:
    with ThreadPool(FITS) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda f: f()), list(todo), chunksize=1)


def cross_fits(df: DataFrame, models: Mapping[str, tuple[Estimator, Sequence[str]]], label: str = "label", fold: str = "fold", weight: str | None = None, standardize: bool = False, other: DataFrame | None = None, balance: bool = False) -> DataFrame:
    """cross_fit() for several models (name: model and its features): df with a score of each under its name.

    balance: the classes of each fit's training rows weigh the same together; this multiplies weight.

    All models read df itself, and rows are filled and assembled once for each fold and list of features. So the plan has one part for each fold, whatever the number of
    models; cross_fit() on the result of another would have the folds' parts of that in each of its own.
    """
    trains = F.col(label).isNotNull()
    if weight:
        trains = trains & (F.col(weight) > 0)
    known = df.where(trains)
    lists = {features: f"_x{i}" for i, features in enumerate(dict.fromkeys(tuple(f) for _, f in models.values()))}

    columns = list(dict.fromkeys(c for f in lists for c in f))
    gap = lambda c: F.max(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c)
    # one look at the rows tells the folds, the least and greatest label of each, and which features lack values
    of = {r[fold]: r for r in df.groupBy(fold).agg(F.min(F.when(trains, F.col(label))).alias("_least"), F.max(F.when(trains, F.col(label))).alias("_most"), *map(gap, columns)).collect()}
    rows = [*of.values(), *([other.agg(*map(gap, columns)).first()] if other is not None else [])]
    missing = [c for c in columns if any(r[c] for r in rows)]
    sides = [(k, known.where(F.col(fold) != k), df.where(F.col(fold) == k)) for k in sorted(of)]
    if other is not None:
        sides.append((None, known, other))

    def readied(k: object, train: DataFrame) -> tuple[float, list[Transformer]]:
        ends = [float(r[e]) for f, r in of.items() if f != k and r["_least"] is not None for e in ("_least", "_most")]
        if not ends or min(ends) == max(ends):
            return ends[0] if ends else 0.0, []
        return 0.0, [Pipeline(stages=_ready(f, standardize, x, missing)).fit(train) for f, x in lists.items()]

    def balanced(train: DataFrame) -> DataFrame:
        own = F.col(weight) if weight else F.lit(1.0)
        sums = {r[0]: r[1] for r in train.groupBy(label).agg(F.sum(own)).collect()}
        each = [F.when(F.col(label) == y, own * (sum(sums.values()) / len(sums) / w)) for y, w in sums.items()]
        return train.withColumn("_balanced", F.coalesce(*each))

    def fitted(train: DataFrame, model: Estimator, features: Sequence[str], steps: list[Transformer]) -> Transformer:
        x = lists[tuple(features)]
        own = model.copy().setLabelCol(label).setFeaturesCol(x)
        if weight or balance:
            own = own.setWeightCol("_balanced" if balance else weight)
        return own.fit(steps[list(lists).index(tuple(features))].transform(balanced(train) if balance else train))

    ready = _at_once(df.sparkSession, (lambda k=k, train=train: readied(k, train) for k, train, _ in sides))
    each = [(i, name) for i, (_, steps) in enumerate(ready) if steps for name in models]
    found = dict(zip(each, _at_once(df.sparkSession, (lambda i=i, name=name: fitted(sides[i][1], *models[name], ready[i][1]) for i, name in each)), strict=True))
    parts = []
    for i, (_, _, test) in enumerate(sides):
        rate, steps = ready[i]
        done = reduce(lambda rows, step: step.transform(rows), steps, test)
        for name in models:
            before = done.columns
            if steps:
                done = found[i, name].transform(done)
            score = F.lit(rate) if not steps else vector_to_array("probability")[1] if "probability" in done.columns else F.col("prediction")
            done = done.select(*(c for c in before if c != name), score.alias(name))
        parts.append(done.select(*(c for c in test.columns if c not in models), *models))
    return reduce(DataFrame.unionByName, parts)


def fit_action_policy(decisions: DataFrame, features: Sequence[str], act: str = "act", fold: str = "fold", iterations: int = 30) -> DataFrame:
    """K3: decisions with q_exit, q_hold, q_match and q_push, chances of the four classes by a multinomial logistic model of the other folds."""
    coded = decisions.withColumn("_y", F.array_position(F.array(*(F.lit(a) for a in ACTS)), F.col(act)).cast("double") - 1)
    parts = []
    for k in _folds(coded, fold):
        model = LogisticRegression(family="multinomial", labelCol="_y", regParam=1e-3, maxIter=iterations)
        done = with_features(model, features, True).fit(coded.where(F.col(fold) != k)).transform(coded.where(F.col(fold) == k))
        chance = vector_to_array("probability")
        # a class that the other folds lack has no chance of its own
        parts.append(done.select(*decisions.columns, *(F.coalesce(F.get(chance, i), F.lit(0.0)).alias(f"q_{a}") for i, a in enumerate(ACTS))))
    return reduce(DataFrame.unionByName, parts)


def ranked(df: DataFrame, score: str, out: str, bins: int = 4096) -> DataFrame:
    """df with out, the share of rows with a lower score: counted in bins of the score's quantiles, so that no task sees all rows; inside a bin rows are even."""
    return ranked_each(df, {score: out}, bins)


def ranked_each(df: DataFrame, scores: Mapping[str, str], bins: int = 4096) -> DataFrame:
    """ranked() for several scores (score: out), all found on df itself."""
    edges = df.approxQuantile(list(scores), [i / bins for i in range(1, bins)], 1 / bins / 2) if bins else [[] for _ in scores]
    cut = lambda score, own: F.size(F.filter(F.array(*(F.lit(float(e)) for e in sorted(set(own)))), lambda e: e < F.col(score))) if own else F.lit(0)
    placed = df.withColumns({f"_bin_{score}": cut(score, own) for score, own in zip(scores, edges, strict=True)})
    found = placed
    for score, out in scores.items():
        counts = placed.groupBy(f"_bin_{score}").agg(F.count(F.lit(1)).alias("_n"))
        below = F.sum("_n").over(Window.orderBy(f"_bin_{score}")) - F.col("_n")
        shares = counts.select(f"_bin_{score}", (below / F.greatest(F.sum("_n").over(Window.partitionBy()) - 1, F.lit(1))).alias(out))
        found = found.join(F.broadcast(shares), f"_bin_{score}").drop(f"_bin_{score}")  # one row for each bin
    return found


def exact_ranks(df: DataFrame, scores: Mapping[str, str], slot: int = SLOT) -> DataFrame:
    """df with the mean rank of each score's value among all rows (score: out), as a share of the rows. df should be stored, as all is found on df itself.

    Distinct values are counted in their order, so no task sees all rows, and a value of more than `slot` rows takes its rank to where they lie.
    """
    values = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.col(score).cast("double").alias("x")) for i, score in enumerate(scores)))).alias("_v")).select("_v.k", "_v.x")
    counts = kept(orders.counted(values, ("k",), "x").select("k", "x", "c", ((F.col("upto") - (F.col("c") - 1) / 2) / F.col("c_all")).alias("rank")))
    for i, (score, out) in enumerate(scores.items()):
        own = counts.where(F.col("k") == i)
        hot = own.where(F.col("c") > slot).select(F.col("x").alias(score), F.col("rank").alias("_hot"))
        rest = own.where(F.col("c") <= slot).select(F.col("x").alias(score), F.lit(0).cast("long").alias("_spread"), F.col("rank").alias(out))
        met = df.join(F.broadcast(hot), score, "left").withColumn("_spread", F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(*df.columns), F.lit(1 << 20)) + 1))
        df = met.join(rest, [score, "_spread"], "left").select(*df.columns, F.coalesce("_hot", out).alias(out))
    return df


def fit_pair_risk(pairs: DataFrame, features: Sequence[str], seeds: Sequence[int] = (1, 2, 3), rounds: int = 60, depth: int = 5, trees: int = 60, bins: int | None = None, weight: str | None = None) -> DataFrame:
    """K4: out-of-fold risk of pairs, as the mean rank of boosted trees and forests of several seeds and of a logistic model.

    rounds and depth are those of the boosted trees, trees the number in a forest. Labelled pairs train, each class with half of the weight. Ranks are over all pairs, and exact without bins.
    """
    boosted = [GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=s) for s in seeds]
    models = [*boosted, *(RandomForestClassifier(numTrees=trees, maxDepth=depth + 2, seed=s) for s in seeds), LogisticRegression(regParam=0.01)]
    names = [f"_m{i}" for i in range(len(models))]
    pairs = kept(cross_fits(pairs, {name: (m, features) for name, m in zip(names, models, strict=True)}, weight=weight, balance=True))
    of = {n: f"{n}r" for n in names}
    pairs = ranked_each(pairs, of, bins) if bins else exact_ranks(pairs, of)
    ranks = [F.col(f"{n}r") for n in names]
    return pairs.withColumn("risk", sum(ranks[1:], ranks[0]) / len(ranks)).drop(*names, *(f"{n}r" for n in names))


def fit_family(pairs: DataFrame, features: Sequence[str]) -> DataFrame:
    """K5: the most likely family of every pair, by a multinomial model of the positives of other folds."""
    positives = pairs.where("label = 1")
    parts = []
    for k in _folds(pairs, "fold"):
        train, test = positives.where(F.col("fold") != k), pairs.where(F.col("fold") == k)
        if train.select("family").distinct().count() < 2:
            parts.append(test.withColumn("predicted_family", F.lit(0.0)))
            continue
        fitted = with_features(LogisticRegression(family="multinomial", labelCol="family", regParam=0.01, predictionCol="predicted_family"), features, True).fit(train)
        parts.append(fitted.transform(test).select(*pairs.columns, "predicted_family"))
    return reduce(DataFrame.unionByName, parts)


def fit_episode_detector(episodes: DataFrame, features: Sequence[str], model: Estimator | None = None, out: str = "score", balance: float = 3.0, hard: float = 2.0) -> DataFrame:
    """K6: out-of-fold chance that an episode is listed. Listed rows weigh `balance`, unlisted ones before the pair's last listed one (hard_negative = 1) `hard`."""
    weighted = episodes.withColumn("_w", F.when(F.col("y") == 1, balance).when(F.col("hard_negative") == 1, hard).otherwise(1.0))
    return cross_fit(weighted, model or GBTClassifier(maxIter=40, maxDepth=4, stepSize=0.1, seed=3), features, label="y", weight="_w", out=out).drop("_w")


def route_experts(episodes: DataFrame, features: Sequence[str], share: float = 0.5, model: Estimator | None = None) -> DataFrame:
    """K7: a detector of listed episodes (K6) for all, one for each family, and their mixture by the family of the pair."""
    general = fit_episode_detector(episodes, features, model, "universal")
    parts = [cross_fit(general.where(F.col("family") == f), LogisticRegression(regParam=0.05), features, label="y", out="routed") for f in _folds(episodes, "family")]
    return reduce(DataFrame.unionByName, parts).withColumn("score", (1 - share) * F.col("universal") + share * F.col("routed"))


def leave_one_family_out(pairs: DataFrame, features: Sequence[str], model: Estimator | None = None) -> DataFrame:
    """Scores of each family's positives, and of all negatives, by models that never saw the family; and, the same in all rows of a family, the average precision (ap) with which they find it."""
    parts = []
    for f in _folds(pairs.where("label = 1"), "family"):
        hidden = pairs.withColumn("_w", F.when((F.col("label") == 1) & (F.col("family") == f), 0.0).otherwise(1.0))
        scored = cross_fit(hidden, model or LogisticRegression(regParam=0.01), features, weight="_w")
        parts.append(scored.where(F.col("label").isNotNull() & ((F.col("label") == 0) | (F.col("family") == f))).withColumn("hidden_family", F.lit(f)).drop("_w"))
    scored = kept(reduce(DataFrame.unionByName, parts))
    return scored.join(average_precision(scored, "label", "score", ("lo", "hi"), ("hidden_family",)), "hidden_family")


def value_residual(episodes: DataFrame, target: str, context: Sequence[str], keys: Sequence[str] = ("lo", "hi"), model: Estimator | None = None) -> DataFrame:
    """What of a value its context doesn't explain, by a regression of the other folds; of each group the highest residual plus half the mean of the positive parts."""
    fitted = cross_fit(episodes, model or LinearRegression(regParam=0.01), context, label=target, out="_expected")
    rest = F.col(target) - F.col("_expected")
    return fitted.groupBy(*keys).agg((F.max(rest) + 0.5 * F.avg(F.greatest(rest, F.lit(0.0)))).alias("value"), F.max(rest).alias("highest"), F.count(F.lit(1)).alias("n"))


def attention_bag(scored: DataFrame, gate: str, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """D47 for any columns: their means by softmax of the gate's logit over each group, their maxima, the largest weight, and the weights' entropy as a share of the possible."""
    by = Window.partitionBy(*keys)
    p = F.least(F.greatest(F.col(gate), F.lit(1e-6)), F.lit(1 - 1e-6))
    logits = scored.withColumn("_z", F.log(p / (1 - p)))
    weights = logits.withColumn("_e", F.exp(F.col("_z") - F.max("_z").over(by))).withColumn("_g", F.col("_e") / F.sum("_e").over(by))
    entropy = F.when(F.count(F.lit(1)) > 1, -F.sum(F.col("_g") * F.log(F.col("_g") + 1e-12)) / F.log(F.count(F.lit(1)))).otherwise(F.lit(0.0))
    return weights.groupBy(*keys).agg(*(F.sum(F.col("_g") * F.col(c)).alias(f"{c}_mean") for c in columns), *(F.max(c).alias(f"{c}_max") for c in columns), F.max("_g").alias("gate_max"), entropy.alias("gate_entropy"))


def gated_bag_model(episodes: DataFrame, pairs: DataFrame, features: Sequence[str], keys: Sequence[str] = ("lo", "hi")) -> DataFrame:
    """A detector of episodes gates their features into a bag for each pair, and a pair model reads the bags. episodes: keys, fold, y (null where unknown), features; pairs: keys, fold, label."""
    gated = cross_fit(episodes, LogisticRegression(regParam=0.05), features, label="y", out="_gate")
    bags = attention_bag(gated, "_gate", features, keys)
    names = [c for c in bags.columns if c not in keys]
    # each fold reads the bags several times to fit, and they take the detector's models and two windows
    return cross_fit(kept(pairs.join(bags, list(keys))), LogisticRegression(regParam=0.01), names, standardize=True).select(*pairs.columns, "score")


def pairwise_rerank(candidates: DataFrame, features: Sequence[str], keys: Sequence[str] = ("lo", "hi"), most: int = 20) -> DataFrame:
    """Candidates (keys, fold, episode, y, r, features) with a score by a logistic model of differences between a listed and an unlisted one of its group.

    A difference weighs what swapping the two changes of the precision at five. Only the first `most` of a group are compared, so it gives at most most * most / 4 pairs. The score is the model's weights
    on the features; the fold's own rows don't train.
    """
    few = candidates.where(F.col("r") <= most)
    a, b = few.where("y = 1").alias("a"), few.where("y = 0").alias("b")
    gain = lambda r: F.when(r <= 5, 1.0 / r).otherwise(0.0)
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    up = a.join(b, same).select(F.col("a.fold").alias("fold"), F.abs(gain(F.col("a.r")) - gain(F.col("b.r"))).alias("w"), *((F.col(f"a.{f}") - F.col(f"b.{f}")).alias(f) for f in features)).where("w > 0")
    both = up.withColumn("label", F.lit(1)).unionByName(up.select("fold", "w", *((-F.col(f)).alias(f) for f in features)).withColumn("label", F.lit(0)))
    parts = []
    for k in _folds(few, "fold"):
        train, test = both.where(F.col("fold") != k).na.fill(0.0), few.where(F.col("fold") == k)
        if train.isEmpty():
            parts.append(test.withColumn("score", F.lit(0.0)))
            continue
        assembled = VectorAssembler(inputCols=list(features), outputCol="features").transform(train)
        fitted = LogisticRegression(weightCol="w", regParam=0.05, fitIntercept=False).fit(assembled)
        weights = fitted.coefficients.toArray().tolist()
        parts.append(test.withColumn("score", sum((F.lit(w) * F.coalesce(F.col(f), F.lit(0.0)) for w, f in zip(weights, features, strict=True)), F.lit(0.0))))
    return reduce(DataFrame.unionByName, parts)


def seed_expand(pairs: DataFrame, statistic: str, features: Sequence[str], top: float = 0.02, keys: Sequence[str] = ("lo", "hi")) -> DataFrame:
    """Pairs of a high statistic are seeds, against pairs of a low one and known negatives; a model that doesn't see the statistic scores all, out of fold.

    Returns for the highest scorers that are not seeds (as many as seeds), and for all others, how many there are and their mean statistic: a real kind of pair has it elevated among the first.
    """
    if statistic in features:
        raise ValueError(f"{statistic} can't be a feature of its own expansion")
    high, low = pairs.approxQuantile(statistic, [1 - top, 0.5], 0.001)
    seeded = pairs.withColumn("_seed", F.when(F.col(statistic) > high, 1).when((F.col(statistic) <= low) | (F.col("label") == 0), 0))
    scored = kept(cross_fit(seeded, LogisticRegression(regParam=0.01), features, label="_seed", out="_score"))
    edge = scored.where("_seed is distinct from 1").approxQuantile("_score", [1 - top], 0.001)[0]
    group = F.when(F.col("_seed") == 1, "seed").when(F.col("_score") > edge, "expanded").otherwise("rest")
    return scored.groupBy(group.alias("kind")).agg(F.count(F.lit(1)).alias("pairs"), F.avg(statistic).alias("mean_statistic"), F.avg("_score").alias("mean_score"))


def fit_views(pairs: DataFrame, features: Sequence[str], families: Sequence[int], seeds: Sequence[int] = _VIEWS, share: float = 0.5, model: Estimator | None = None) -> DataFrame:
    """For each family an out-of-fold score of pairs, the mean over models that see the columns of one seed each.

    pairs: fold, label, family, features. A family's positives are the target; other families' positives have weight 0 and so neither train nor count as negatives; rows without a label train as negatives
    of weight 0.5. Returns pairs once for each family, with target and score.
    """
    model = model or LogisticRegression(regParam=0.01)
    parts = []
    for family in families:
        own, positive = F.col("family") == family, F.coalesce(F.col("label") == 1, F.lit(False))
        rows = pairs.withColumns({"target": F.lit(family), "_y": (positive & own).cast("int"), "_w": F.when(positive & ~F.coalesce(own, F.lit(False)), 0.0).when(F.col("label").isNull(), 0.5).otherwise(1.0)})
        names = [f"_v{s}" for s in seeds]
        rows = cross_fits(rows, {name: (model, column_subset(features, s, share)) for name, s in zip(names, seeds, strict=True)}, label="_y", weight="_w", standardize=True)
        parts.append(rows.withColumn("score", sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)).drop("_y", "_w", *names))
    return reduce(DataFrame.unionByName, parts)


def nn_pu_logistic(df: DataFrame, features: Sequence[str], priors: Sequence[float] = (0.1,), rounds: int = 30, rate: float = 0.1, decay: tuple[float, float] = (0.9, 0.999)) -> list[list[float]]:
    """K9: for each prior the weights, and last the intercept, of a logistic model under the non-negative risk for positives (label 1) and unlabelled rows.

    Features should be standardised. Each round is one aggregate over the rows for all priors together: mean gradients and the negative risk of each. A negative risk
    below 0 is stepped back from. Steps are Adam's, with running means of the gradient and its square. The number of rounds is fixed. No rows give weights of 0.
    """
    rows = df.select(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(features)), (F.coalesce(F.col("label"), F.lit(0)) == 1).alias("pos"))
    xs = [F.col(f"x{i}") for i in range(len(features))] + [F.lit(1.0)]
    k = len(xs)
    pos, un = F.col("pos"), ~F.col("pos")
    mean = lambda cond, e: F.coalesce(F.avg(F.when(cond, e)), F.lit(0.0))
    weights, first, second = ([[0.0] * k for _ in priors] for _ in range(3))
    for t in range(1, rounds + 1):
        sums = []
        for w in weights:
            odds: Column = sum((F.lit(a) * x for a, x in zip(w, xs, strict=True)), F.lit(0.0))
            p, loss = 1 / (1 + F.exp(-odds)), F.log1p(F.exp(F.least(odds, F.lit(50.0))))
            sums += [mean(un, loss), mean(pos, loss), *(mean(pos, (p - 1) * x) for x in xs), *(mean(un, p * x) for x in xs), *(mean(pos, p * x) for x in xs)]
        got = rows.agg(*(x.alias(f"s{i}") for i, x in enumerate(sums))).first()
        for j, prior in enumerate(priors):
            own = got[j * (2 + 3 * k) : (j + 1) * (2 + 3 * k)]
            g_pos, g_un, g_pn = own[2 : 2 + k], own[2 + k : 2 + 2 * k], own[2 + 2 * k :]
            negative = [u - prior * v for u, v in zip(g_un, g_pn, strict=True)]
            step = [prior * a + b for a, b in zip(g_pos, negative, strict=True)] if own[0] >= prior * own[1] else [-b for b in negative]
            first[j] = [decay[0] * m + (1 - decay[0]) * g for m, g in zip(first[j], step, strict=True)]
            second[j] = [decay[1] * v + (1 - decay[1]) * g * g for v, g in zip(second[j], step, strict=True)]
            each = zip(weights[j], first[j], second[j], strict=True)
            weights[j] = [w - rate * (m / (1 - decay[0] ** t)) / ((v / (1 - decay[1] ** t)) ** 0.5 + 1e-8) for w, m, v in each]
    return weights


def pu_prior_grid(df: DataFrame, features: Sequence[str], priors: Sequence[float] = (0.05, 0.1, 0.2), rounds: int = 30) -> DataFrame:
    """K9 for several priors: prior, feature and weight of standardised features, the last one the intercept; one row for each of a few."""
    stats = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(features)), *(F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(f"s{i}") for i, c in enumerate(features))).first()
    rows = kept(df.select("label", *(((F.col(c) - stats[f"m{i}"]) / (stats[f"s{i}"] + 1e-6)).alias(c) for i, c in enumerate(features))))
    found = [(p, name, float(x)) for p, w in zip(priors, nn_pu_logistic(rows, features, priors, rounds), strict=True) for name, x in zip([*features, "intercept"], w, strict=True)]
    return df.sparkSession.createDataFrame(found, "prior double, feature string, weight double")


def domain_classifier(a: DataFrame, b: DataFrame, features: Sequence[str], folds: int = 3) -> DataFrame:
    """Out-of-fold chance that a row is of b rather than a; where the two are alike it is near b's share for all."""
    both = a.select(*features).withColumn("label", F.lit(0)).unionByName(b.select(*features).withColumn("label", F.lit(1)))
    return cross_fit(both.withColumn("fold", F.pmod(F.xxhash64(*features), F.lit(folds)).cast("int")), LogisticRegression(regParam=0.01), features)


def domain_report(a: DataFrame, b: DataFrame, features: Sequence[str]) -> DataFrame:
    """How well a from b is told, as areas under the curve: by the classifier (feature "all"), by the classifier without each feature (without), and by each feature alone (alone)."""
    area = lambda df, c: BinaryClassificationEvaluator(rawPredictionCol=c, labelCol="label").evaluate(df)
    scored = kept(domain_classifier(a, b, features))
    out = [("all", area(scored, "score"), None)]
    for c in features:
        rest = [f for f in features if f != c]
        filled = scored.withColumn("_x", F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
        out.append((c, area(filled, "_x"), area(domain_classifier(a, b, rest), "score") if rest else None))
    return a.sparkSession.createDataFrame(out, "feature string, alone double, without double")


def pair_comparator(candidates: DataFrame, features: Sequence[str], keys: Sequence[str] = ("lo", "hi"), most: int = 20) -> DataFrame:
    """Expected wins of each candidate (keys, fold, episode, y, r, features) against the others of its group, by a logistic model of differences in features and ranks that was fitted on the other folds.

    r is a rank within the group; only the first `most` are compared, so a group gives at most most * (most - 1) rows. A group lies in one fold.
    """
    by = Window.partitionBy(*keys)
    few = candidates.where(F.col("r") <= most).withColumns({f"{f}_rank": F.rank().over(by.orderBy(f)) / F.count(F.lit(1)).over(by) for f in features})
    features = [*features, *(f"{f}_rank" for f in features)]
    a, b = few.alias("a"), few.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]) & (F.col("a.episode") != F.col("b.episode"))
    pairs = a.join(b, same).select(*(F.col(f"a.{k}").alias(k) for k in keys), F.col("a.fold").alias("fold"), F.col("a.episode").alias("episode"), F.when(F.col("a.y") != F.col("b.y"), (F.col("a.y") > F.col("b.y")).cast("int")).alias("label"), *((F.col(f"a.{f}") - F.col(f"b.{f}")).alias(f) for f in features))
    scored = cross_fit(kept(pairs), LogisticRegression(regParam=0.05, fitIntercept=False), features, out="_beats")
    alone = few.select(*keys, "episode").join(scored.groupBy(*keys, "episode").agg(F.sum("_beats").alias("wins")), [*keys, "episode"], "left")
    return alone.withColumn("wins", F.coalesce("wins", F.lit(0.0)))  # a candidate without others wins nothing


def _table(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation as a written table: models read it once for each fold."""
    from tandem import catalog

    return kept(catalog.relations().frame(spark, f"SELECT * FROM {{{name}}}", catalog.Tables(spark, sf_dir)))


_EPISODE = ("f_score", "f_lean", "f_s_lo", "f_s_hi")
_DECISION = ("stage", "facing", "cost", "odds", "active", "pushes_before", "own_pushes_before", "strength", "own_no")
_CONTEXT = ("f_s_lo", "f_s_hi", "f_put", "f_players", "f_stayed")
_FEW = ("pool", "lo", "hi", "label", "fold")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table("episode_table", spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("lo", "hi").orderBy(F.col("f_score").desc(), "episode")))


def _two_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table("window_table", spark, sf_dir)
    first, second = rows.where("win = 'development'"), rows.where("win = 'evaluation'")
    return cross_fit(first, LogisticRegression(regParam=0.01), ("f_score", "f_top", "f_log_n"), other=second).select("pool", "win", "lo", "hi", "label", "fold", "score")


def _domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table("window_table", spark, sf_dir)
    return domain_report(rows.where("win = 'development'"), rows.where("win = 'evaluation'"), ("f_score", "f_top", "f_log_n"))


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated_bag_model(_table("all_episodes", spark, sf_dir), _table("pair_folds", spark, sf_dir), _EPISODE).select(*_FEW, "score")


QUERIES = {
    "cross_fit": _two_windows,
    "fit_action_policy": lambda spark, d: fit_action_policy(_table("decision_table", spark, d), _DECISION).select("episode", "ordinal", "act", "fold", "q_exit", "q_hold", "q_match", "q_push"),
    "fit_pair_risk": lambda spark, d: fit_pair_risk(_table("risk_table", spark, d), (*_PAIR, *_BLOCKS)).select(*_FEW, "risk"),
    "fit_views": lambda spark, d: fit_views(_table("risk_table", spark, d), (*_PAIR, *_BLOCKS), (0, 1, 2), (1, 2)).select(*_FEW, "target", "score"),
    "fit_family": lambda spark, d: fit_family(_table("pair_table", spark, d), _PAIR).select(*_FEW, "predicted_family"),
    "fit_episode_detector": lambda spark, d: fit_episode_detector(_table("episode_table", spark, d), _EPISODE, GBTClassifier(maxIter=8, maxDepth=3, stepSize=0.1, seed=3)).select("lo", "hi", "episode", "y", "hard_negative", "score"),
    "route_experts": lambda spark, d: route_experts(_table("episode_table", spark, d), _EPISODE, model=GBTClassifier(maxIter=8, maxDepth=3, stepSize=0.1, seed=3)).select("lo", "hi", "episode", "y", "universal", "routed", "score"),
    "nn_pu_logistic": lambda spark, d: pu_prior_grid(_table("pair_table", spark, d), _PAIR),
    "leave_one_family_out": lambda spark, d: leave_one_family_out(_table("pair_table", spark, d), _PAIR).select(*_FEW, "hidden_family", "score", F.round("ap", 8).alias("ap")),
    "value_residual": lambda spark, d: value_residual(_table("all_episodes", spark, d), "f_score", _CONTEXT),
    "gated_bag_model": _gated,
    "pairwise_rerank": lambda spark, d: pairwise_rerank(_candidates(spark, d), _EPISODE).select("lo", "hi", "episode", "y", "r", "score"),
    "domain_classifier": _domains,
    "pair_comparator": lambda spark, d: pair_comparator(_candidates(spark, d), _EPISODE),
    "seed_expand": lambda spark, d: seed_expand(_table("pair_table", spark, d), "f_top", ("f_score", "f_log_n", "f_lo_hi", "f_hi_lo")),
}
_NAMES = ", ".join(f"('{c}')" for c in _PAIR)
ORACLES = {
    "feature_views": f"""
WITH k AS (SELECT view, name, row_number() OVER (PARTITION BY view ORDER BY md5(name || '-' || CAST(view AS VARCHAR))) AS r FROM (VALUES {_NAMES}) AS c(name) CROSS JOIN (VALUES {", ".join(f"({v})" for v in _VIEWS)}) AS v(view)),
g AS (SELECT view, {", ".join(f"max(CASE WHEN name = '{c}' THEN r END) AS r_{c}" for c in _PAIR)} FROM k GROUP BY view)
SELECT lo, hi, view, {", ".join(f"CASE WHEN r_{c} <= 2 THEN round({c}, 6) END AS {c}" for c in _PAIR)} FROM {{pair_table}} CROSS JOIN g""",
}
