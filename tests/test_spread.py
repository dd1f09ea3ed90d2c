"""Steps that must not bring many rows to one task, send rows more often than needed, or nest one model's plan in the next one's."""

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tandem import catalog
from tandem.operators import learning, pairs
from tandem.operators.mixtures import class_llrs

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def leaves(df):
    return sum("LogicalRDD" in line or "Relation [" in line or "Range (" in line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines())


@pytest.fixture
def rows(spark):
    x = spark.range(120).select((F.col("id") % 3).cast("int").alias("fold"), F.col("id").alias("lo"), *(((F.col("id") * k) % 11).cast("double").alias(c) for c, k in (("a", 3), ("b", 7))))
    return x.withColumns({"label": (F.col("a") + F.col("lo") % 2 > 5).cast("int"), "family": (F.col("lo") % 2).cast("int")})


def test_several_models_are_fitted_beside_one_another(rows):
    model = LogisticRegression(regParam=0.01)
    found = learning.cross_fits(rows, {"s": (model, ("a",)), "t": (model, ("a", "b"))}, standardize=True)
    assert leaves(found) == 3
    each = {name: {r["lo"]: r[name] for r in found.collect()} for name in ("s", "t")}
    for name, features in (("s", ("a",)), ("t", ("a", "b"))):
        alone = learning.cross_fit(rows, model, features, standardize=True, out=name)
        assert each[name] == pytest.approx({r["lo"]: r[name] for r in alone.collect()}, abs=1e-9)


def test_views_have_a_part_for_each_family_and_fold(rows):
    assert leaves(learning.fit_views(rows, ("a", "b"), (0, 1), (1, 2))) == 6


def test_ranks_of_several_scores_do_not_nest(rows):
    assert leaves(learning.ranked_each(rows, {"a": "ra", "b": "rb", "lo": "rl"}, 10)) <= 4
    one = {r["lo"]: r["ra"] for r in learning.ranked(rows, "a", "ra", 10).collect()}
    assert one == {r["lo"]: r["ra"] for r in learning.ranked_each(rows, {"a": "ra", "b": "rb"}, 10).collect()}


def test_frequent_scores_stay_where_they_lie(spark):
    scores = spark.createDataFrame([(0, 1, 2, e, 0.0 if e < 90 else float(e), 0, 1) for e in range(100)], "pool int, lo int, hi int, episode int, score double, label int, family int")
    counts = spark.createDataFrame([(0.0, 90, 90, 100)] + [(float(e), 1, e + 1, 100) for e in range(90, 100)], "score double, c long, upto long, c_all long")
    frame = lambda sql: scores if "labelled" in sql else counts
    found = {slot: sorted(map(tuple, pairs._tails(frame, slot).collect())) for slot in (4, 1000)}
    assert found[4] == found[1000] and len(found[4]) == 100
    assert "left_anti" in pairs._tails.__code__.co_consts and "BroadcastHashJoin" in plan_of(pairs._tails(frame, 4))


def test_grids_do_not_multiply_episodes(spark):
    plan = plan_of(catalog.queries()["mixture_lr_bag"](spark, FOLDER))
    assert "rate" not in "".join(line for line in plan.splitlines() if "NestedLoop" in line or "LocalTableScan" in line)


def test_exposures_are_not_sent_by_exposure(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(catalog.queries()["pair_bayes_factor"](spark, FOLDER))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("BroadcastHashJoin") >= 2 and "SortMergeJoin [exposure" not in plan


def test_a_pair_is_one_row_of_classes(spark):
    frame = lambda sql: catalog.relations().frame(spark, sql, catalog.Tables(spark, FOLDER))
    bags = frame("SELECT * FROM {class_bags}")
    assert bags.count() == bags.select("lo", "hi").distinct().count()
    assert bags.agg(F.sum(F.aggregate("codes", F.lit(0).cast("long"), lambda s, x: s + x["n"]))).first()[0] == frame("SELECT * FROM {toward}").count()
    assert "Exchange" not in plan_of(catalog.queries()["class_mixture_llr"](spark, FOLDER))


def test_who_is_in_no_pool_counts_nowhere(spark):
    bags = spark.createDataFrame([(1, 2, [(0, 3), (64, 5)], 0, None), (3, 4, [(64, 1)], 0, None)], "lo long, hi long, codes array<struct<code int, n long>>, fold_lo int, fold_hi int")
    got = class_llrs(bags, spark.createDataFrame([(i, float(i // 64)) for i in range(576)], "at int, l double")).orderBy("family").collect()
    assert [tuple(r) for r in got] == [(1, 2, k, 3, 3.0 * k, 3.0 * k, 3.0 * k) for k in range(3)]


def test_blocks_of_the_risk_table_share_what_they_read(spark):
    relations = catalog.relations()
    plain = relations.frame(spark, relations.definitions["risk_table"], catalog.Tables(spark, FOLDER))
    reads = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey")
    assert reads(catalog.queries()["risk_table"](spark, FOLDER)) * 4 <= reads(plain)


def test_bags_are_made_once(spark, monkeypatch):
    episodes = spark.range(240).selectExpr("id % 30 AS lo", "id % 30 + 1 AS hi", "CAST(id % 3 AS INT) AS fold", "CAST(CASE WHEN id % 5 < 4 THEN id * 7 % 11 > 5 END AS INT) AS y", "CAST(id * 3 % 13 AS DOUBLE) AS a")
    found = episodes.selectExpr("lo", "hi", "fold", "CAST(lo % 2 AS INT) AS label").distinct()
    written, kept = [], learning.kept
    monkeypatch.setattr(learning, "kept", lambda df: written.append(df.columns) or kept(df))
    assert learning.gated_bag_model(episodes, found, ("a",)).count() == 30
    assert len(written) == 1 and "gate_entropy" in written[0]


def test_pairs_of_the_gated_model_need_no_look_at_events(spark):
    frame = lambda name: catalog.relations().frame(spark, f"SELECT pool, lo, hi, label, fold FROM {{{name}}}", catalog.Tables(spark, FOLDER))
    few, whole = frame("pair_folds"), frame("pair_table")
    assert sorted(few.collect()) == sorted(whole.collect()) and "last_value" not in plan_of(few)


def test_risk_table_reads_what_its_blocks_share_once(spark, monkeypatch):
    plans, keep = [], learning.kept
    monkeypatch.setattr(learning, "kept", lambda df: plans.append(plan_of(df)) or keep(df))
    rows = catalog.queries()["risk_table"](spark, FOLDER)
    assert sum("lineitem" in p for p in [*plans, plan_of(rows)]) == 4  # pairs' episodes, their scores, counts toward partners, and how many episodes a member has
    assert len(rows.collect()) == spark.sql("SELECT * FROM {t}", t=catalog.relations().frame(spark, "SELECT * FROM {pair_labels}", catalog.Tables(spark, FOLDER))).count()
