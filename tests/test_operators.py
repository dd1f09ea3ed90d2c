"""Operators with an interface of their own: folds by enumeration, contracts, streams, sinks, models."""

import itertools
import random

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tandem.operators import contracts, decoders, learning, metrics
from tandem.plans.relations import Relations
from tandem.sources.sinks import write_features, write_result_csv
from tandem.sources.tables import Tables
from tandem.streaming import causal


@pytest.fixture(scope="module")
def chances(spark):
    rng = random.Random(2)
    rows = [(lo, 9, e, e * 7 % 11, rng.choice([0.05, 0.3, 0.6, 0.9])) for lo, n in ((1, 8), (2, 1), (3, 4)) for e in range(n)]
    return rows, spark.createDataFrame(rows, "lo long, hi long, episode long, ts long, p double")


def patterns(rows):
    """Every outcome of a pair's episodes in time order, with its chance."""
    rows = sorted(rows, key=lambda r: (r[3], r[2]))
    for on in itertools.product((0, 1), repeat=len(rows)):
        chance = 1.0
        for y, r in zip(on, rows, strict=True):
            chance *= r[4] if y else 1 - r[4]
        yield chance, on, [r[2] for r in rows]


@pytest.mark.parametrize("k", [1, 2, 5])
def test_first_k_by_enumeration(chances, k):
    rows, df = chances
    got = {(r["lo"], r["episode"]): r["decoded"] for r in decoders.first_k_marginal(df, k).collect()}
    cond = {(r["lo"], r["episode"]): r["decoded"] for r in decoders.first_k_given_at_least_k(df, k).collect()}
    for lo in (1, 2, 3):
        own = [r for r in rows if r[0] == lo]
        for e in {r[2] for r in own}:
            first = lambda on, ids, e=e: on[ids.index(e)] and sum(on[: ids.index(e)]) < k
            assert got[lo, e] == pytest.approx(sum(c for c, on, ids in patterns(own) if first(on, ids)))
            enough = sum(c for c, on, _ in patterns(own) if sum(on) >= k)
            if enough > 0:
                assert cond[lo, e] == pytest.approx(sum(c for c, on, ids in patterns(own) if first(on, ids) and sum(on) >= k) / enough, abs=1e-9)


def test_expected_ap_by_enumeration(chances):
    rows, df = chances
    got = {r["lo"]: r["expected_ap"] for r in decoders.expected_ap(df, 3).collect()}
    for lo in (1, 2, 3):
        own = [r for r in rows if r[0] == lo]
        best = [r[2] for r in sorted(own, key=lambda r: (-r[4], r[2]))[:3]]
        total = 0.0
        for c, on, ids in patterns(own):
            hits = [on[ids.index(e)] for e in best]
            total += c * sum(sum(hits[: i + 1]) / (i + 1) for i, h in enumerate(hits) if h)
        assert got[lo] == pytest.approx(total / min(sum(r[4] for r in own), 3))


def test_mass_normalize(chances):
    rows, df = chances
    got = decoders.mass_normalize(df, 2.0).groupBy("lo").agg(F.sum("p").alias("m")).collect()
    assert {r["lo"]: round(r["m"], 6) for r in got} == {1: 2.0, 2: 0.999, 3: 2.0}


def test_partitioning_does_not_matter(chances):
    _, df = chances
    key = lambda d: sorted(map(tuple, decoders.first_k_marginal(d, 3).collect()))
    assert key(df.repartition(1)) == key(df.repartition(16))


def test_average_precision_ties(spark):
    rows = [("g", 1, 1, 0.5), ("g", 2, 0, 0.5), ("g", 3, 1, 0.4), ("h", 1, None, 0.3)]
    got = metrics.average_precision(spark.createDataFrame(rows, "pool string, id long, label int, score double"), "label", "score", ("id",), ("pool",)).collect()
    assert {r["pool"]: r["ap"] for r in got} == {"g": pytest.approx((1 + 2 / 3) / 2), "h": 0.0}


GOOD = [("a", 0.5, "x", "e1", "e2"), ("b", 1.0, "y", "e3", "NO_EVIDENCE"), ("c", 0.0, "x", "NO_EVIDENCE", "NO_EVIDENCE")]
COLUMNS = ["pair_id", "risk", "behavior", "evidence_1", "evidence_2"]


@pytest.mark.parametrize(
    ("rows", "name"),
    [
        (GOOD, None),
        ([("a", 1.5, "x", "e1", "e2"), *GOOD[1:]], "risk"),
        ([("a", float("nan"), "x", "e1", "e2"), *GOOD[1:]], "risk"),
        ([("a", 0.5, "z", "e1", "e2"), *GOOD[1:]], "behavior"),
        ([("a", 0.5, "x", "e1", "e1"), *GOOD[1:]], "repeated"),
        ([("a", 0.5, "x", " ", "e1"), *GOOD[1:]], "blank"),
        ([("a", 0.5, "x", None, "e1"), *GOOD[1:]], "null"),
        ([GOOD[0], *GOOD], "doubled"),
        (GOOD[1:], "missing"),
        ([*GOOD, ("d", 0.5, "x", "e1", "e2")], "unexpected"),
    ],
)
def test_result_contract(spark, rows, name):
    df = spark.createDataFrame(rows, "pair_id string, risk double, behavior string, evidence_1 string, evidence_2 string")
    wanted = spark.createDataFrame(GOOD, df.schema)
    found = {r["name"]: r["failed"] for r in contracts.validate_result(df, COLUMNS, "pair_id", "risk", "behavior", ["x", "y"], COLUMNS[3:], wanted).collect()}
    assert {n for n, k in found.items() if k} == ({name} if name else set())


def test_contracts_raise(spark):
    a = spark.createDataFrame([(1, 2.0), (2, None)], "k long, f_x double")
    with pytest.raises(contracts.ContractError):
        contracts.require_features(a, ["f_y"])
    with pytest.raises(Exception, match="not finite"):
        contracts.require_features(a, ["f_x"]).collect()
    with pytest.raises(contracts.ContractError):
        contracts.checked_join(a, a.union(a), ["k"])
    with pytest.raises(contracts.ContractError):
        contracts.checked_join(a, a.where("k = 1"), ["k"])
    with pytest.raises(contracts.ContractError):
        contracts.window_safe_join(a, a)
    assert contracts.checked_join(a, a.select("k", F.lit(1).alias("z")), ["k"], one_to_one=True).count() == 2
    assert contracts.fingerprint(a.repartition(5)).collect() == contracts.fingerprint(a).collect()
    assert tuple(contracts.run_receipt(a, a.withColumn("f_x", F.lit(2.0)), ["k"], ["f_x"]).first()) == (2, 2, 1)


def test_cross_fit_keeps_rows_and_hides_the_fold(spark):
    rng = random.Random(1)
    rows = [(i, i % 3, int(x > 0.5) if i % 5 else None, x) for i in range(150) for x in [rng.random()]]
    df = spark.createDataFrame(rows, "id long, fold int, label int, f double")
    out = learning.cross_fit(df, LogisticRegression(), ["f"])
    assert out.count() == 150 and out.columns == [*df.columns, "score"]
    assert out.where("label is not null").where((F.col("score") > 0.5) == (F.col("label") == 1)).count() > 100
    one = learning.cross_fit(df.withColumn("label", F.when(F.col("fold") == 0, F.lit(1)).otherwise(F.lit(0))), LogisticRegression(), ["f"])
    assert [r["score"] for r in one.where("fold = 0").select("score").distinct().collect()] == [0.0]


def test_nn_pu_logistic_separates(spark):
    rng = random.Random(4)
    rows = [(1 if y and rng.random() < 0.5 else 0, rng.gauss(1.5 if y else -0.5, 0.7)) for y in [rng.random() < 0.3 for _ in range(400)]]
    w = learning.nn_pu_logistic(spark.createDataFrame(rows, "label int, f double"), ["f"], (0.2,), 15)[0]
    assert len(w) == 2 and w[0] > 0.3


def test_cluster_bootstrap_is_fixed(spark):
    rows = [(p, p, 9 + y, y, p / 10 + y) for p in range(6) for y in (0, 1)]
    df = spark.createDataFrame(rows, "pool long, lo long, hi long, label int, score double")
    run = lambda d: {r["measure"]: tuple(r)[1:] for r in metrics.cluster_bootstrap(d, 50).collect()}
    got = run(df)
    assert got == run(df.repartition(7))
    _, mean, low, high, above = got["gap"]
    assert low <= mean <= high and above == 1.0
    assert got["ap"][1:4] == (1.0, 1.0, 1.0)  # every pool's positive stands first


def test_learners_on_a_plain_case(spark):
    rng = random.Random(12)
    rows = [(i % 3, i, i + 1, i, int(x > 0.6), x, rng.random(), rng.random()) for i in range(240) for x in [rng.random()]]
    df = spark.createDataFrame(rows, "fold int, lo long, hi long, episode long, label int, a double, b double, c double")
    auc = lambda d, c: sum((p[c] > n[c]) + 0.5 * (p[c] == n[c]) for p in d if p["label"] for n in d if not n["label"]) / (sum(r["label"] for r in d) * sum(1 - r["label"] for r in d))
    assert auc(learning.fit_pair_risk(df, ("a", "b"), (1,), 2, 2, 3, 50).collect(), "risk") > 0.9
    rest = learning.value_residual(df.withColumn("v", F.expr("3 * b + IF(lo = 7, 5, 0)")), "v", ("b",)).orderBy(F.col("value").desc()).first()
    assert rest["lo"] == 7 and rest["value"] > 4
    found = {r["kind"]: r["mean_statistic"] for r in learning.seed_expand(df.withColumn("s", F.expr("a + 0.05 * c")), "s", ("a", "b"), 0.1).collect()}
    assert found["seed"] > found["expanded"] > found["rest"]
    with pytest.raises(ValueError):
        learning.seed_expand(df, "a", ("a",))
    report = {r["feature"]: r for r in learning.domain_report(df.where("a < 0.5"), df.where("a >= 0.5"), ("a", "b")).collect()}
    assert report["a"]["alone"] > 0.99 and report["a"]["without"] < 0.7 < report["all"]["alone"]
    groups = df.withColumn("g", F.col("lo") % 12).selectExpr("g AS lo", "g AS hi", "fold", "episode", "label AS y", "a", "b", "1 AS label").withColumn("r", F.expr("row_number() over (partition by lo order by b)"))
    best = learning.pairwise_rerank(groups, ("a", "b")).groupBy("lo").agg(F.max_by("y", "score").alias("y")).agg(F.avg("y")).first()[0]
    assert best > 0.9
    assert learning.column_subset(("a", "b", "c", "d"), 1) == learning.column_subset(("d", "c", "b", "a"), 1)


def test_pu_learner_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x, pos = rng.normal(size=(300, 2)), rng.random(300) < 0.2
    x[pos] += 1.0
    df = spark.createDataFrame([(1 if p else None, float(a), float(b)) for p, (a, b) in zip(pos, x, strict=True)], "label int, a double, b double")
    full, sigmoid = np.c_[x, np.ones(300)], lambda z: 1 / (1 + np.exp(-z))
    for prior, got in zip((0.05, 0.4), learning.nn_pu_logistic(df, ("a", "b"), (0.05, 0.4), 12), strict=True):
        w, m, v = np.zeros(3), np.zeros(3), np.zeros(3)
        for t in range(1, 13):
            p, loss = sigmoid(full @ w), np.log1p(np.exp(full @ w))
            negative = (p[:, None] * full)[~pos].mean(0) - prior * (p[:, None] * full)[pos].mean(0)
            g = prior * ((p - 1)[:, None] * full)[pos].mean(0) + negative if loss[~pos].mean() >= prior * loss[pos].mean() else -negative
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        assert np.allclose(got, w, atol=1e-9)


def test_comparator_is_fold_safe_and_families_are_left_out(spark):
    rng = random.Random(8)
    rows = [(g % 3, g, g, e, int(e < 2), (1.0 if e < 2 else 0.0) * (-1 if g % 3 == 0 else 1) + rng.random() * 0.1, e + 1) for g in range(24) for e in range(5)] + [(0, 99, 99, 0, 1, 0.5, 1)]
    df = spark.createDataFrame(rows, "fold int, lo long, hi long, episode long, y int, a double, r int")
    wins = {(r["lo"], r["episode"]): r["wins"] for r in learning.pair_comparator(df, ("a",)).collect()}
    assert len(wins) == len(rows) and wins[99, 0] == 0.0
    mean = lambda k, good: sum(w for (g, e), w in wins.items() if g % 3 == k and g < 99 and (e < 2) == good) / sum(1 for (g, e) in wins if g % 3 == k and g < 99 and (e < 2) == good)
    assert mean(0, True) < mean(0, False)  # fold 0 is the other way round, and its own rows didn't train its model
    pairs = spark.createDataFrame([(i % 3, i, i + 1, i // 4 % 2, int(i % 4 == 0), (i % 4 == 0) + rng.random() * 0.5) for i in range(120)], "fold int, lo long, hi long, family int, label int, a double")
    left = learning.leave_one_family_out(pairs, ("a",))
    by = {r["hidden_family"]: (r["aps"], r["ap"], r["positives"]) for r in left.groupBy("hidden_family").agg(F.count_distinct("ap").alias("aps"), F.max("ap").alias("ap"), F.sum("label").alias("positives")).collect()}
    assert by == {0: (1, 1.0, 15), 1: (1, 1.0, 15)}


def test_running_state_stream_equals_table(spark, tmp_path):
    rows = [(i, i % 3, float(i * i % 17)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, value double").withColumn("ts", (F.lit(1_700_000_000) + F.col("event_id") * 60).cast("timestamp"))
    for k in range(3):
        df.where((F.col("event_id") >= 20 * k) & (F.col("event_id") < 20 * k + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = causal.running_state(stream).writeStream.format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["event_id"]: (r["last_sum"], r["last_value"], r["seen"]) for r in spark.table("running").collect()}
    for i, u, _ in rows:
        before = [v for j, w, v in rows if w == u and j < i]
        assert got[i] == (sum(before[-10:]), before[-1] if before else None, len(before))
    table = causal.sessions(df, gap="2 minutes").agg(F.sum("n"), F.count(F.lit(1))).first()
    assert tuple(table) == (60, 60)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(3, "e", None), (1, None, "f"), (2, "g", "h")], "id long, a string, b string")
    write_result_csv(df, str(tmp_path / "csv"), ["id", "b", "a"], ["id"], ["a", "b"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part-*")))
    assert [line for line in text.splitlines() if line[0] != "i"] == ["1,f,NO_EVIDENCE", "2,h,g", "3,NO_EVIDENCE,e"]
    write_features(df, str(tmp_path / "pq"), by=["id"])
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 3
    with pytest.raises(ValueError):
        Tables(spark, str(tmp_path), "csv")["orders"]


def test_relations_replace_and_order(spark):
    r = Relations({"a": "SELECT 1 AS x", "b": "SELECT x + 1 AS x FROM {a}"})
    assert r.text("SELECT * FROM {b}") == "WITH a AS (SELECT 1 AS x), b AS (SELECT x + 1 AS x FROM a) SELECT * FROM b"
    assert r.frame(spark, "SELECT * FROM {b}", {}).first()["x"] == 2
    assert r.frame(spark, "SELECT * FROM {b}", {"a": spark.range(5, 6).select(F.col("id").alias("x"))}).first()["x"] == 6
