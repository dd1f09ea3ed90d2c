"""The class mixture against NumPy, oracles and reweighted exposures against values worked out by hand, and models of column views."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem import catalog
from tandem.operators import learning, metrics, mixtures

ACTS = ("exit", "hold", "match", "push")


def _cells(seed, empty=False):
    rng = np.random.default_rng(seed)
    rows = []
    for fold in (0, 1):
        z = rng.dirichlet(np.ones(4), 4)
        for own in range(4):
            for partner in range(4):
                for k, act in enumerate(ACTS):
                    rows.append((fold, 0, own, partner, act, 0.0 if empty else float(rng.integers(0, 40) * (rng.random() < 0.7)), float(z[own, k])))
    return rows


def _em(rows, rounds, start=0.3):
    own, partner, act = (np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), np.array([ACTS.index(r[4]) for r in rows]))
    n, z = np.array([r[5] for r in rows]), np.array([r[6] for r in rows])

    def shares(g):
        q = np.full((4, 4), 0.5)
        np.add.at(q, (partner, act), g)
        return q / q.sum(1, keepdims=True)

    alpha, q, seen = start, shares(n), []
    for _ in range(rounds):
        p = (1 - alpha) * z + alpha * q[partner, act]
        seen.append((n * np.log(p)).sum() + 0.5 * np.log(q).sum() + 0.5 * np.log(alpha) + 0.5 * np.log(1 - alpha))
        g = n * alpha * q[partner, act] / p
        alpha, q = (g.sum() + 0.5) / (n.sum() + 1), shares(g)
    return alpha, q, seen


@pytest.mark.parametrize("rounds", [1, 20])
def test_class_mixture_equals_numpy_and_window_sums(spark, rounds):
    rows = _cells(rounds)
    schema = "fold int, family int, own int, partner int, act string, n double, z double"
    got = {(r["fold"], r["partner"], r["act"]): (r["alpha"], r["q"]) for r in mixtures.fit_class_mixture(spark.createDataFrame(rows, schema), rounds).collect()}
    assert len(got) == 32
    db = duckdb.connect()
    db.execute("CREATE TABLE class_cells (fold INT, family INT, own INT, partner INT, act VARCHAR, n DOUBLE, z DOUBLE)")
    db.executemany("INSERT INTO class_cells VALUES (?, ?, ?, ?, ?, ?, ?)", rows)
    by_sql = {(f, p, a): (x, q) for f, _, p, a, x, q in db.execute(mixtures.mixture_rounds(rounds).replace("{class_cells}", "class_cells")).fetchall()}
    for fold in (0, 1):
        alpha, q, likelihood = _em([r for r in rows if r[0] == fold], rounds)
        assert all(b >= a - 1e-9 for a, b in zip(likelihood, likelihood[1:], strict=False))  # every round of EM raises it
        for partner in range(4):
            for k, act in enumerate(ACTS):
                assert got[fold, partner, act] == (pytest.approx(alpha, abs=1e-10), pytest.approx(q[partner, k], abs=1e-10))
                assert by_sql[fold, partner, act] == pytest.approx(got[fold, partner, act], abs=1e-10)


def test_class_mixture_without_decisions(spark):
    schema = "fold int, family int, own int, partner int, act string, n double, z double"
    got = mixtures.fit_class_mixture(spark.createDataFrame(_cells(3, empty=True), schema)).collect()
    assert {(round(r["alpha"], 9), round(r["q"], 9)) for r in got} == {(0.5, 0.25)}
    assert mixtures.fit_class_mixture(spark.createDataFrame([], schema)).count() == 0


def test_class_mixture_finds_a_planted_part(spark):
    rng = np.random.default_rng(5)
    z, q = np.array([[0.7, 0.1, 0.1, 0.1], [0.1, 0.7, 0.1, 0.1], [0.1, 0.1, 0.7, 0.1], [0.25, 0.25, 0.25, 0.25]]), np.array([[0.05, 0.05, 0.05, 0.85]] * 2 + [[0.85, 0.05, 0.05, 0.05]] * 2)
    rows = [(0, 0, o, p, a, float(n), float(z[o, k])) for o in range(4) for p in range(4) for (k, a), n in zip(enumerate(ACTS), rng.multinomial(20000, 0.6 * z[o] + 0.4 * q[p]), strict=True)]
    got = mixtures.fit_class_mixture(spark.createDataFrame(rows, "fold int, family int, own int, partner int, act string, n double, z double"), 200).collect()
    assert got[0]["alpha"] == pytest.approx(0.4, abs=0.04)
    assert {r["act"]: r["q"] for r in got if r["partner"] == 0}["push"] == pytest.approx(0.85, abs=0.06)


def _run(spark, name, tables):
    return catalog.relations().frame(spark, next(m.OPERATORS[name] for m in catalog._modules() if name in m.OPERATORS), tables)


def test_union_of_orders(spark):
    # twelve episodes; the listed ones are 1, 6 and 12; by score the order is 1..12, by gap 12..1, by put 6 first, then 1, 2, ..
    moved = [(1, 2, e, "development", 1.0, e, 20.0 - e, 0.0, float(e), 0.0, 100.0 if e == 6 else 20.0 - e, 0.0) for e in range(1, 13)]
    tables = {
        "moved": spark.createDataFrame(moved, "lo long, hi long, episode long, win string, unit double, ts long, t_ab double, t_ba double, net_lo double, net_hi double, put_lo double, put_hi double"),
        "listed": spark.createDataFrame([(1, 2, e) for e in (1, 6, 12)], "lo long, hi long, episode long"),
        "pair_labels": spark.createDataFrame([(1, 2, 1, 0)], "lo long, hi long, label int, family int"),
    }
    got = _run(spark, "union_oracles", tables).first()
    assert (got["pairs"], got["map5_score"], got["map5_gap"]) == (1, pytest.approx(1 / 3, abs=1e-8), pytest.approx(1 / 3, abs=1e-8))
    assert (got["map5_put"], got["best_model"]) == (pytest.approx(2 / 3, abs=1e-8), pytest.approx(2 / 3, abs=1e-8))
    assert (got["union5"], got["union8"]) == (1.0, 1.0)


def test_exposure_reweighted(spark):
    # in development two pairs have 1 episode and one has 4; in evaluation one pair of four has 1 and three have 4; a fifth there has 16, which nothing measured covers
    rows = [(p, p + 100, w, i) for w, sizes in (("development", {1: 1, 2: 1, 3: 4}), ("evaluation", {1: 1, 2: 4, 3: 5, 4: 4, 5: 16})) for p, n in sizes.items() for i in range(n)]
    scored = spark.createDataFrame(rows, "lo long, hi long, win string, episode long")
    measured = spark.createDataFrame([(1, 101, 0.2), (2, 102, 0.4), (3, 103, 0.9)], "lo long, hi long, x double")
    sql = metrics.exposure_reweighted({"m": "SELECT lo, hi, x FROM {measured}"})
    got = {r["bin"]: r for r in catalog.relations().frame(spark, sql, {"scored": scored, "measured": measured}).collect()}
    assert {b: (r["n"], round(r["share"], 6), r["other_share"], round(r["mean"], 6), r["reweighted"]) for b, r in got.items()} == {0: (2, 0.666667, 0.2, 0.3, 0.3), 2: (1, 0.333333, 0.6, 0.9, 1.8), -1: (3, 1.0, 0.8, 0.5, 0.75)}
    # the other way round, and without rows
    assert catalog.relations().frame(spark, metrics.exposure_reweighted({"m": "SELECT lo, hi, x FROM {measured}"}, "evaluation", "development"), {"scored": scored, "measured": measured}).where("bin = -1").first()["n"] == 3
    assert catalog.relations().frame(spark, sql, {"scored": scored.limit(0), "measured": measured}).count() == 0


def test_views(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 3, (1, 0, None)[i % 5 % 3], i % 2, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(rng.normal(size=(120, 3)))]
    pairs = spark.createDataFrame(rows, "lo long, fold int, label int, family int, a double, b double, c double").cache()
    kept = {s: learning.column_subset(("a", "b", "c"), s, 0.67) for s in (1, 2)}
    seen = catalog.relations().frame(spark, learning.feature_views("p", ("lo",), ("a", "b", "c"), (1, 2), 0.67), {"p": pairs}).collect()
    assert len(seen) == 240
    assert all((r[c] is not None) == (c in kept[r["view"]]) for r in seen for c in "abc")

    score = lambda df: {r["lo"]: r["score"] for r in learning.fit_views(df, ("a", "b", "c"), (0,), (1,), 1.0).collect()}
    whole = score(pairs)
    weighed = pairs.withColumn("y", F.expr("int(label <=> 1 AND family = 0)")).withColumn("w", F.expr("CASE WHEN label <=> 1 AND family = 1 THEN 0D WHEN label IS NULL THEN 0.5D ELSE 1D END"))
    plain = learning.cross_fit(weighed, learning.LogisticRegression(regParam=0.01), learning.column_subset(("a", "b", "c"), 1, 1.0), label="y", weight="w", out="score", standardize=True)
    assert whole == pytest.approx({r["lo"]: r["score"] for r in plain.collect()}, abs=1e-9)
    # positives of another family change no other row's score
    other = score(pairs.withColumn("a", F.expr("CASE WHEN label <=> 1 AND family = 1 THEN 9D ELSE a END")))
    same = [r[0] for r in rows if not (r[2] == 1 and r[3] == 1)]
    assert {i: other[i] for i in same} == pytest.approx({i: whole[i] for i in same}, abs=1e-9)
