"""Decoders and chains give the same whether a group's episodes are folded in one task or in slots."""

import random

import pytest
from pyspark.sql import functions as F

from tandem.operators import decoders, mixtures

SLOTS = (1, 7, 10**6)


def rows(seed=2):
    """One pair with a third of all episodes, small ones, equal times, and chances near 0 and 1."""
    rng = random.Random(seed)
    sizes = [60, *(rng.randint(1, 12) for _ in range(18))]
    return [(g, g + 100, i * 10 + g, i // 3, rng.choice([1e-6, 0.02, 0.3, 0.97, 1.0 - 1e-9])) for g, n in enumerate(sizes) for i in range(n)]


@pytest.fixture(scope="module")
def chances(spark):
    return spark.createDataFrame(rows(), "lo long, hi long, episode long, ts long, p double")


def close(a, b):
    assert a.keys() == b.keys()
    assert all(abs(a[x] - b[x]) < 1e-9 for x in a)


def in_order():
    groups = {}
    for lo, _, episode, ts, p in rows():
        groups.setdefault(lo, []).append((ts, episode, p))
    return {g: sorted(x) for g, x in groups.items()}


def before(ps, k):
    """Of each event the distribution, below k, of events before it, and that of all."""
    dist, out = [1.0] + [0.0] * (k - 1), []
    for p in ps:
        out.append(dist)
        dist = [d * (1 - p) + (dist[i - 1] * p if i else 0) for i, d in enumerate(dist)]
    return out, dist


@pytest.mark.parametrize("slot", SLOTS)
def test_first_k(chances, slot):
    want, given = {}, {}
    for g, own in in_order().items():
        ps = [p for _, _, p in own]
        ahead, total = before(ps, 3)
        after = before(ps[::-1], 3)[0][::-1]
        for (_, e, p), d, b in zip(own, ahead, after, strict=True):
            want[g, e] = p * sum(d)
            given[g, e] = p * sum(x * (1 - sum(b[: max(0, 2 - j)])) for j, x in enumerate(d)) / (1 - sum(total)) if 1 - sum(total) > 1e-12 else -1
    close({(r["lo"], r["episode"]): r["decoded"] for r in decoders.first_k_marginal(chances, 3, slot=slot).collect()}, want)
    close({(r["lo"], r["episode"]): -1 if r["decoded"] is None else r["decoded"] for r in decoders.first_k_given_at_least_k(chances, 3, slot).collect()}, given)


@pytest.mark.parametrize("slot", SLOTS)
def test_two_types(chances, slot):
    both = chances.withColumns({"p_a": F.col("p") * 0.7, "p_b": F.col("p") * 0.3})
    want = {}
    for g, own in in_order().items():
        a = [p * 0.7 for _, _, p in own]
        first, either, after = before(a, 3)[0], before([p * 0.7 + p * 0.3 for _, _, p in own], 3)[0], before(a[::-1], 3)[0][::-1]
        for i, (_, e, p) in enumerate(own):
            want[g, e] = a[i] * sum(first[i]) + p * 0.3 * sum(x * sum(after[i][: 3 - j]) for j, x in enumerate(either[i]))
    close({(r["lo"], r["episode"]): r["decoded"] for r in decoders.two_type_decoder(both, 3, slot=slot).collect()}, want)


@pytest.mark.parametrize("slot", SLOTS)
def test_chain(spark, slot):
    import numpy as np

    rng = random.Random(4)
    llrs = [(g, g + 50, i, rng.gauss(0, 3)) for g, n in enumerate([50, 1, 2, 9, 14]) for i in range(n)]
    got = mixtures.episodic_activity(spark.createDataFrame(llrs, "actor long, target long, episode long, l double"), slot=slot).collect()
    step = np.array([[0.9, 0.1], [0.1, 0.9]])
    active, lbf = {}, {}
    for g in range(5):
        ls = [x[3] for x in llrs if x[0] == g]
        ahead, v, total = [], np.array([0.9, 0.1]), 0.0
        for x in ls:
            v = (v @ step) * [1, np.exp(x)]
            total += np.log(v.sum())
            v = v / v.sum()
            ahead.append(v)
        b = np.ones(2)
        for i in range(len(ls) - 1, -1, -1):
            both = ahead[i] * b
            active[g, i], lbf[g, i] = both[1] / both.sum(), total
            b = step @ (b * [1, np.exp(ls[i])])
            b = b / b.max()
    close({(r["actor"], r["episode"]): r["active"] for r in got}, active)
    close({(r["actor"], r["episode"]): r["lbf"] for r in got}, lbf)


def test_a_hot_pair_spreads_over_tasks(chances):
    cut = decoders.slots(chances.select("lo", "hi", "ts", "episode", "p"), ("lo", "hi"), ("ts", "episode"), 7)
    sizes = [r["n"] for r in cut.where("lo = 0").select(F.size("r").alias("n")).collect()]
    assert sum(sizes) == 60 and len(sizes) == 9 and max(sizes) == 7


def test_empty_tables(spark):
    none = spark.createDataFrame([], "lo long, hi long, episode long, ts long, p double")
    assert decoders.first_k_marginal(none).collect() == []
    assert decoders.first_k_given_at_least_k(none).collect() == []


@pytest.mark.parametrize("slot", SLOTS)
def test_random_rate(spark, slot):
    """All nodes of the law over one gathering of a group; sums of large groups from their slots."""
    import math

    rng = random.Random(6)
    llrs = [(g, g + 50, i, rng.gauss(0, 2)) for g, n in enumerate([40, 1, 3, 8]) for i in range(n)]
    df, law = spark.createDataFrame(llrs, "actor long, target long, episode long, l double"), mixtures.rate_nodes(nodes=4)
    decoded, llr, rate = {}, {}, {}
    for g in range(4):
        ls = [x[3] for x in llrs if x[0] == g]
        weights = [w * math.prod(1 - r + r * math.exp(x) for x in ls) for r, w in law]
        llr[g], rate[g] = math.log(sum(weights)), sum(w * r for w, (r, _) in zip(weights, law, strict=True)) / sum(weights)
        chances = [[r * math.exp(x) / (1 - r + r * math.exp(x)) for x in ls] for r, _ in law]
        for i in range(len(ls)):
            decoded[g, i] = sum(w * ps[i] * sum(before(ps, 3)[0][i]) for w, ps in zip(weights, chances, strict=True)) / sum(weights)
    close({(r["actor"], r["episode"]): r["decoded"] for r in mixtures.random_rate_first_k(df, 3, nodes=4, slot=slot).collect()}, decoded)
    got = mixtures.random_rate_marginal(df, nodes=4).collect()
    close({r["actor"]: r["llr"] for r in got}, llr)
    close({r["actor"]: r["rate"] for r in got}, rate)


@pytest.mark.parametrize("slot", SLOTS)
def test_totals_of_small_and_large_groups(spark, slot):
    df = spark.createDataFrame([(g, g % 3, float(i)) for g, n in enumerate([30, 1, 6]) for i in range(n)], "a long, b long, x double")
    got = {r["a"]: (r["n"], r["x"]) for r in decoders.totals(df, ("a", "b"), [F.count(F.lit(1)).alias("n"), F.sum("x").alias("x")], slot).collect()}
    assert got == {0: (30, 435.0), 1: (1, 0.0), 2: (6, 15.0)}


def exchanges(df):
    """The plan's exchanges, each shared one once."""
    import re

    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).split("\n\n(1)")[0]
    return re.findall(r"(?<!Reused)(?<!Broadcast)Exchange", plan)


def test_events_are_dealt_by_episode_once(spark):
    """Windows over an episode's stages and members and joins on it need no other exchange of events: one for the events of either side, and one for their participants."""
    from tandem import catalog

    folder = "/root/testdata/sf0.001"
    df = catalog.relations().frame(spark, "SELECT v.episode, v.ordinal, v.last_pusher, v.sunk, v.stage_sunk, v.next_act, p.exit_ordinal FROM {steps} v JOIN {participants} p ON p.episode = v.episode", catalog.Tables(spark, folder))
    assert len(exchanges(df)) <= 2


@pytest.mark.parametrize("name", ["sparse_activity_lbf", "substitution_llr"])
def test_rows_for_pairs_are_not_multiplied_by_the_grid(spark, name):
    """The grids of sizes and shares are columns beside one another; none is crossed in as rows."""
    from tandem import catalog

    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LocalRelation [a") == 0 and plan.count("LocalRelation [rho") == 0 and plan.count("LocalRelation [delta") == 0


@pytest.mark.parametrize("slot", [2, 1000])
def test_completion_conditioned_folds_both_over_the_same_slots(spark, monkeypatch, slot):
    rows = [(g, g + 1, e, e, (e % 7 + 1) / 9.0, int(e % 3 > 0)) for g in (1, 5) for e in range(9 * g)]
    chances = spark.createDataFrame(rows, "lo long, hi long, episode long, ts long, p double, done int")
    written, kept = [], decoders.kept
    monkeypatch.setattr(decoders, "kept", lambda df: written.append(1) or kept(df))
    got = {(r["lo"], r["episode"]): r["decoded"] for r in decoders.completion_conditioned(chances, k=3, slot=slot).collect()}
    assert len(written) == 2  # the rows and the pairs of more than a slot

    def among_first(ps):
        dist, out = [1.0, 0.0, 0.0], []
        for p in ps:
            out.append(p * sum(dist))
            dist = [d * (1 - p) + (dist[i - 1] * p if i else 0.0) for i, d in enumerate(dist)]
        return out

    for g in (1, 5):
        own = [r for r in rows if r[0] == g]
        want = [h + 1e-6 * o for h, o in zip(among_first([r[4] * r[5] for r in own]), among_first([r[4] for r in own]), strict=True)]
        assert [got[g, r[2]] for r in own] == pytest.approx(want, abs=1e-12)
