"""Orders, ranks and percentiles of whole groups, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tandem.functions import orders


def table(spark, n=400, ties=0.6, seed=1):
    """Two pools, one with most rows, most of which have one score; a null pool, and other columns."""
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 2]), i, 0.5 if rng.random() < ties else round(rng.random(), 2), rng.randint(0, 1), "x") for i in range(n)]
    return rows + [(None, n, 0.1, 1, "x"), (None, n + 1, 0.2, 0, "x"), (3, n + 2, 0.3, 1, None)]


SCHEMA = "pool int, id int, score double, y int, r2 string"


def test_in_order_with_many_ties(spark):
    rows = table(spark)
    got = orders.in_order(spark.createDataFrame(rows, SCHEMA).repartition(3), ("pool",), ("score desc", "id"), {"hits": F.col("y")})
    assert got.columns == ["pool", "id", "score", "y", "r2", "r", "n_all", "hits", "hits_all"]
    want = []
    for pool in (None, 1, 2, 3):
        own = sorted((r for r in rows if r[0] == pool), key=lambda r: (-r[2], r[1]))
        want += [(*r, k + 1, len(own), sum(x[3] for x in own[: k + 1]), sum(x[3] for x in own)) for k, r in enumerate(own)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_a_hot_pool_spreads_over_tasks(spark):
    rows = spark.range(20000).select(F.lit(1).alias("pool"), "id", F.when(F.col("id") % 5 < 3, 0.0).otherwise(F.rand(3)).alias("score"))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        done = orders.in_order(rows, ("pool",), ("score", "id"))
        sizes = [r["count"] for r in done.groupBy(F.floor(F.col("r") / F.lit(1e9)), "pool").count().collect()]
        assert sizes == [20000]
        counts = orders.counted(rows, ("pool",), "score")
        assert counts.where("score = 0").select("c", "upto", "c_all").first() == (12000, 12000, 20000)
        (path,) = {f.rpartition("/")[0] for f in done.inputFiles()}
        files = spark.read.parquet(path).groupBy(F.input_file_name()).count().select("count").collect()
        assert len(files) == 8 and max(f[0] for f in files) <= 2 * 20000 / 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_no_group_is_ordered_by_a_window(spark):
    plan = orders.in_order(spark.createDataFrame(table(spark), SCHEMA), ("pool",), ("score", "id"), {"hits": F.col("y")})._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_order_part" in line or "sum(_n#" in line for line in windows)  # inside partitions, or over a row for each of them


@pytest.mark.parametrize("ties", [0.0, 0.6, 1.0])
def test_counts_and_percentiles(spark, ties):
    rows = [*table(spark, 150, ties), (4, 900, None, 1, "x"), (2, 901, None, 0, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    shares = {"low": 0.0, "tenth": 0.1, "mid": 0.5, "q99": 0.99, "high": 1.0}
    got = {r["pool"]: [r[n] for n in shares] for r in orders.quantiles(df, ("pool",), "score", shares).collect()}
    assert set(got) == {None, 1, 2, 3, 4} and got[4] == [None] * 5
    for pool in (None, 1, 2, 3):
        own = sorted(r[2] for r in rows if r[0] == pool and r[2] is not None)
        for p, x in zip(shares.values(), got[pool], strict=True):
            at = p * (len(own) - 1)
            assert math.isclose(x, own[math.floor(at)] + (own[math.ceil(at)] - own[math.floor(at)]) * (at - math.floor(at)))
    values = {(r["pool"], r["score"]): (r["c"], r["upto"], r["c_all"]) for r in orders.counted(df.where("score is not null"), ("pool",), "score").collect()}
    for (pool, score), (c, upto, total) in values.items():
        own = [r[2] for r in rows if r[0] == pool and r[2] is not None]
        assert (c, upto, total) == (own.count(score), sum(x <= score for x in own), len(own))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert orders.in_order(none, ("pool",), ("score", "id"), {"hits": F.col("y")}).collect() == []
    assert orders.counted(none, ("pool",), "score").collect() == []
    assert orders.quantiles(none, ("pool",), "score", {"mid": 0.5}).collect() == []
    assert [tuple(r) for r in orders.quantiles(none, (), "score", {"mid": 0.5}).collect()] == [(None,)]
