"""Exact orders, ranks and percentiles of groups of any size, without a window over a whole group.

Rows are range-partitioned by (group, order), sorted inside partitions and numbered; a table with one row for each partition and group then says how
much of a group is in earlier partitions. A group is so spread over as many tasks as its rows fill, and no task gets more than a partition. Ranks with ties and
percentiles work on distinct values with their counts, so a value that most rows share is one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.sources.sinks import kept

_ROW, _PART = "_order_row", "_order_part"
_IN_PART = 33  # bits of monotonically_increasing_id() that count inside a partition


def in_order(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, Column] | None = None) -> DataFrame:
    """df with r (1 for the first row of its group), n_all (rows of the group) and, for each of sums, its running sum up to the row and its sum over the group, as name and name_all.

    order: columns, with " desc" where larger ones come first; they must tell a group's rows apart, as equal ones stay in one partition. Nulls come
    first, or last where larger ones do, and are a group of their own in `by`. An empty table gives an empty one. The rows are written to the shared folder once, in order.
    """
    spark, sums = df.sparkSession, dict(sums or {})
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [*(F.col(c) for c in by), *(F.col(c.removesuffix(" desc")).desc() if c.endswith(" desc") else F.col(c) for c in order)]
    dealt = df.withColumns({name: F.coalesce(x.cast("long"), F.lit(0)) for name, x in sums.items()}) if sums else df
    dealt = kept(dealt.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn(_ROW, F.monotonically_increasing_id()))
    dealt = dealt.withColumn(_PART, F.shiftright(_ROW, _IN_PART))

    cells = dealt.groupBy(_PART, *by).agg(F.min(_ROW).alias("_first"), F.count(F.lit(1)).alias("_n"), *(F.sum(s).alias(f"_{s}") for s in sums))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # of cells: as many as there are partitions at most
    earlier = group.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, name: F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(name)
    offsets = [before("_n", "_before"), F.sum("_n").over(group).alias("n_all"), *(before(f"_{s}", f"_before_{s}") for s in sums), *(F.sum(f"_{s}").over(group).alias(f"{s}_all") for s in sums)]
    cells = cells.select(F.col(_PART).alias("_cell"), *(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), "_first", *offsets)

    if sums:
        inside = Window.partitionBy(_PART, *by).orderBy(_ROW).rowsBetween(Window.unboundedPreceding, 0)
        dealt = dealt.withColumns({s: F.sum(s).over(inside) for s in sums})
    met = dealt.join(cells, (F.col(_PART) == F.col("_cell")) & _all(F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)))
    met = met.withColumns({s: F.col(s) + F.col(f"_before_{s}") for s in sums}) if sums else met
    return met.select(*df.columns, (F.col(_ROW) - F.col("_first") + 1 + F.col("_before")).alias("r"), "n_all", *(c for s in sums for c in (s, f"{s}_all")))


def _all(conditions) -> Column:  # noqa: ANN001
    found = F.lit(True)
    for c in conditions:
        found = found & c
    return found


def counted(df: DataFrame, by: Sequence[str], value: str, weight: Column | None = None) -> DataFrame:
    """The distinct values of each group: by, value, c (rows, or the sum of an integral weight), upto (the same of this and smaller values) and c_all (of the group).

    The rank of a value's rows from the smallest on is upto - c + 1. A null value comes first.
    """
    counts = df.groupBy(*by, value).agg(F.sum(weight if weight is not None else F.lit(1)).cast("long").alias("c"))
    done = in_order(counts, by, [value], {"upto": F.col("c")})
    return done.select(*by, value, "c", "upto", F.col("upto_all").alias("c_all"))


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """by, and for each of shares (names and numbers from 0 to 1) the exact percentile of value, between two values by their distance. Nulls don't count; a group of nulls alone has null."""
    numbers = df.select(*by, F.col(value).cast("double").alias("_x"))
    found = counted(numbers, by, "_x", F.when(F.col("_x").isNotNull(), 1).otherwise(0))
    low, high = {}, {}
    for name, p in shares.items():
        at = F.lit(float(p)) * (F.col("c_all") - 1)
        for place, into in ((F.floor(at), low), (F.ceil(at), high)):
            into[name] = F.max(F.when((F.col("upto") > place) & (F.col("upto") - F.col("c") <= place), F.col("_x")))
    ends = found.groupBy(*by).agg(F.max("c_all").alias("_n"), *(x.alias(f"_low_{n}") for n, x in low.items()), *(x.alias(f"_high_{n}") for n, x in high.items()))
    at = {n: F.lit(float(p)) * (F.col("_n") - 1) for n, p in shares.items()}
    return ends.select(*by, *((F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * (at[n] - F.floor(at[n]))).alias(n) for n in shares))
