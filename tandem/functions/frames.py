"""Operators for any DataFrame's columns: imputation, standardising, profiles, ranks, frames and top lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def impute_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Infinite and missing values become the column's median, or 0 where it has none. One aggregate, whose single row is joined in."""
    finite = {c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(F.col(c)) for c in columns}
    middle = df.agg(*(F.median(finite[c]).alias(f"_m{i}") for i, c in enumerate(columns)))
    filled = df.crossJoin(F.broadcast(middle)).withColumns({c: F.coalesce(finite[c], F.col(f"_m{i}"), F.lit(0.0)) for i, c in enumerate(columns)})
    return filled.select(*df.columns)


def standardize_clip(df: DataFrame, columns: Sequence[str], low: float = -5.0, high: float = 5.0, by: Sequence[str] = (), train: DataFrame | None = None) -> DataFrame:
    """(x - mean) / (sd + 1e-6), clipped; mean and population sd are those of train (df itself where none is given), in each group of by."""
    stats = (train if train is not None else df).groupBy(*by).agg(*(f(c).alias(f"_{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    met = df.join(stats, list(by), "left") if by else df.crossJoin(F.broadcast(stats))  # without groups, one row
    z = lambda i, c: F.least(F.greatest((F.col(c) - F.col(f"_m{i}")) / (F.col(f"_s{i}") + 1e-6), F.lit(low)), F.lit(high))
    return met.withColumns({c: z(i, c) for i, c in enumerate(columns)}).select(*df.columns)


def profile(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Of each group n and every column's mean, sample standard deviation (0 for one row), maximum and continuous 90 % quantile."""
    each = lambda c: (F.avg(c).alias(f"{c}_mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_sd"), F.max(c).alias(f"{c}_max"), F.percentile(c, 0.9).alias(f"{c}_q90"))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(x for c in columns for x in each(c)))


def context_residual(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Df with residual, the value against its group's median over the median's size plus one, rank, its percent rank in the group, and group_n."""
    middle = df.groupBy(*by).agg(F.median(value).alias("_m"), F.count(F.lit(1)).alias("group_n"))
    rank = F.percent_rank().over(Window.partitionBy(*by).orderBy(value))
    return df.join(middle, list(by)).withColumns({"residual": (F.col(value) - F.col("_m")) / (F.abs("_m") + 1), "rank": rank}).drop("_m")


def rank_within(df: DataFrame, keys: Sequence[str], score: str, method: str = "average", ties: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """E5: ranks inside groups, from the lowest score: average (of equal ones), first (in the order of ties), or pct (average over the number of rows)."""
    by = Window.partitionBy(*keys)
    average = F.rank().over(by.orderBy(score)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, score)) - 1) / 2
    found = {"average": average, "first": F.row_number().over(by.orderBy(score, *ties)), "pct": average / F.count(F.lit(1)).over(by)}
    if method not in found:
        raise ValueError(f"method is {method!r}")
    return df.withColumn(out, found[method])


def within_z(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(x - mean) / sqrt(population variance + 1e-6) inside groups, as x_z."""
    by = Window.partitionBy(*keys)
    return df.withColumns({f"{c}_z": (F.col(c) - F.avg(c).over(by)) / F.sqrt(F.var_pop(c).over(by) + 1e-6) for c in columns})


def percent_ranks(df: DataFrame, keys: Sequence[str], scores: Sequence[str], tie: str) -> DataFrame:
    """Percent rank of each score inside groups, equal ones in the order of tie, as x_rank."""
    return df.withColumns({f"{s}_rank": F.percent_rank().over(Window.partitionBy(*keys).orderBy(s, tie)) for s in scores})


def frame_stats(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, side: int = 5, near: Sequence[int] = (10, 25), peak: int = 10) -> DataFrame:
    """Means of the rows before, after and around each row of a group, and the maximum around it; an empty frame gives the row's own value."""
    by = Window.partitionBy(*keys).orderBy(*order)
    out = {"before": F.coalesce(F.avg(value).over(by.rowsBetween(-side, -1)), F.col(value)), "after": F.coalesce(F.avg(value).over(by.rowsBetween(1, side)), F.col(value))}
    out |= {f"near{n}": F.avg(value).over(by.rowsBetween(-n, n)) for n in near}
    return df.withColumns({f"{value}_{n}": c for n, c in (out | {"peak": F.max(value).over(by.rowsBetween(-peak, peak))}).items()})


def top_k(df: DataFrame, keys: Sequence[str], item: str, score: str, k: int = 5, ties: Sequence[str] = (), groups: DataFrame | None = None) -> DataFrame:
    """the k best items of each group as columns item1 to itemk, null where there are fewer; every group of groups (keys) has a row."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *ties)
    best = df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    wide = best.groupBy(*keys).agg(*(F.max(F.when(F.col("_r") == i, F.col(item))).alias(f"{item}{i}") for i in range(1, k + 1)))
    return wide if groups is None else groups.select(*keys).distinct().join(wide, list(keys), "left")
