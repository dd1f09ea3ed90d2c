"""Joins in which one key may hold any share of the rows of a side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.storage import partitions

SHARE = 4  # a key is split when it holds more rows than this part of an average partition
LEAST = 64  # rows below which no key is split


def hot_keys(counts: DataFrame, on: Sequence[str], total: int) -> DataFrame | None:
    """The keys of counts (on, rows) that hold too many of the total rows, with how many parts they need; None without any.

    More than total / (SHARE * partitions) rows make a key hot, so there are at most SHARE times as many hot keys as partitions, whatever the data.
    """
    spark = counts.sparkSession
    most = max(total // (SHARE * partitions(spark)), LEAST)
    hot = counts.where(F.col("rows") > most).select(*on, F.ceil(F.col("rows") / most).cast("int").alias("_parts"))
    found = hot.collect()  # bounded as said
    return spark.createDataFrame(found, hot.schema) if found else None


def split_join(many: DataFrame, one: DataFrame, on: Sequence[str], hot: DataFrame | None, by: Column, how: str = "inner") -> DataFrame:
    """many and one joined on equal `on`; the rows of a hot key are dealt to its parts by the hash of `by`, and one's rows are repeated for each part.

    one must have few rows for each key. Neither side has columns named _parts or _part.
    """
    if hot is None:
        return many.join(one, list(on), how)
    parts = F.broadcast(hot)  # at most SHARE * partitions rows
    own = many.join(parts, list(on), "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    each = one.join(parts, list(on), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")
    return own.join(each, [*on, "_part"], how).drop("_part")
