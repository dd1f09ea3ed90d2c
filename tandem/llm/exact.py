"""Exact duplicates by content sort, with DataFrame functions only.

Sampled splitters deal the normalised texts into ranges, an external sort puts equal ones side by side, and
the window over them compares neighbours' full texts. The range key is a short head of the text, its digest and
a slot of the row's id: the sample that reaches the driver holds no whole texts, and a text that fills a third of
the table is cut into as many runs as there are partitions. Runs of one text are then put together by digest,
which moves one small row for each run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.storage import LAST_ID, order_id, packed_row, partitions, require, text_or_empty, written

HEAD_CHARS = 32
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def fold_ascii(col: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(col, _UPPER, _UPPER.lower())


def exact_groups(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """For every row of docs its group of texts that are equal after lower-casing A-Z.

    Returns doc_id, keep_id (doc_id of the row that stays: the largest of the group, or with keep="smallest" the
    smallest), group_size (rows), kept and text_sha256. Null texts count as empty, and empty texts are a group. Of
    repeated rows with one doc_id and text one is kept. A null doc_id counts as larger than all and comes back as null. An
    empty table gives an empty result. Other columns of docs are ignored.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep is {keep!r}")
    require(docs, "doc_id", "text")
    n = partitions(docs.sparkSession)
    rows = docs.select(order_id().alias("id"), fold_ascii(text_or_empty()).alias("norm"))
    rows = rows.select("id", "norm", F.substring("norm", 1, HEAD_CHARS).alias("head"), F.sha2("norm", 256).alias("digest"), F.pmod(F.xxhash64("id"), F.lit(n)).alias("slot"))
    dealt = rows.repartitionByRange(n, "head", "digest", "slot")
    run = Window.partitionBy("head", "digest", "slot", "norm")
    first = F.col("id").desc() if keep == "largest" else F.col("id").asc()
    in_run = dealt.select("id", "digest", "slot", F.row_number().over(run.orderBy(first)).alias("place"), F.count(F.lit(1)).over(run).alias("run_size"))
    in_run = written(in_run, "exact-runs")

    pick = F.max if keep == "largest" else F.min
    heads = in_run.where("place = 1").select("digest", "slot", F.col("id").alias("run_keep"), "run_size")
    groups = heads.groupBy("digest").agg(pick("run_keep").alias("keep"), F.sum("run_size").alias("group_size"))
    # the slot that holds the kept row: ids of one value share a slot, so a run's first place is the group's
    runs = heads.select("digest", "slot").join(groups, "digest")
    out = in_run.select("id", "digest", "slot", "place").join(runs, ["digest", "slot"])
    given = lambda c: F.when(c != F.lit(LAST_ID), c)
    return out.select(
        given(F.col("id")).alias("doc_id"),
        given(F.col("keep")).alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        ((F.col("id") == F.col("keep")) & (F.col("place") == 1)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """docs without the rows that exact_groups() doesn't keep; all columns stay as they are, whatever their names.

    Rows are matched by doc_id and the text's digest. Of repeated rows with one doc_id and equal texts one stays.
    """
    kept = exact_groups(docs, keep).where("kept").select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), F.col("text_sha256").alias("digest"))
    keyed = docs.select(packed_row(), order_id().alias("id"), F.sha2(fold_ascii(text_or_empty()), 256).alias("digest"))
    return keyed.join(kept, ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"]).select("row.*")


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON g.norm = d.norm
"""
