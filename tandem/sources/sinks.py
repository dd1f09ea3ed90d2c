"""Writing features and results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NO_EVIDENCE = "NO_EVIDENCE"


def write_features(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """A2: Parquet with zstd, in folders by columns of few values such as the window."""
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_result_csv(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str], evidence: Sequence[str] = ()) -> None:
    """A3: CSV files with a header, rows in total order over the files, and NO_EVIDENCE for missing evidence. The range sort keeps the order without one task."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(NO_EVIDENCE)).alias(c) if c in evidence else F.col(c) for c in columns]
    df.orderBy(*order).select(*filled).write.option("header", True).csv(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; only a local master may leave that unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='tandem-')}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_KEPT: list[str] = []


def release(spark: SparkSession) -> None:
    """Deletes what kept() wrote; results that read it and were not saved yet are lost."""
    while _KEPT:
        path = spark._jvm.org.apache.hadoop.fs.Path(_KEPT.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, for what several jobs read."""
    path = scratch(df.sparkSession, "kept")
    _KEPT.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
