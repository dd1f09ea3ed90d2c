"""Where operators keep what several jobs or executors share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a local master, as in tests, gets a temporary one; elsewhere executors couldn't share it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='tandem-')}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder in the shared directory that nobody else uses; it is not made yet."""
    _FOLDERS.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _FOLDERS[-1]


_FOLDERS: list[str] = []


def folders() -> int:
    """How many folders there are by now, for clear()."""
    return len(_FOLDERS)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later jobs read it whichever executors are lost meanwhile.

    Results are lazy and read such tables when they are used, so the caller says by clear() when it needs none of them any more.
    """
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, since: int = 0) -> None:
    """Deletes what operators wrote on the way since there were `since` folders; results that were not saved yet are lost with it."""
    while len(_FOLDERS) > since:
        path = spark._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame, name: str, since: int) -> DataFrame:
    """df as written(); what df was made from since there were `since` folders is deleted then."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    clear(df.sparkSession, since)
    _FOLDERS.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def give_back() -> None:
    """Returns what the Python worker has freed to the system. Spark uses workers again, so what a group or an earlier stage had would stay in the executor's memory beside what comes next."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


#: Stands for a missing doc_id, so that such a row comes after all others.
LAST_ID = 2**63 - 1


def order_id(col: str = "doc_id") -> Column:
    """doc_id as a long that is never null: a row without one counts as the last."""
    return F.coalesce(F.col(col).cast("long"), F.lit(LAST_ID))


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row of df takes: strings and binaries as long as they are, nested values as their JSON, others 8."""
    of = {"string": F.octet_length, "binary": F.octet_length, "array": lambda c: F.octet_length(F.to_json(c)), "map": lambda c: F.octet_length(F.to_json(c)), "struct": lambda c: F.octet_length(F.to_json(c))}
    return sum((F.coalesce(of[f.dataType.typeName()](F.col(f"`{f.name}`")), F.lit(0)) if f.dataType.typeName() in of else F.lit(8) for f in df.schema), F.lit(0)).cast("long")


def buckets(df: DataFrame, most: int = 1 << 26) -> int:
    """How many buckets the rows of df need so that one holds about `most` bytes; at least as many as there are shuffle partitions."""
    total = df.agg(F.sum(row_bytes(df))).first()[0] or 0
    return max(partitions(df.sparkSession), -(-total // most))


def packed_row() -> Column:
    """All columns of a table as one struct, so that working columns beside it can have any names; select("row.*") gives them back."""
    return F.struct("*").alias("row")


def require(df: DataFrame, *columns: str) -> None:
    """Other columns of df are ignored whatever their names."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
