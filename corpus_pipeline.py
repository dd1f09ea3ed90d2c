"""Cleaning and packing a corpus: five stages, each written before the next reads it.

All stages but the last keep the columns of documents, whatever others there are. A null text counts as empty and stays null; rows without doc_id come after all
others: they are judged like them, and stay only where no copy has a doc_id. Repeated rows are copies of one another. Empty and wordless texts that differ are not near
copies of anything. An empty table gives an empty result. tests/llm/test_pipeline.py compares each stage with brute force on its own input.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tandem.llm import exact, jaccard, packing, substring, toxicity
from tandem.llm.storage import folders, settled


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score of toxicity (op9) is below 0.5; labels of the held-out fold are not read."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after lower-casing A-Z (op6) the one with the smallest doc_id."""
    return exact.drop_exact(docs, keep="smallest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (op4: shingles of five words, Jaccard similarity of 0.8 or more) the document with the smallest doc_id; those without words all stay."""
    return jaccard.drop_near(docs, k=5, num=80, den=100)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of thirteen words or more that a document of smaller doc_id holds (op7)."""
    return substring.drop_repeats(docs, width=13)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Placement of what is left in sequences of at most 2048 tokens (op10)."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("best_fit_packing", pack),
]

#: A trained classifier and subword ids are not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placement of all pieces of what the stages leave of the documents. Once a stage is written, its inner tables and the stage before go."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), folders()
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name, before)
    return STAGES[-1][1](spark, docs, sf_dir)
