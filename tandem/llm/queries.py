"""The registered queries of this subpackage: thin wrappers that read a table and call an operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm import exact, jaccard, media, packing, periodic, pieces, ranked, substring, tokencount, toxicity, warc, wordbpe
from tandem.llm.storage import written


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(_documents(spark, sf_dir))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits of a crawl log made from all pages, with some of their headers."""
    found = warc.resolve_revisits(warc.crawl_records(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    header = lambda name, alias: F.col("headers")[name].alias(alias)
    return found.select("record_id", "url", "canonical", "refers_to", "state", "digest", header("date", "header_date"), header("content-length", "header_length"), header("server", "header_server"))


def op3_bfd_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id matrices of all documents, written and read again, with a digest in place of the ids."""
    stored = written(packing.packed_matrix(_documents(spark, sf_dir), vocabulary()), "matrix")
    n_tokens = F.element_at("cu_seqlens", -1)
    return stored.select(
        "sequence_id",
        "doc_ids",
        "starts",
        "cu_seqlens",
        n_tokens.cast("long").alias("n_tokens"),
        F.crc32("ids").alias("row_crc32"),
        F.crc32(F.expr("substring(ids, 1, 2 * element_at(cu_seqlens, -1))")).alias("ids_crc32"),
        F.hex("position_resets").alias("position_resets"),
    )


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_classes(_documents(spark, sf_dir), 4, 85, 100)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all texts and what they decode to, as digests."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    back = pieces.decode(pieces.encode(_documents(spark, sf_dir), model), model)
    return back.select(
        "doc_id",
        "n_chars",
        (F.octet_length("ids") / 4).cast("long").alias("n_pieces"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_documents(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeat_digests(_documents(spark, sf_dir), 13)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.section_tokens(_documents(spark, sf_dir), vocabulary(), ("lang", "source", "text"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), vocabulary(), 2048)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 20)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, some of which are made periodic on the way, as digests."""
    return periodic.run_digests(periodic.with_periods(_documents(spark, sf_dir)))


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all texts and what they decode to, as digests."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    back = wordbpe.decode(wordbpe.encode(_documents(spark, sf_dir), path), path)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_media_columns, op2_warc_revisits, op3_bfd_matrix, op4_ngram_jaccard, op5_sentencepiece, op6_exact_dedup, op7_substring_dedup, op8_token_counts, op9_toxicity, op10_best_fit_packing]
    found += [op11_ranked_search, op12_periodic_runs, op13_word_bpe]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_revisits": warc.ORACLE, "op6_exact_dedup": exact.ORACLE, "op11_ranked_search": ranked.ORACLE}
