"""Relative Lempel-Ziv parsing in its plain form: every document against every indexed reference block.

substring.py gives the same results from a common index. This form is kept to be measured beside it: each block meets all documents, so
shuffle and work grow with documents times blocks.

A block holds `most` bytes of text or less. Its index gives for the hash of each window of `width` words the smallest doc_id that has it, and where. A
document is parsed from left to right: at the next window that a smaller doc_id of the block has, the match is extended over as many words as are equal.
That is a factor, and its words are duplicates. Parsing goes on at the first window that reaches over the factor's end, so borders are checked as well.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.storage import order_id, partitions, require, text_or_empty
from tandem.llm.words import portions, scan, shingles

FOUND = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("starts", pa.binary()), ("sizes", pa.binary())])


class Index(NamedTuple):
    window: np.ndarray  # hashes of windows, sorted, each once
    id: np.ndarray  # the smallest doc_id that has the window
    at: np.ndarray  # its place in word
    word: np.ndarray  # hashes of all words of the block
    stop: np.ndarray  # end in word of the document, by place in word


def indexed(texts: pa.Table, width: int) -> Index:
    """The index of a block's texts (id, words)."""
    parts, base = [], 0
    id_ = texts["id"].to_numpy()
    with np.errstate(over="ignore"):
        for w in scan(texts["words"].combine_chunks()):
            window, whole = shingles(w, width)
            doc, at = w.doc(), np.flatnonzero(whole)
            parts.append((window[at], id_[w.row + doc[at]], at + base, w.code, w.first[1:][doc] + base))
            base += len(w.code)
    if not parts:
        none = np.zeros(0, np.int64)
        return Index(none.view(np.uint64), none, none, none.view(np.uint64), none)
    window, owner, at, word, stop = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((owner, window))
    order = order[np.r_[True, window[order][1:] != window[order][:-1]][: len(order)]]
    return Index(window[order], owner[order], at[order], word, stop)


def _extent(a: np.ndarray, b: np.ndarray) -> int:
    """How many words a and b have in common from their beginning."""
    most, done, step = min(len(a), len(b)), 0, 64
    while done < most:
        differ = a[done : min(done + step, most)] != b[done : min(done + step, most)]
        if differ.any():
            return done + int(differ.argmax())
        done, step = min(done + step, most), 2 * step
    return most


def parse(word: np.ndarray, window: np.ndarray, own: int, index: Index, width: int) -> list[tuple[int, int]]:
    """The factors of at least `width` words (start, words) of one document against a block."""
    if not len(index.window) or not len(window):
        return []
    slot = np.minimum(np.searchsorted(index.window, window), len(index.window) - 1)
    hits = np.flatnonzero((index.window[slot] == window) & (index.id[slot] < own))
    out, i = [], 0
    while i < len(hits):
        start = int(hits[i])
        there = index.at[slot[start]]
        size = _extent(word[start:], index.word[there : index.stop[there]])
        if size >= width:
            out.append((start, size))
        i = int(np.searchsorted(hits, max(start + 1, start + size - width + 1)))
    return out


def parsed_repeats(docs: DataFrame, width: int = 13, most: int = 1 << 26) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of substring.repeats(), by parsing; edge cases as there, other columns are ignored."""
    require(docs, "doc_id", "text")
    rows = docs.select("doc_id", order_id().alias("id"), text_or_empty().alias("words")).withColumn("key", F.xxhash64("id", "words"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(-(-total // most), math.isqrt(partitions(docs.sparkSession) - 1) + 1)  # n * n tasks
    each = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocks = rows.select("id", "words", F.pmod("key", F.lit(n)).cast("int").alias("block"), each.alias("part"))
    asked = rows.select("id", "key", "words", each.alias("block"), F.pmod(F.xxhash64("key"), F.lit(n)).cast("int").alias("part"))

    def meet(block: pa.Table, texts: pa.Table) -> pa.Table:
        index = indexed(block, width)
        found = []
        id_, key = texts["id"].to_numpy(), texts["key"].to_numpy()
        with np.errstate(over="ignore"):
            for w in scan(texts["words"].combine_chunks()):
                window, whole = shingles(w, width)
                for d, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
                    row = w.row + d
                    if factors := parse(w.code[a:b], window[a:b][whole[a:b]], id_[row], index, width):
                        starts, sizes = np.array(factors, np.int64).T
                        found.append((int(id_[row]), int(key[row]), starts.tobytes(), sizes.tobytes()))
        columns = list(zip(*found, strict=True)) or [[]] * len(FOUND)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND, strict=True)], schema=FOUND)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in portions(batches, "words"):
            yield _digests(piece)

    found = blocks.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(meet, "id long, key long, starts binary, sizes binary")
    spans = found.groupBy("id", "key").agg(F.collect_set(F.struct("starts", "sizes")).alias("spans"))  # one for each block at most
    return rows.join(spans, ["id", "key"], "left").select("doc_id", "words", "spans").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _digests(batch: pa.RecordBatch) -> pa.RecordBatch:
    counts, removed, digests = [], [], []
    for text, spans in zip(batch["words"].to_pylist(), batch["spans"].to_pylist(), strict=True):
        words = text.encode().split()  # bytes.split() splits at these very bytes
        edge = np.zeros(len(words) + 1, np.int64)
        for span in spans or ():
            start, size = np.frombuffer(span["starts"], np.int64), np.frombuffer(span["sizes"], np.int64)
            np.add.at(edge, start, 1)
            np.subtract.at(edge, start + size, 1)
        kept = np.cumsum(edge[:-1]) == 0
        counts.append(len(words))
        removed.append(len(words) - int(kept.sum()))
        digests.append(hashlib.sha256(b" ".join(compress(words, kept.tolist()))).hexdigest())
    return pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])
