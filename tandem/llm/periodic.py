"""Runs: stretches of words that repeat with a period, found by dyadic catchers.

A document is read from left to right. Whenever 2^k words from a multiple of 2^k on are complete, that block becomes a catcher for periods of
2 * 2^k to 4 * 2^k - 1 words, and lives as long: each word that comes then ends a suffix of 2^k words, which is compared with the two catchers of every k
that are old enough, by hashes of 2^k words that are made of two of 2^(k-1). Equal ones are a catch: a square of that period may be under way. The first half of any
square is at least 2^(k+1) long, so it holds a whole block, and no square is missed. Catches of one period by neighbouring blocks are one
chain; a chain long enough for a square is extended word by word in both directions (by doubling steps over a prefix hash) and is then a run. A
stretch that is caught with several periods has the least of them.

The words of all documents of a slice advance together: for each k there are two comparisons of arrays. A document is laid out from a multiple of its own largest block on, larger
ones first, so its blocks are rows of the array for every k. The work is n log n for n words, whatever they are; only a document's own words are ever in one place.

Words, blocks and stretches are equal by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.storage import require, text_or_empty
from tandem.llm.words import _P, _Q, Words, _power_tables, mix, portions, scan

LEAST = 12  # words of the shortest run


def _same(total: np.ndarray, power: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n words from a on and those from b on are equal; b is after a."""
    return (total[a + n] - total[a]) * power[b - a] == total[b + n] - total[b]


def find_runs(code: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start in it, length and smallest period of each run of at least `least` words and two periods, in this order.

    code: a hash of each word; first[i]:first[i+1] are document i's words.
    """
    with np.errstate(over="ignore"):
        return _find_runs(code, first, least)


def _find_runs(code: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    size = np.diff(first)
    least = max(least, 2)
    docs = np.flatnonzero(size >= least)
    block = np.where(size >= 4, 1 << (np.log2(np.maximum(size, 4)).astype(np.int64) - 2), 1)  # a document's largest block: a quarter of it at most
    docs = docs[np.argsort(-block[docs], kind="stable")]
    none = np.zeros(0, np.int64)
    if not len(docs):
        return none, none, none, none
    n, block = size[docs], block[docs]
    room = -(-n // block) * block
    base = np.r_[0, np.cumsum(room)]  # where each document is laid out
    laid = mix(np.arange(base[-1], dtype=np.uint64) * _P + np.uint64(1))  # what fills the gaps is equal to nothing
    own = np.repeat(base[:-1] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    laid[own] = code[np.repeat(first[docs] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
    power, _ = _power_tables(len(laid) + 1)
    total = np.zeros(len(laid) + 1, np.uint64)
    np.cumsum(laid * power[: len(laid)], out=total[1:])

    found = []
    hashes, width = laid, 1
    while width <= block[0]:
        rows = hashes.reshape(-1, width)
        catches = [np.nonzero(rows[c:] == rows[:-c, :1]) + (c,) for c in ((1, 2, 3) if width == 1 else (2, 3)) if len(rows) > c]
        catcher = np.concatenate([none, *(r for r, _, _ in catches)])
        period = np.concatenate([none, *(j + c * width for _, j, c in catches)])
        del catches
        doc = np.searchsorted(base, catcher * width, "right") - 1
        inside = catcher * width + period + width <= base[doc] + n[doc]
        catcher, period = catcher[inside], period[inside]
        if len(catcher):
            found.append(_chains(catcher, period, width, least, base, n, total, power))
        end = int(base[np.searchsorted(-block, -2 * width, "right")])  # of the documents that have larger blocks
        if not end:
            break
        longer = np.empty(end, np.uint64)
        longer[: end - width] = mix(hashes[: end - width] * _Q + hashes[width:end])
        longer[end - width :] = laid[end - width : end]
        hashes, width = longer, 2 * width
    doc, start, length, period = (np.concatenate([none, *x]) for x in (zip(*found, strict=True) if found else [()] * 4))
    if not len(doc):
        return none, none, none, none
    order = np.lexsort((period, length, start, docs[doc]))
    doc, start, length, period = docs[doc][order], start[order], length[order], period[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])]  # the least period of a stretch
    doc, start, length, period = doc[new], start[new], length[new], period[new]
    order = np.lexsort((period, start, doc))
    return doc[order], start[order], length[order], period[order]


def _chains(catcher: np.ndarray, period: np.ndarray, width: int, least: int, base: np.ndarray, n: np.ndarray, total: np.ndarray, power: np.ndarray) -> tuple[np.ndarray, ...]:
    """Catches of blocks of one width as runs: document, start in it, length, period."""
    key = period * (int(base[-1]) // width + 1) + catcher
    order = np.argsort(key)
    key, catcher, period = key[order], catcher[order], period[order]
    begin = np.flatnonzero(np.r_[True, np.diff(key) != 1])
    blocks = np.diff(np.r_[begin, len(key)])
    start, period = catcher[begin] * width, period[begin]
    enough = blocks >= (np.maximum(period, least - period) - width + 1) // width  # whole blocks that a square of this period has at least
    start, period, blocks = start[enough], period[enough], blocks[enough]
    doc = np.searchsorted(base, start, "right") - 1
    end = start + blocks * width
    before, after = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    step = width
    while step:
        more = before + step
        fits = more <= start - base[doc]
        more = np.where(fits, more, 0)
        before = np.where(fits & _same(total, power, start - more, start - more + period, more), more, before)
        more = after + step
        fits = end + period + more <= base[doc] + n[doc]
        more = np.where(fits, more, 0)
        after = np.where(fits & _same(total, power, end, end + period, more), more, after)
        step //= 2
    start, length = start - before, end - start + before + after + period
    whole = length >= np.maximum(least, 2 * period)
    return doc[whole], (start - base[doc])[whole], length[whole], period[whole]


def _collapsed(words: Words, doc: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words of all documents, joined by one space in each, and where each document's begin. A run keeps its first period."""
    lost = np.zeros(len(words.code) + 1, np.int64)
    np.add.at(lost, words.first[doc] + start + period, 1)
    np.subtract.at(lost, words.first[doc] + start + length, 1)
    kept = np.flatnonzero(np.cumsum(lost[:-1]) == 0)
    first = np.searchsorted(kept, words.first)
    gap = np.ones(len(kept), np.int64)
    gap[first[1:][first[1:] > first[:-1]] - 1] = 0
    size = words.end[kept] - words.start[kept] + gap
    end = np.cumsum(size)
    place = np.repeat(words.start[kept] - (end - size), size) + np.arange(end[-1] if len(end) else 0)
    data = words.data[np.minimum(place, len(words.data) - 1)] if len(place) else words.data[:0]
    data[end[gap == 1] - 1] = ord(" ")
    return data, np.r_[0, end][first]


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs and collapsed of every whole text of docs, which has doc_id (long) and text.

    Words are separated by bytes 0x20 and 0x09-0x0D and numbered from 0. A run is a stretch of at least `least` words and two of its smallest period, in which words
    one period apart are equal and which no neighbouring word extends. runs: array of (start, length, period), by start, then period. collapsed: the
    words joined by one space, without those that any run holds after its first period.
    Null, empty and wordless texts have no words, no runs and an empty collapsed text. Repeated rows and rows without doc_id are treated like others; other columns are ignored, whatever their
    names; an empty table gives an empty one. A text of any length is taken whole, in one task.
    """
    require(docs, "doc_id", "text")
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.string())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            for words in scan(batch["text"]):
                doc, *run_ = find_runs(words.code, words.first, least)
                n = len(words.first) - 1
                data, first = _collapsed(words, doc, *run_)
                runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in run_], fields=list(run)))
                texts = pa.LargeStringArray.from_buffers(n, pa.py_buffer(first.astype(np.int64)), pa.py_buffer(data))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(words.row, n), pa.array(words.counts, pa.int64()), runs, texts.cast(pa.string())], schema=schema)

    kinds = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(found, kinds)


def with_periods(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) where one document in ten goes on periodically from some word on.

    With h the CRC-32 of the decimal doc_id, g = h div 10 and n words, a text with h mod 10 = 0 and n > 0 becomes its words joined by one space, of which word i >= a is
    the original word a + (i - a) mod p, where a = g mod n and p = 1 + (n - a) div (3 + g mod 8). Other texts, and those without doc_id, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(text_or_empty(), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words"))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def run_digests(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """What periodic_runs() finds, as digests: doc_id, n_runs; start, length, period and exponent_milli of the longest run (of equals the first, then that of the least period; null
    without any), runs_sha256 (of a line `start,length,period` for each run) and collapsed_sha256."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    rows = periodic_runs(docs, least).withColumn("best", best)
    length = -F.col("best.shorter")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        F.col("best.period").alias("period"),
        F.expr("-best.shorter * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
