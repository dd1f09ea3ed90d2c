"""Passages that an earlier document holds already, by parsing against indexed reference blocks.

A document is parsed from left to right into factors: the windows of `width` words that share their least
`gram`-word hash (the anchor). Factor borders depend on the words around them alone, so two copies of a passage are cut alike
inside it. All factors are indexed by anchor, in blocks that are the buckets of a hash. In its block a factor is
compared with every other one of its anchor:

* equal to a factor of a smaller doc_id: all its windows are duplicates;
* its anchor also occurs in other factors, as at the borders of a copied passage: its windows are looked
  up one by one, in a second index that holds the windows of such factors only.

Duplicate windows that follow one another make up the removed spans. Everything moves as packed arrays (blobs.py): about 20 bytes
a factor, of which there are about two for ten words, and the texts once.

A frequent anchor is thinned out before the shuffle. Of equal factors in one batch those of the smallest doc_id go on, the others
are settled there. Where factors of several documents are left with one anchor, the batch knows by itself that their windows must be looked up: it
sends the anchor alone, once. So a block gets of an anchor what one document has, or one row, for each batch, whatever the
surroundings of a common phrase; and windows are spread by their own words. The number of blocks grows with the bytes of the texts.

Factors are equal by two 64-bit hashes, of the anchor and of all words; so are windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm import blobs
from tandem.llm.blobs import Entries
from tandem.llm.storage import buckets, give_back, order_id, require, text_or_empty, written
from tandem.llm.words import _P, _Q, Words, _power_tables, mix, portions, scan, shingles

WIDTH, GRAM = 13, 5
INDEX, TOLD, FACTOR, WINDOW, BORDER = 0, 1, 2, 3, 4  # kinds of rows


class Factors(NamedTuple):
    doc: np.ndarray  # index of the document in the slice
    at: np.ndarray  # number of the factor in its document
    start: np.ndarray  # its first window, as a word of the slice
    size: np.ndarray  # how many windows
    anchor: np.ndarray
    content: np.ndarray  # hash of all its words, and of the anchor's place among them


def factors(words: Words, width: int = WIDTH, gram: int = GRAM) -> Factors:
    none = np.zeros(0, np.int64)
    m = len(words.code) - width + 1
    if m <= 0:
        return Factors(none, none, none, none, none.view(np.uint64), none.view(np.uint64))
    value, _ = shingles(words, gram)
    least, place = value[:m].copy(), np.zeros(m, np.int64)
    for j in range(1, width - gram + 1):
        better = value[j : j + m] < least
        np.copyto(least, value[j : j + m], where=better)
        place[better] = j
    doc = words.doc()
    windows = np.flatnonzero(np.arange(m) + width <= words.first[1:][doc[:m]])
    anchor_at = windows + place[windows]
    begin = np.flatnonzero(np.r_[True, anchor_at[1:] != anchor_at[:-1]][: len(windows)])
    start, size = windows[begin], np.diff(np.r_[begin, len(windows)])
    power, inverse = _power_tables(len(words.code) + 1)
    total = np.zeros(len(words.code) + 1, np.uint64)
    np.cumsum(words.code * power[: len(words.code)], out=total[1:])
    n = size + width - 1
    content = mix((total[start + n] - total[start]) * inverse[start] + n.astype(np.uint64) * _Q + place[start].astype(np.uint64) * _P)
    owner = doc[start]
    at = np.arange(len(start)) - np.searchsorted(owner, owner)
    return Factors(owner, at, start, size, least[start], content)


def _thinned(e: Entries, n: int, kind: int, crowded: int | None = None) -> list[tuple]:
    """Rows of a batch's entries for the index; of equal (a, b) only those of the smallest id go there, the others are marked as `kind` at once.

    crowded: entries that are left of one a and several ids are marked so at once, and a alone goes to the index.
    """
    order, new = blobs.group_first(e.a, e.b)
    later = e.id > blobs.group_min(e.id, order, new)
    out = _marked(e.take(later), kind, n)
    e = e.take(~later)
    if crowded is not None:
        order, new = blobs.group_first(e.a)
        several = blobs.group_min(e.id, order, new) < blobs.group_max(e.id, order, new)
        one = np.zeros(len(order), bool)
        one[order[new]] = True
        told = e.take(several & one)._replace(b=blobs.EMPTY.b, at=blobs.EMPTY.at)
        out += _marked(e.take(several), crowded, n) + blobs.rows(told, (told.a % np.uint64(n)).astype(np.int64), TOLD)
        e = e.take(~several)
    return out + blobs.rows(e, (e.a % np.uint64(n)).astype(np.int64), INDEX)


def _marked(e: Entries, kind: int, n: int) -> list[tuple]:
    """Rows that bring marks to their documents' bucket."""
    order = np.lexsort((e.at, e.key, e.id))
    e = e.take(order)._replace(a=blobs.EMPTY.a, b=blobs.EMPTY.b)
    return blobs.rows(e, np.mod(e.key, n), kind)


def _slices(texts: pa.Array, width: int, gram: int) -> Iterator[tuple[Words, Factors]]:
    with np.errstate(over="ignore"):
        for words in scan(texts):
            yield words, factors(words, width, gram)


def _lists(e: Entries) -> dict[tuple[int, int], np.ndarray]:
    """The marked places of each document."""
    order, new = blobs.group_first(e.id, e.key)
    begin = np.flatnonzero(new)
    return {(int(e.id[order[i]]), int(e.key[order[i]])): e.at[order[i:j]] for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(order)], strict=False)}


def _through(block: pa.Table, *kinds: int) -> pa.Table:
    """The rows of a block that are on their way to their documents."""
    return block.filter(pa.compute.is_in(block["kind"], pa.array(kinds, pa.int32()))).cast(blobs.ARROW)


def repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """What an earlier document doesn't hold already, for every row of docs.

    A window is `width` consecutive words; words are separated by bytes 0x20 and 0x09-0x0D. A word is removed if a window over
    it also starts in a document of smaller doc_id. Windows are judged on the input.

    Returns row (a struct of all columns of docs, whatever their names), n_words, n_removed, kept_sha256 (of the kept words joined
    by one space) and kept_text, the text with removed words and the white space after them cut out (the text itself, or null, where
    nothing is removed). Null and empty texts have no words. Rows of equal doc_id don't remove from one another, and neither do rows
    without doc_id, which count as last. Repeated rows give repeated results, an empty table an empty one.
    """
    require(docs, "doc_id", "text")
    n = buckets(docs)
    own = [f.name for f in docs.schema]
    text = f"c{own.index('text')}"  # goes through the shuffle once, nulls and all
    rows = docs.select(order_id().alias("id"), F.xxhash64(order_id(), text_or_empty()).alias("key"), *(F.col(f"`{c}`").cast("string" if c == "text" else f.dataType).alias(f"c{i}") for i, (c, f) in enumerate(zip(own, docs.schema, strict=True))))
    dealt = rows.withColumn("bucket", F.pmod("key", F.lit(n)).cast("int"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in portions(batches, text):
            id_, key = batch["id"].to_numpy(), batch["key"].to_numpy()
            parts = [Entries(id_[w.row + f.doc], key[w.row + f.doc], f.anchor, f.content, f.at.astype(np.uint32)) for w, f in _slices(batch[text], width, gram)]
            yield blobs.batch(_thinned(blobs.joined(parts), n, FACTOR, BORDER))

    def settle(block: pa.Table) -> pa.Table:
        give_back()
        e, told = blobs.entries(block, INDEX), blobs.entries(block, TOLD)
        order, new = blobs.group_first(e.a, e.b)
        later = e.id > blobs.group_min(e.id, order, new)
        firsts = e.take(~later)
        order, new = blobs.group_first(firsts.a)
        border = (blobs.group_min(firsts.id, order, new) < blobs.group_max(firsts.id, order, new)) | np.isin(firsts.a, told.a)
        done = _marked(e.take(later), FACTOR, n) + _marked(firsts.take(border), BORDER, n)
        return pa.concat_tables([pa.Table.from_batches([blobs.batch(done)]), _through(block, FACTOR, BORDER)])

    def borders(texts: pa.Table, marks: pa.Table) -> pa.Table:
        give_back()
        looked = _lists(blobs.entries(marks, BORDER))
        id_, key = texts["id"].to_numpy(), texts["key"].to_numpy()
        chosen = np.flatnonzero(np.fromiter(((i, k) in looked for i, k in zip(id_.tolist(), key.tolist(), strict=True)), bool, len(id_)))
        parts = []
        few = texts[text].take(pa.array(chosen)).combine_chunks()
        for w, f in _slices(few, width, gram):
            code, _ = shingles(w, width)
            base = np.searchsorted(f.doc, np.arange(len(w.first) - 1))
            for d in range(len(w.first) - 1):
                row = chosen[w.row + d]
                picked = base[d] + np.sort(looked[int(id_[row]), int(key[row])])
                sizes = f.size[picked]
                at = np.repeat(f.start[picked] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
                parts.append(Entries(np.full(len(at), id_[row]), np.full(len(at), key[row]), code[at], np.repeat(f.anchor[picked], sizes), (at - w.first[d]).astype(np.uint32)))
        return pa.Table.from_batches([blobs.batch(_thinned(blobs.joined(parts), n, WINDOW))])

    def settle_windows(block: pa.Table) -> pa.Table:
        give_back()
        e = blobs.entries(block, INDEX)
        order, new = blobs.group_first(e.a, e.b)
        later = e.id > blobs.group_min(e.id, order, new)
        return pa.concat_tables([pa.Table.from_batches([blobs.batch(_marked(e.take(later), WINDOW, n))]), _through(block, WINDOW)])

    def cut(texts: pa.Table, marks: pa.Table) -> pa.Table:
        give_back()
        by_factor, by_window = _lists(blobs.entries(marks, FACTOR)), _lists(blobs.entries(marks, WINDOW))
        n_words, n_removed, digest, kept = [], [], [], []
        id_, key = texts["id"].to_numpy().tolist(), texts["key"].to_numpy().tolist()
        for i, k, scalar in zip(id_, key, texts[text], strict=True):
            whole_text = scalar.as_py() or ""
            data = whole_text.encode()
            words = data.split()  # bytes.split() splits at these very bytes
            n_words.append(len(words))
            lost = None
            if (i, k) in by_factor or (i, k) in by_window:
                lost = np.zeros(len(words) + 1, np.int64)
                at = by_window.get((i, k), np.zeros(0, np.uint32)).astype(np.int64)
                if (whole := by_factor.get((i, k))) is not None:
                    for _, f in _slices(pa.array([whole_text], pa.large_string()), width, gram):
                        sizes = f.size[whole]
                        at = np.r_[at, np.repeat(f.start[whole] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())]
                at = np.unique(at)
                lost[at] += 1
                np.subtract.at(lost, np.minimum(at + width, len(words)), 1)
                lost = np.cumsum(lost[:-1]) > 0
            if lost is None or not lost.any():
                n_removed.append(0)
                digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
                kept.append(None)
                continue
            n_removed.append(int(lost.sum()))
            digest.append(hashlib.sha256(b" ".join(compress(words, (~lost).tolist()))).hexdigest())
            kept.append(_without(whole_text, lost))
        unchanged = pa.array([x is None for x in kept], pa.bool_())
        columns = [texts[f"c{i}"] for i in range(len(own))]
        results = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), unchanged, pa.array(kept, pa.string())]
        return pa.Table.from_arrays([*columns, *results], [*(f"c{i}" for i in range(len(own))), "n_words", "n_removed", "kept_sha256", "unchanged", "cut"])

    # both kinds of marks are used, so they are written; it also spares a second reading of all texts when an executor is lost later
    first = written(rows.select("id", "key", text).mapInArrow(index, blobs.SCHEMA).groupBy("bucket").applyInArrow(settle, blobs.SCHEMA), "substring-factors")
    texts = dealt.groupBy("bucket")
    second = texts.cogroup(first.where(F.col("kind") == BORDER).groupBy("bucket")).applyInArrow(borders, blobs.SCHEMA)
    windows = second.groupBy("bucket").applyInArrow(settle_windows, blobs.SCHEMA)
    marks = first.where(F.col("kind") == FACTOR).unionByName(windows)
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.schema[2:]))
    out = texts.cogroup(marks.groupBy("bucket")).applyInArrow(cut, f"{kinds}, n_words long, n_removed long, kept_sha256 string, unchanged boolean, cut string")
    row = F.struct(*(F.col(f"c{i}").alias(c) for i, c in enumerate(own))).alias("row")
    return out.select(row, "n_words", "n_removed", "kept_sha256", F.when(F.col("unchanged"), F.col(text)).otherwise(F.col("cut")).alias("kept_text"))


def _without(text: str, lost: np.ndarray) -> str:
    """text without the lost words and the white space after each."""
    words = next(scan(pa.array([text], pa.large_string())))
    edges = np.r_[words.start, len(words.data)]
    keep = np.repeat(np.r_[True, ~lost], np.diff(np.r_[0, edges]))
    return words.data[keep].tobytes().decode()


def repeat_digests(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of repeats()."""
    return repeats(docs.select("doc_id", "text"), width).select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def drop_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with repeated passages cut out of text; rows and other columns stay as they are, whatever their names. Edge cases as in repeats(): a null text stays null."""
    cut = repeats(docs, width)
    return cut.select(*(F.col("kept_text").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
