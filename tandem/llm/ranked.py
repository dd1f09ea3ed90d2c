"""Ranked lexical search, term at a time with a limited number of accumulators.

Items (queries) are taken in blocks of a bounded number of bytes; all documents are read once for a block. What they hold of its terms is written as an index:
rows of a few thousand documents, with the postings of each term side by side. Numbers of documents and terms are summed from it, and every task then ranks the documents of its rows:

* the terms of an item are taken from the rarest on; a posting adds its part to its document's accumulator, making one where there is none;
* for the terms still to come the most that any document of the row can get is known. Once that is less than the k-th best partial score
  (of accumulators and of the documents that the task has ranked before), a document without accumulator can't come among the first k:
  no more are made, and only existing ones are updated, exactly, with all terms left;
* a task hands on k documents an item at most, which are ranked over all tasks in two steps, so that no task gets those of all others.

Scores are integers, so they don't depend on how documents are dealt out. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.storage import LAST_ID, order_id, partitions, require, text_or_empty, written
from tandem.llm.words import portions, scan

BLOCK_BYTES = 1 << 22  # of items' texts that are searched for at a time
DOCS, POSTINGS = 8192, 1 << 18  # of a row of the index, about
#: The constants of the score.
K1_TENTHS, B_PERCENT, PART = 12, 25, 1_000_000_000
#: Separators of terms: all ASCII but digits and letters.
NO_TERM = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_ARRAYS = ("terms", "sizes", "ids", "lengths", "place", "times")
INDEX = ", ".join(f"{c} binary" for c in _ARRAYS) + ", n_docs long, n_terms long"
_ROW = pa.schema([*((c, pa.binary()) for c in _ARRAYS), ("n_docs", pa.int64()), ("n_terms", pa.int64())])


def weights(n_docs: int, holding: np.ndarray) -> np.ndarray:
    """A term's weight, of the number of documents with terms and of those that hold it."""
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * holding + 1))).astype(np.int64)


def parts(times: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term counts in a document before its weight, of its occurrences and of all the document's terms."""
    norm = 100 - B_PERCENT + B_PERCENT * length * n_docs // n_terms
    return PART * times // (1000 * times + K1_TENTHS * norm)


class Items:
    """The items of a block: of each item its terms, as indices of `codes`, and how often it has them."""

    def __init__(self, texts: list[str | None]) -> None:
        owner, code = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for w in scan(pa.array(texts, pa.large_string()), True, NO_TERM):
            owner.append(w.row + w.doc())
            code.append(w.code)
        self.codes, index = np.unique(np.concatenate(code), return_inverse=True)
        pair, self.repeats = np.unique(np.concatenate(owner) * max(len(self.codes), 1) + index, return_counts=True)
        self.term = pair % max(len(self.codes), 1)
        self.first = np.searchsorted(pair // max(len(self.codes), 1), np.arange(len(texts) + 1))


def _index(batches: Iterator[pa.RecordBatch], codes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of the index: postings by term, of each its document's place in the row and how often the document has the term."""
    held: list[tuple[np.ndarray, ...]] = []
    docs = postings = 0

    def row() -> pa.RecordBatch:
        ids, lengths, term, place, times = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(term, kind="stable")
        terms, sizes = np.unique(term, return_counts=True)
        arrays = (terms.astype("<i4"), sizes.astype("<i4"), ids, lengths, place[order].astype("<i4"), times[order].astype("<i4"))
        return pa.RecordBatch.from_arrays([*(pa.array([x.tobytes()], pa.binary()) for x in arrays), pa.array([len(ids)]), pa.array([int(lengths.sum())])], schema=_ROW)

    for batch in portions(batches, "text"):
        id_ = batch["id"].to_numpy()
        for w in scan(batch["text"], True, NO_TERM):
            some = np.flatnonzero(w.counts)
            at = np.minimum(np.searchsorted(codes, w.code), len(codes) - 1)
            hit = codes[at] == w.code
            pair, times = np.unique(at[hit] * len(some) + np.searchsorted(some, w.doc()[hit]), return_counts=True) if len(some) else (at[:0], at[:0])
            held.append((id_[w.row + some], w.counts[some], pair // max(len(some), 1), docs + pair % max(len(some), 1), times))
            docs, postings = docs + len(some), postings + len(pair)
            if docs >= DOCS or postings >= POSTINGS:
                yield row()
                held, docs, postings = [], 0, 0
    if docs:
        yield row()


def _counted(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """How many documents of these rows hold each term."""
    holding = np.zeros(n, np.int64)
    for batch in batches:
        for terms, sizes in zip(batch["terms"].to_pylist(), batch["sizes"].to_pylist(), strict=True):
            holding[np.frombuffer(terms, "<i4")] += np.frombuffer(sizes, "<i4")
    found = np.flatnonzero(holding)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(holding[found])], ["term", "holding"])


class Ranking:
    """The best k documents of each item among those seen, term at a time."""

    def __init__(self, items: Items, holding: np.ndarray, n_docs: int, n_terms: int, k: int) -> None:
        self.n_docs, self.n_terms, self.k = n_docs, n_terms, k
        self.orders = []
        weight = weights(n_docs, holding)
        for a, b in zip(items.first[:-1], items.first[1:], strict=True):
            order = a + np.argsort(holding[items.term[a:b]], kind="stable")  # rarest first
            self.orders.append((items.term[order], items.repeats[order] * weight[items.term[order]]))
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in self.orders]  # score, id
        self.made = 0  # accumulators

    def add(self, terms: np.ndarray, sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, place: np.ndarray, times: np.ndarray) -> None:
        part = parts(times.astype(np.int64), lengths[place], self.n_docs, self.n_terms)
        first = np.r_[0, np.cumsum(sizes.astype(np.int64))]
        most = np.maximum.reduceat(part, first[:-1]) if len(part) else part
        for item, (own, weight) in enumerate(self.orders):
            at = np.minimum(np.searchsorted(terms, own), max(len(terms) - 1, 0))
            here = terms[at] == own if len(terms) else np.zeros(len(own), bool)
            at, weight = at[here], weight[here]
            if not len(at):
                continue
            score, known = self.best[item]
            bound = np.cumsum((most[at] * weight)[::-1])[::-1]  # of what this and the later terms can add
            acc, has, making = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool), True
            for j in range(len(at)):
                a, b = first[at[j]], first[at[j] + 1]
                docs, adds = place[a:b], part[a:b] * weight[j]
                if making:
                    making = bound[j] >= self._kth(score, acc[has])
                if not making:
                    keep = has[docs]
                    docs, adds = docs[keep], adds[keep]
                acc[docs] += adds  # a document is in a term's postings once
                has[docs] = True
            self.made += int(has.sum())
            found = np.flatnonzero(acc > (score[-1] - 1 if len(score) == self.k else 0))
            if len(found):
                score, known = np.r_[score, acc[found]], np.r_[known, ids[found]]
                order = np.lexsort((known, -score))[: self.k]
                self.best[item] = score[order], known[order]

    def _kth(self, score: np.ndarray, partial: np.ndarray) -> int:
        """The k-th best of full and partial scores, 0 while there are fewer."""
        both = np.r_[score, partial]
        return int(np.partition(both, len(both) - self.k)[len(both) - self.k]) if len(both) >= self.k else 0


def _ranked(batches: Iterator[pa.RecordBatch], ranking: Ranking) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in zip(*(batch[c] for c in _ARRAYS), strict=True):
            arrays = [np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row, ("<i4", "<i4", np.int64, np.int64, "<i4", "<i4"), strict=True)]
            ranking.add(*arrays)
    item = np.repeat(np.arange(len(ranking.best)), [len(s) for s, _ in ranking.best])
    score, ids = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*ranking.best, strict=True))
    yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids), pa.array(score)], ["item", "id", "score"])


def _search(docs: DataFrame, block: list[tuple], k: int) -> DataFrame:
    """number, id and score of the best k documents for each (number, text) of a block."""
    spark = docs.sparkSession
    items, numbers = Items([text for _, text in block]), [number for number, _ in block]
    codes, n = items.codes, len(items.codes)
    out = "number long, id long, score long"
    if not n:
        return spark.createDataFrame([], out)
    index = written(docs.mapInArrow(lambda batches: _index(batches, codes), INDEX), "postings")
    n_docs, n_terms = (x or 0 for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    holding = np.zeros(n, np.int64)
    counts = index.select("terms", "sizes").mapInArrow(lambda batches: _counted(batches, n), "term int, holding long").groupBy("term").agg(F.sum("holding").alias("holding"))
    for term, count in counts.collect():  # a row for each term of the block, whose bytes are bounded
        holding[term] = count
    ranking = Ranking(items, holding, n_docs, n_terms, k)
    found = index.mapInArrow(lambda batches: _ranked(batches, ranking), "item int, id long, score long")
    best_first = (F.col("score").desc(), F.col("id"))
    found = found.withColumn("part", F.spark_partition_id() % max(1, int(partitions(spark) ** 0.5)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*best_first))).where(F.col("rank") <= k)
    return found.select(F.get(F.lit(numbers), F.col("item")).alias("number"), "id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The k documents of docs (doc_id long, text) that score highest for each item of items (item_id, text): item_id, rank (int, from 1), doc_id and score (long).

    Terms are runs of characters other than ASCII ones that are no digits or letters, with A-Z in lower case. With N documents that have terms, L terms in all of them, n in one of
    them, df documents holding a term and tf occurrences in one: a term weighs floor(1000 ln((2N + 2) / (2df + 1))), and a score is the sum of weight * (10^9 tf div (1000 tf + 12 m))
    over an item's terms, repeats included, where m = 75 + 25nN div L. Documents that score 0 are left out; equal scores go by doc_id.

    Null and empty texts have no terms: such items find nothing, such documents aren't counted. Rows of docs count each by itself, also repeated ones; those without doc_id
    come last among equals. Repeated items are searched for once; items of one item_id and different texts (or a null one) each have their ranking. Other columns are ignored, whatever their
    names; empty tables give an empty result.
    """
    require(docs, "doc_id", "text")
    require(items, "item_id", "text")
    texts = docs.select(order_id().alias("id"), text_or_empty().alias("text"))
    asked = items.select("item_id", text_or_empty().alias("text")).distinct().withColumn("number", F.xxhash64("item_id", "text"))
    asked = written(asked, "items")  # also what a result is joined with
    n_blocks = -(-int(asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) // BLOCK_BYTES)
    found = []
    for i in range(n_blocks):
        block = asked.where(F.pmod("number", F.lit(n_blocks)) == i).select("number", "text").collect()  # BLOCK_BYTES of text on average
        found.append(_search(texts, [tuple(r) for r in block], k))
    if not found:
        return asked.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    best = reduce(DataFrame.unionByName, found)
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("id")))
    best = best.withColumn("rank", rank).where(F.col("rank") <= k)
    doc_id = F.when(F.col("id") != LAST_ID, F.col("id")).alias("doc_id")
    return best.join(asked.select("number", "item_id"), "number").select("item_id", "rank", doc_id, "score")


#: In SQL: terms as a table, counted, then joined. The same rows.
ORACLE = r"""
WITH term_of AS (
  SELECT row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents) d
), tf AS (SELECT row, doc_id, term, count(*) AS tf FROM term_of GROUP BY ALL),
size AS (SELECT row, sum(tf)::BIGINT AS n FROM tf GROUP BY row),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM size),
weight AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, n_docs),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) b
  GROUP BY ALL
), scored AS (
  SELECT item_id, row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN size USING (row), total
  GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY rank <= 20
"""
