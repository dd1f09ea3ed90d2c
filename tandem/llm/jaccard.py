"""Near duplicates: documents whose sets of word shingles have at least a given Jaccard similarity.

1. All documents, vertically: the hash order of shingles is cut into buckets, every document sends the first part of its set there, and
   each bucket counts for itself how many of a document's entries other sets share; the counts are summed per document. A document with a partner must reach a
   known number (the l-prefix bound), so most documents end here.
2. The sets that are left, one for each class of equal sets, get the exact global order: rare shingles
   first. Sets that share too few are dropped again; shingles held by one set alone can't be in an overlap and count as a number only.
3. The order is cut into fragments. For candidate pairs, those with a common shingle in their prefixes, overlaps are
   counted fragment by fragment and summed per pair.

Candidates are taken in two steps so that a group of n near copies doesn't become n * n pairs: first each set is compared
with one centre, of all sets that share a prefix shingle with it the one with the fewest shingles of its own; when components
of those links are known, pairs of a prefix shingle that still lie in different components follow. A pair inside a component can't change
it, so components are those of all links. In this second step a set meets only sets of sizes that its own size and its shared shingles allow:
sizes are cut into classes, a set is looked for in the classes of its possible partners, and lies in its own.

A class of copies, a shingle, or a centre may hold a third of all rows: joins on them split such keys over tasks (skew.py).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm import blobs
from tandem.llm.blobs import Entries
from tandem.llm.components import least_labels
from tandem.llm.skew import hot_keys, split_join
from tandem.llm.storage import LAST_ID, buckets, give_back, order_id, packed_row, require, text_or_empty, written
from tandem.llm.words import Words, mix, portions, scan, sequence_code, shingles

INDEX, SETTLED, DOC, COUNT = 0, 1, 2, 3  # kinds of rows
EXTRA = 0.15  # of a set, by which the first step's prefixes are longer than they must be
HOT = 32  # sets with one shingle in a batch, from which on it counts as frequent
HOT_CLASS = 63
FRAGMENTS = 8  # of the order
STEPS = 4  # classes of sizes between a set and its smallest possible partner


def _least(n, num: int, den: int):  # noqa: ANN001, ANN202
    """The least overlap of a set of n with any partner: ceil(n * num / den)."""
    return -(-n * num // den)


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document of the slice, shingle hash), distinct and ascending; fewer than k words are one shingle, no words none."""
    value, valid = shingles(words, k)
    doc = words.doc()
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    owner = np.r_[doc[valid], short]
    value = np.r_[value[valid], mix(sequence_code(words)[short])]
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _thinned_counts(e: Entries, n: int) -> list[tuple]:
    """Entries of a batch for the buckets: one for each shingle and class of equal sets.

    A shingle of several classes is shared whatever other batches hold: it is counted here and one entry goes on.
    """
    order, new = blobs.group_first(e.a)
    first, last = blobs.group_min(e.key, order, new), blobs.group_max(e.key, order, new)
    shared = first < last
    pick = np.zeros(len(e.id), bool)
    pick[order[new]] = True
    tell = e.take(shared & pick)._replace(b=blobs.EMPTY.a)
    alone = e.take(~shared)
    rows = blobs.rows(alone, (alone.a % np.uint64(n)).astype(np.int64), INDEX) + blobs.rows(tell, (tell.a % np.uint64(n)).astype(np.int64), SETTLED)
    return rows + _counted(e.take(shared), n)


def _counted(e: Entries, n: int) -> list[tuple]:
    """How many entries each document has, for the bucket of the document."""
    order, new = blobs.group_first(e.id, e.key)
    begin = np.flatnonzero(new)
    size = np.diff(np.r_[begin, len(order)]).astype(np.uint32)
    heads = e.take(order[new])
    return blobs.rows(Entries(heads.id, heads.key, blobs.EMPTY.a, blobs.EMPTY.a, size), np.mod(heads.id, n), COUNT)


def _sets(docs: DataFrame, k: int, num: int, den: int, n: int) -> DataFrame:
    """Rows of two kinds: DOC, each document's class of equal sets and size; COUNT, how many of its first shingles are shared. n: number of buckets."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in portions(batches, "words"):
            id_, key = batch["id"].to_numpy(), batch["key"].to_numpy()
            code, size, parts = np.zeros(len(id_), np.int64), np.zeros(len(id_), np.int64), []
            seen: set[int] = set()
            with np.errstate(over="ignore"):
                for w in scan(batch["words"], fold=True):
                    owner, value = shingle_sets(w, k)
                    here = slice(w.row, w.row + len(w.first) - 1)
                    count = np.bincount(owner, minlength=len(w.first) - 1)
                    total = np.zeros(len(count), np.uint64)
                    np.add.at(total, owner, mix(value))
                    code[here], size[here] = _signed(mix(total + count.astype(np.uint64))), count
                    at = np.arange(len(owner)) - np.searchsorted(owner, owner)
                    longest = count - _least(count, num, den) + np.ceil(EXTRA * count).astype(np.int64) + 1
                    fresh = np.array([c not in seen and not seen.add(c) for c in code[here].tolist()], bool)
                    take = (at < longest[owner]) & fresh[owner]
                    parts.append(Entries(key[here][owner[take]], code[here][owner[take]], value[take], blobs.EMPTY.a, blobs.EMPTY.at))
            info = Entries(id_, key, code.view(np.uint64), blobs.EMPTY.a, size.astype(np.uint32))
            own = np.full(len(id_), int(key[0]) % n if len(key) else 0)
            yield blobs.batch(blobs.rows(info, own, DOC) + _thinned_counts(blobs.joined(parts), n))

    def settle(block: pa.Table) -> pa.Table:
        give_back()
        e, told = blobs.entries(block, INDEX), blobs.entries(block, SETTLED)
        both = blobs.joined([e, told])
        order, new = blobs.group_first(both.a)
        known = np.r_[np.zeros(len(e.id), np.int64), np.ones(len(told.id), np.int64)]
        shared = (blobs.group_min(both.key, order, new) < blobs.group_max(both.key, order, new)) | (blobs.group_max(known, order, new) > 0)
        out = _counted(e.take(shared[: len(e.id)]), n)
        keep = block.filter(pa.compute.is_in(block["kind"], pa.array([DOC, COUNT], pa.int32())))
        return pa.concat_tables([pa.Table.from_batches([blobs.batch(out)]), keep.cast(blobs.ARROW)])

    rows = docs.select(order_id().alias("id"), text_or_empty().alias("words")).withColumn("key", F.xxhash64("id", "words"))
    return written(rows.select("id", "key", "words").mapInArrow(index, blobs.SCHEMA).groupBy("bucket").applyInArrow(settle, blobs.SCHEMA), "jaccard-first")


def _documents(first: DataFrame) -> DataFrame:
    """id, key, code (of equal sets) and n (size) of every document."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            e = blobs.entries(pa.Table.from_batches([batch]))
            yield pa.RecordBatch.from_arrays([pa.array(e.id), pa.array(e.key), pa.array(e.a.view(np.int64)), pa.array(e.at.astype(np.int64))], ["id", "key", "code", "n"])

    return first.where(F.col("kind") == DOC).mapInArrow(unpack, "id long, key long, code long, n long")


def _shared_counts(first: DataFrame) -> DataFrame:
    """code and shared: how many of the first shingles of a class's sets other classes have."""
    def add(block: pa.Table) -> pa.Table:
        give_back()
        e = blobs.entries(block)
        order, new = blobs.group_first(e.id, e.key)
        begin = np.flatnonzero(new)
        total = np.add.reduceat(e.at[order].astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)
        return pa.table({"code": pa.array(e.key[order[begin]]), "shared": pa.array(total)})

    return first.where(F.col("kind") == COUNT).groupBy("bucket").applyInArrow(add, "code long, shared long").groupBy("code").agg(F.max("shared").alias("shared"))


def _packed_sets(docs: DataFrame, wanted: DataFrame, k: int, n: int) -> DataFrame:
    """code, bucket (of n) and hashes (the whole set, ascending) for the documents (key, code) in wanted, one row for each code."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in portions(batches, "words"):
            hashes: list[bytes] = []
            with np.errstate(over="ignore"):
                for w in scan(batch["words"], fold=True):
                    owner, value = shingle_sets(w, k)
                    edges = np.searchsorted(owner, np.arange(len(w.first)))
                    hashes += [value[i:j].tobytes() for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["code"], pa.array(hashes, pa.binary())], ["code", "hashes"])

    rows = docs.select(order_id().alias("id"), text_or_empty().alias("words")).withColumn("key", F.xxhash64("id", "words"))
    found = rows.join(wanted.hint("merge"), "key").select("code", "words").mapInArrow(collect, "code long, hashes binary")
    return written(found.groupBy("code").agg(F.first("hashes").alias("hashes")).withColumn("bucket", F.pmod("code", F.lit(n)).cast("int")), "jaccard-sets")


def _ordered(sets: DataFrame, num: int, den: int, n: int) -> DataFrame:
    """Sets in the global order: code, n, m (shingles that other sets share), prefix (shingle and place among the m) and fragments.

    The order is by the power of two of the number of sets that hold a shingle, then by hash; shingles that one batch found in HOT sets come last.
    Sets that share too few shingles to have a partner are left out.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            values = [np.frombuffer(x, np.uint64) for x in batch["hashes"].to_pylist()]
            size = [len(v) for v in values]
            code = np.repeat(batch["code"].to_numpy(), size)
            at = np.concatenate([np.arange(s, dtype=np.uint32) for s in size]) if size else np.zeros(0, np.uint32)
            e = Entries(code, np.zeros_like(code), np.concatenate(values) if values else blobs.EMPTY.a, blobs.EMPTY.a, at)
            order, new = blobs.group_first(e.a)
            begin = np.flatnonzero(new)
            many = np.zeros(len(order), bool)
            many[order] = np.repeat(np.diff(np.r_[begin, len(order)]) >= HOT, np.diff(np.r_[begin, len(order)]))
            pick = np.zeros(len(order), bool)
            pick[order[new]] = True
            to = (e.a % np.uint64(n)).astype(np.int64)
            hot = e.take(many)._replace(a=np.full(int(many.sum()), HOT_CLASS, np.uint64))
            yield blobs.batch(blobs.rows(e.take(~many), to[~many], INDEX) + blobs.rows(e.take(many & pick), to[many & pick], SETTLED) + blobs.rows(hot, to[many], COUNT))

    def rank(block: pa.Table) -> pa.Table:
        give_back()
        e, told = blobs.entries(block, INDEX), blobs.entries(block, SETTLED)
        both = blobs.joined([e, told])
        order, new = blobs.group_first(both.a)
        begin = np.flatnonzero(new)
        held = np.zeros(len(order), np.int64)
        held[order] = np.repeat(np.diff(np.r_[begin, len(order)]), np.diff(np.r_[begin, len(order)]))
        hot = blobs.group_max(np.r_[np.zeros(len(e.id), np.int64), np.ones(len(told.id), np.int64)], order, new) > 0
        level = np.where(hot, HOT_CLASS, np.log2(np.maximum(held, 1)).astype(np.int64))[: len(e.id)]
        more = e.take(level > 0)._replace(a=level[level > 0].astype(np.uint64))
        out = blobs.rows(more, np.mod(more.id, n), DOC)
        hot_here = blobs.entries(block, COUNT)
        return pa.Table.from_batches([blobs.batch(out + blobs.rows(hot_here, np.mod(hot_here.id, n), DOC))])

    def arrange(own: pa.Table, marks: pa.Table) -> pa.Table:
        give_back()
        e = blobs.entries(marks)
        order, new = blobs.group_first(e.id)
        begin = np.flatnonzero(new)
        place = {int(e.id[order[i]]): order[i:j] for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(order)], strict=False)}
        out = []
        for code, packed in zip(own["code"].to_pylist(), own["hashes"].to_pylist(), strict=True):
            value = np.frombuffer(packed, np.uint64)
            rows = place.get(code)
            size, m = len(value), 0 if rows is None else len(rows)
            must = _least(size, num, den)
            if m < max(must, 1):
                continue
            level, shingle = e.a[rows].astype(np.int64), value[e.at[rows]]
            by = np.lexsort((shingle, level))
            level, shingle = level[by], shingle[by]
            fragment = 4 * (level > 1) + (shingle >> np.uint64(62)).astype(np.int64)
            signed = shingle.view(np.int64)
            prefix = signed[: max(0, size - must + 1 - (size - m))]
            out.append((code, size, m, prefix.tolist(), [np.sort(signed[fragment == f]).tolist() for f in range(FRAGMENTS)]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["code", "n", "m", "prefix", "fragments"])

    ranked = sets.select("code", "hashes").mapInArrow(index, blobs.SCHEMA).groupBy("bucket").applyInArrow(rank, blobs.SCHEMA)
    cells = sets.groupBy("bucket").cogroup(ranked.groupBy("bucket"))
    return written(cells.applyInArrow(arrange, "code long, n long, m long, prefix array<long>, fragments array<array<long>>"), "jaccard-order")


def _may_link(most: Column, n_a: Column, n_b: Column, num: int, den: int) -> Column:
    """Whether an overlap of at most `most` can be enough."""
    return most * (den + num) >= (n_a + n_b) * num


def _linked(pairs: DataFrame, ordered: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b, n_a, n_b; a written table) those that are similar enough: overlaps counted in each fragment, then summed."""
    cells = ordered.select("code", F.posexplode("fragments").alias("fragment", "own")).where(F.size("own") > 0)
    centres = hot_keys(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("rows")), ["a"], pairs.count())
    left = split_join(pairs, cells.select(F.col("code").alias("a"), "fragment", F.col("own").alias("own_a")), ["a"], centres, F.col("b"))
    others = hot_keys(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("rows")), ["b"], pairs.count())
    others = others and others.select("b", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("fragment"), "_parts")
    met = split_join(left, cells.select(F.col("code").alias("b"), "fragment", F.col("own").alias("own_b")), ["b", "fragment"], others, F.col("a"))
    part = met.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("own_a", "own_b")).cast("long").alias("part"))
    total = part.groupBy("a", "b", "n_a", "n_b").agg(F.sum("part").alias("overlap"))
    return total.where(F.col("overlap") * den >= (F.col("n_a") + F.col("n_b") - F.col("overlap")) * num).select("a", "b")


def size_class(n: Column, num: int, den: int) -> Column:
    """Sizes by equal steps of their logarithm."""
    return F.floor(F.log(n.cast("double")) * (STEPS / math.log(den / num))).cast("int") if num < den else n.cast("int")


def _apart(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b, n_a, n_b) of entries (shingle, code, n, rest, part) of one shingle and different parts that may be similar enough, once each.

    A partner has at least n * num / den shingles, at most n * den / num, and no more than leave the rest (the most that both can share from this shingle on) enough.
    """
    least = F.ceil(F.col("n") * num / den)
    most = F.least(F.floor(F.col("n") * den / num), F.floor(F.col("rest") * (den + num) / num) - F.col("n"))
    seeking = entries.withColumns({"least": least, "most": most}).where("most >= least")
    seeking = seeking.withColumn("class", F.explode(F.sequence(size_class(F.col("least"), num, den), size_class(F.col("most"), num, den))))
    seeking = written(seeking.select("shingle", "class", F.col("code").alias("a"), F.col("n").alias("n_a"), F.col("rest").alias("rest_a"), F.col("part").alias("part_a")), "jaccard-seeking")
    there = entries.select("shingle", size_class(F.col("n"), num, den).alias("class"), F.col("code").alias("b"), F.col("n").alias("n_b"), F.col("rest").alias("rest_b"), F.col("part").alias("part_b"))
    hot = hot_keys(seeking.groupBy("shingle", "class").agg(F.count(F.lit(1)).alias("rows")), ["shingle", "class"], seeking.count())
    met = split_join(seeking, there, ["shingle", "class"], hot, F.col("a"))
    near = met.where((F.col("part_a") < F.col("part_b")) & _may_link(F.least("rest_a", "rest_b"), F.col("n_a"), F.col("n_b"), num, den))
    return near.select("a", "b", "n_a", "n_b").distinct()


def _heads(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """id, key, n (size of the set) and head of every document: the least (id, key) of its component, null without words."""
    require(docs, "doc_id", "text")
    buckets_ = buckets(docs.select("doc_id", "text"))
    first = _sets(docs, k, num, den, buckets_)
    rows = _documents(first)
    classes = written(rows.where("n > 0").groupBy("code").agg(F.min(F.struct("id", "key")).alias("head"), F.max("n").alias("n"), F.count(F.lit(1)).alias("rows")), "jaccard-classes")
    bound = F.greatest(F.floor(F.lit(EXTRA) * num / den * F.col("n")), F.lit(1))
    wanted = classes.join(_shared_counts(first), "code").where(F.col("shared") >= bound)
    wanted = written(wanted.select("code", F.col("head.key").alias("key"), F.col("head").alias("label")), "jaccard-wanted")
    ordered = _ordered(_packed_sets(docs, wanted.select("key", "code"), k, buckets_), num, den, buckets_)

    entries = ordered.select("code", "n", "m", F.posexplode("prefix").alias("at", "shingle")).withColumn("rest", F.col("m") - F.col("at"))
    centre = F.min(F.struct((F.col("n") - F.col("m")).alias("alone"), F.col("code").alias("a"), F.col("n").alias("n_a"), F.col("rest").alias("rest_a")))
    centres = written(entries.groupBy("shingle").agg(centre.alias("centre"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "jaccard-centres")
    common = hot_keys(centres, ["shingle"], centres.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
    # a centre's partners: overlaps are at most what both have from the shingle on in the order
    star = split_join(entries, centres.select("shingle", "centre"), ["shingle"], common, F.col("code")).select("centre.*", F.col("code").alias("b"), F.col("n").alias("n_b"), "rest").where("a <> b")
    near = star.where(_may_link(F.least("rest_a", "rest"), F.col("n_a"), F.col("n_b"), num, den))
    stars = written(near.groupBy("b", "n_b").agg(F.min(F.struct("alone", "a", "n_a")).alias("c")).select("c.a", "b", "c.n_a", "n_b"), "jaccard-stars")
    links = written(_linked(stars, ordered, num, den), "jaccard-links")
    vertices = wanted.join(ordered.select("code"), "code", "left_semi").select(F.col("code").alias("v"), "label")
    known = least_labels(vertices, links)

    placed = entries.join(known.select(F.col("v").alias("code"), F.col("root").alias("part")), "code")
    split = placed.groupBy("shingle").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("shingle")
    open_ = written(split_join(placed, split, ["shingle"], common, F.col("code")).select("shingle", "code", "n", "rest", "part"), "jaccard-open")
    more = written(_apart(open_, num, den), "jaccard-apart")
    part_of = lambda side: known.select(F.col("v").alias(side), F.col("root").alias(f"part_{side}"))
    between = _linked(more, ordered, num, den).join(part_of("a"), "a").join(part_of("b"), "b").select(F.col("part_a").alias("a"), F.col("part_b").alias("b"))
    merged = least_labels(known.where("v = root").select("v", "label"), between)
    final = known.select("v", "root").join(merged.select(F.col("v").alias("root"), "label"), "root")

    labels = classes.select("code", F.col("head").alias("own")).join(final.select(F.col("v").alias("code"), "label"), "code", "left").select("code", F.coalesce("label", "own").alias("head"))
    copies = hot_keys(classes, ["code"], classes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
    # sets without shingles share one code, have no row in labels and need none
    found = split_join(rows.where("n > 0"), labels, ["code"], copies, F.col("key"))
    return found.select("id", "key", "n", "head").unionByName(rows.where("n = 0").select("id", "key", "n", F.lit(None).cast(found.schema["head"].dataType).alias("head")))


def near_classes(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Components of documents linked by den * |A & B| >= num * |A | B|, A and B their sets of distinct shingles of k words.

    A-Z are lower-cased; words are separated by bytes 0x20 and 0x09-0x0D. A text of fewer than k words is one shingle, its whole sequence;
    a null or empty text, or one without words, has none and is linked with nothing. Returns for every row doc_id, n_shingles and component_id,
    the smallest doc_id that links reach. A null doc_id counts as larger than all and comes back as null. Repeated rows are linked as
    any equal sets are. An empty table gives an empty result; other columns are ignored. Shingles and sets are told apart by 64-bit hashes.
    """
    given = lambda c: F.when(c != F.lit(LAST_ID), c)
    component = F.when(F.col("n") > 0, F.col("head.id")).otherwise(F.col("id"))
    return _heads(docs, k, num, den).select(given(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), given(component).alias("component_id"))


def drop_near(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one document of each component of near_classes(): the one of the smallest doc_id. Documents without words all stay.

    Rows are matched by doc_id and text, by a 64-bit hash of both. A null doc_id counts as larger than all, and of several texts with the smallest doc_id
    the one with the least hash stays, so other rows with a null or repeated doc_id are judged by their own component. Of repeated rows with one
    doc_id and text one stays; all columns stay as they are, whatever their names.
    """
    met = _heads(docs, k, num, den).where("n > 0").groupBy("id", "key")
    judged = met.agg(F.bool_or(F.col("head") == F.struct("id", "key")).alias("stays"), F.count(F.lit(1)).alias("rows"))
    judged = written(judged.where("not stays or rows > 1"), "jaccard-judged")
    keyed = docs.select(packed_row(), order_id().alias("id"), F.xxhash64(order_id(), text_or_empty()).alias("key"))
    clear = keyed.join(judged, ["id", "key"], "left_anti")
    repeated = keyed.join(judged.where("stays"), ["id", "key"], "left_semi").dropDuplicates(["id", "key"])
    return clear.unionByName(repeated).select("row.*")
