"""Packing token ids of documents into sequences of a fixed capacity.

Two packers share the cutting of long documents:

* pack_documents(): minimum bin slack over the whole table. Lengths are at most the capacity, so the driver sees
  one count for each length and plans with those; the plan's size depends on the capacity alone. Pieces are ranked
  inside their length without bringing a common length together, and looked up in the plan.
* packed_matrix(): best fit decreasing inside each task, which writes id matrices and needs no shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.storage import give_back, order_id, partitions, require, text_or_empty, written
from tandem.llm.tokens import byte_bpe

END_ID = 0


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all of full capacity but the first, which takes what is over."""
    first = n % capacity or min(n, capacity)
    starts = [0, *range(first, n, capacity)]
    return [(s, (e - s)) for s, e in zip(starts, [*starts[1:], n], strict=True)]


# --- minimum bin slack over the table ---


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The lengths, each at most as often as counts says, whose sum is largest without exceeding room.

    Subset sums are the bits of one integer. Longer lengths come first and the search ends once room is met
    exactly, so of several fullest choices the one with longer lengths is found.
    """
    sums, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((x for x, c in counts.items() if c and x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, sums))
            sums |= (sums << (length * take)) & mask
            left -= take
            take *= 2
        if sums >> room & 1:
            break
    total = sums.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


@dataclass
class Pattern:
    lengths: list[int]  # of the pieces of one sequence, in their order there
    first: int  # sequence_id of the first sequence of this kind
    times: int


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Sequences for counts[length] pieces of each length, as kinds of sequence and how often each occurs.

    Each sequence takes the longest piece left and then the fullest combination that fits beside it. While all
    pieces of a combination remain, the next search would find it again, so it is repeated at once. Every kind uses up
    some length, or leaves fewer of it than the kind needs, hence there are at most about capacity * ln(capacity) kinds.
    """
    left = {x: c for x, c in counts.items() if c}
    plan, at = [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        need = fullest(left, capacity - longest)
        left[longest] += 1
        need[longest] = need.get(longest, 0) + 1
        times = min(left[x] // k for x, k in need.items())
        plan.append(Pattern([x for x in sorted(need, reverse=True) for _ in range(need[x])], at, times))
        at += times
        for x, k in need.items():
            left[x] -= k * times
            if not left[x]:
                del left[x]
    return plan


class Places:
    """Where the piece of a given rank within its length goes."""

    def __init__(self, plan: list[Pattern]) -> None:
        slots: dict[int, list[tuple[int, int, list[int]]]] = {}
        for p in plan:
            offsets = np.cumsum([0, *p.lengths]).tolist()
            for x in set(p.lengths):
                slots.setdefault(x, []).append((p.first, p.times, [o for o, y in zip(offsets, p.lengths, strict=False) if y == x]))
        self.by_length = {}
        for x, kinds in slots.items():
            each = np.array([len(offsets) for _, _, offsets in kinds])
            upto = np.cumsum(each * np.array([times for _, times, _ in kinds]))
            offsets = np.array([o for _, _, own in kinds for o in own])
            self.by_length[x] = upto, np.array([first for first, _, _ in kinds]), each, offsets, np.cumsum(each) - each

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        order = np.argsort(lengths, kind="stable")
        edges = np.flatnonzero(np.diff(lengths[order])) + 1
        for rows in np.split(order, edges) if len(order) else []:
            upto, first, each, offsets, start = self.by_length[int(lengths[rows[0]])]
            kind = np.searchsorted(upto, ranks[rows], "right")
            before = np.where(kind > 0, upto[kind - 1], 0)
            inside = ranks[rows] - before
            sequence[rows] = first[kind] + inside // each[kind]
            offset[rows] = offsets[start[kind] + inside % each[kind]]
        return sequence, offset


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048) -> DataFrame:
    """For each document, its ids and then END_ID, cut into pieces: doc_id, piece, start, length, ids_crc32.

    Each text is encoded once, whole; null counts as empty and gives the one id END_ID. Ids leave the task only
    as a checksum.
    """
    require(docs, "doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        bpe = byte_bpe(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = np.append(bpe.encode(text.as_py()), END_ID).astype("<u4")
                for piece, (start, length) in enumerate(cuts(len(ids), capacity)):
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"]) if rows else pa.RecordBatch.from_pylist([], pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return texts.mapInArrow(encode, "doc_id long, piece int, start long, length long, ids_crc32 long")


def rank_in_length(pieces: DataFrame) -> DataFrame:
    """pieces with rank: 0, 1, ... inside each length.

    Rows of a length are dealt over slots and numbered there; the slots' counts, at most one row for each length and slot,
    give every slot its first rank.
    """
    n = partitions(pieces.sparkSession)
    rows = pieces.withColumn("_slot", F.pmod(F.xxhash64(order_id(), "piece"), F.lit(n)))
    in_slot = Window.partitionBy("length", "_slot").orderBy(order_id(), "piece")
    numbered = rows.withColumn("_place", F.row_number().over(in_slot) - 1)
    sizes = rows.groupBy("length", "_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return numbered.join(firsts, ["length", "_slot"]).withColumn("rank", F.col("_first") + F.col("_place")).drop("_slot", "_place", "_first")


def place_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (doc_id, piece, length and more) with sequence_id and offset, by minimum bin slack over all of them."""
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each length up to capacity
    if any(not 0 < x <= capacity for x in counts):
        raise ValueError(f"a piece is empty or longer than {capacity}")
    places = pieces.sparkSession.sparkContext.broadcast(Places(minimum_bin_slack(counts, capacity)))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            sequence, offset = places.value.of(batch["length"].to_numpy(), batch["rank"].to_numpy())
            own = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in own), pa.array(sequence), pa.array(offset)], [*own, "sequence_id", "offset"])

    ranked = rank_in_length(pieces)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(look_up, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048) -> DataFrame:
    """All documents packed into few sequences of at most capacity ids.

    Returns one row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset. Pieces of a sequence lie side by side from offset 0
    on. Null and empty texts are documents of one id. Repeated rows are packed as often as they occur.
    An empty table gives an empty result; other columns are ignored.
    """
    return place_pieces(written(token_pieces(docs, vocabulary, capacity), "pieces"), capacity)


# --- best fit decreasing in each task ---


class Residuals:
    """Open bins by the room they have, with the smallest sufficient room found in a segment tree over rooms."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, bin_id: int) -> None:
        self.bins[room].append(bin_id)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.open[node] += by
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, bin) of an open bin with the least room of at least need, which is then no longer open."""
        node = need + self.size
        if not self.open[node]:
            while node > 1 and (node & 1 or not self.open[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node + (not self.open[2 * node])
        room = node - self.size
        self._change(room, -1)
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices into lengths: each piece, longest first, goes where the least room is left."""
    rooms, bins = Residuals(capacity), []
    for i in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        need = int(lengths[i])
        if found := rooms.take(need):
            room, b = found
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > need:
            rooms.add(room - need, b)
    return bins


MATRIX = pa.schema([("sequence_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32())), ("ids", pa.binary()), ("position_resets", pa.binary())])


def packed_matrix(docs: DataFrame, vocabulary: str, capacity: int = 2048, window: int = 8192, pad_id: int = END_ID) -> DataFrame:
    """Rows of id matrices: the ids of all documents, cut and packed by best fit decreasing.

    Returns sequence_id (unique), doc_ids and starts (of each segment: its document and how many of the document's ids come before), cu_seqlens (0
    and the end of each segment), ids (capacity little-endian unsigned 16-bit ids, or 32-bit ones where the
    vocabulary needs them, the rest filled with pad_id) and position_resets (a bit for each place, least significant first: set where positions start from 0 again).
    A task packs the pieces of its own rows in windows of that many pieces, so memory is bounded, no ids are
    shuffled, and a lost task is repeated alone. The split of the input decides which documents meet.
    Null and empty texts are one END_ID; an empty table gives no rows; repeated rows are packed as often as they occur.
    """
    require(docs, "doc_id", "text")

    def rows(held: list[tuple[int | None, int, np.ndarray]], first: int, kind: str) -> pa.RecordBatch:
        out = []
        for b in best_fit_decreasing(np.array([len(x[2]) for x in held]), capacity):
            segments = [held[i] for i in b]
            ends = np.cumsum([0, *(len(s[2]) for s in segments)])
            ids, resets = np.full(capacity, pad_id, kind), np.zeros(capacity, bool)
            ids[: ends[-1]] = np.concatenate([s[2] for s in segments])
            resets[ends[:-1]] = True
            out.append((first + len(out), [s[0] for s in segments], [s[1] for s in segments], ends.tolist(), ids.tobytes(), np.packbits(resets, bitorder="little").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), MATRIX, strict=True)], schema=MATRIX)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        bpe = byte_bpe(vocabulary)
        kind = "<u2" if len(bpe.sizes) <= 1 << 16 else "<u4"
        at, held = TaskContext.get().partitionId() << 33, []
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = np.append(bpe.encode(text.as_py()), END_ID).astype(kind)
                held += [(doc_id, s, ids[s : s + n]) for s, n in cuts(len(ids), capacity)]
                if len(held) >= window:
                    yield (done := rows(held, at, kind))
                    at, held = at + len(done), []
        if held:
            yield rows(held, at, kind)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return texts.mapInArrow(pack, "sequence_id long, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, ids binary, position_resets binary")
