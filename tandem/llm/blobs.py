"""Arrays of (document, value ...) entries that travel as packed rows, one for each batch and bucket.

A row holds entries of many documents: each run's document once, with how many entries follow, and the entries' arrays as
bytes. A shuffle then moves about the arrays' own size, and a bucket is worked on with NumPy.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

SCHEMA = "bucket int, kind int, ids binary, keys binary, counts binary, a binary, b binary, at binary"
ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("ids", "keys", "counts", "a", "b", "at"))])


class Entries(NamedTuple):
    id: np.ndarray  # int64: the document's id
    key: np.ndarray  # int64: tells rows of one id apart
    a: np.ndarray  # uint64, or empty where not needed
    b: np.ndarray
    at: np.ndarray  # uint32: which entry of the document

    def take(self, rows: np.ndarray) -> Entries:
        return Entries(*(x[rows] if len(x) else x for x in self))


EMPTY = Entries(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint32))


def joined(parts: list[Entries]) -> Entries:
    return Entries(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else EMPTY


def rows(e: Entries, bucket: np.ndarray, kind: int) -> list[tuple]:
    """e as rows of SCHEMA, one for each bucket; entries of one document stay in their order."""
    if not len(e.id):
        return []
    order = np.argsort(bucket, kind="stable")
    bucket, e = bucket[order], e.take(order)
    edges = np.flatnonzero(np.diff(bucket)) + 1
    out = []
    for first, last in zip([0, *edges.tolist()], [*edges.tolist(), len(bucket)], strict=True):
        id_, key = e.id[first:last], e.key[first:last]
        begin = np.flatnonzero(np.r_[True, (id_[1:] != id_[:-1]) | (key[1:] != key[:-1])])
        counts = np.diff(np.r_[begin, last - first]).astype(np.uint32)
        out.append((int(bucket[first]), kind, id_[begin].tobytes(), key[begin].tobytes(), counts.tobytes(), e.a[first:last].tobytes(), e.b[first:last].tobytes(), e.at[first:last].tobytes()))
    return out


def batch(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), ARROW, strict=True)], schema=ARROW) if found else pa.RecordBatch.from_pylist([], ARROW)


def entries(table: pa.Table, kind: int | None = None) -> Entries:
    """The entries of rows of one kind."""
    parts = []
    columns = {c: table[c].to_pylist() for c in ("kind", "ids", "keys", "counts", "a", "b", "at")}
    for k, ids, keys, counts, a, b, at in zip(*columns.values(), strict=True):
        if kind is None or k == kind:
            n = np.frombuffer(counts, np.uint32)
            parts.append(Entries(np.repeat(np.frombuffer(ids, np.int64), n), np.repeat(np.frombuffer(keys, np.int64), n), np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), np.frombuffer(at, np.uint32)))
    return joined(parts)


def group_first(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the columns, first one foremost, and where a new group of equal values begins in that order."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for c in columns:
            s = c[order]
            new[1:] |= s[1:] != s[:-1]
    return order, new


def group_min(value: np.ndarray, order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each entry the least value of its group."""
    out = np.empty_like(value)
    if len(value):
        least = np.minimum.reduceat(value[order], np.flatnonzero(new))
        out[order] = np.repeat(least, np.diff(np.r_[np.flatnonzero(new), len(order)]))
    return out


def group_max(value: np.ndarray, order: np.ndarray, new: np.ndarray) -> np.ndarray:
    return ~group_min(~value, order, new)
