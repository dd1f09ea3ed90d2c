"""Vectorised word and shingle hashing over Arrow string batches.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, so working on UTF-8 bytes gives the same
words as working on characters. All functions handle one slice of a batch at a time; the arrays they build
are a small multiple of the slice's bytes, whatever the length of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
PORTION_BYTES = 1 << 23
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators that leave runs of letters: all ASCII but letters.
NO_LETTER = np.array([b < 0x80 and not chr(b).isalpha() for b in range(256)])


def _byte_codes(fold: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=np.uint64) * _Q)
    if fold:
        codes[ord("A") : ord("Z") + 1] = codes[ord("a") : ord("z") + 1]
    return codes


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODES = {fold: _byte_codes(fold) for fold in (False, True)}
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_P, _P_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers


def portions(batches: Iterator[pa.RecordBatch], column: str, most: int = PORTION_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about `most` bytes of a string column, so that what is worked out of them stays small."""
    for batch in batches:
        texts = batch[column].cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        row = 0
        while row < len(texts):
            stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
            yield batch.slice(row, stop - row)
            row = stop


class Words(NamedTuple):
    """Words of some consecutive documents. first[i]:first[i+1] are document i's words."""

    row: int  # index in the batch of the first of these documents
    data: np.ndarray  # bytes of the slice
    start: np.ndarray  # byte positions
    end: np.ndarray
    first: np.ndarray
    code: np.ndarray  # 64-bit hash of each word

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """For each word the index of its document in the slice."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def scan(texts: pa.Array, fold: bool = False, separators: np.ndarray = _SPACE) -> Iterator[Words]:
    """Words of a string array in slices of whole documents, about SLICE_BYTES each; null texts have none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        yield _scan_slice(row, raw[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row], fold, separators)
        row = stop


def _scan_slice(row: int, data: np.ndarray, offsets: np.ndarray, fold: bool, separators: np.ndarray) -> Words:
    n = len(data)
    inside = ~separators[data]
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    finish[:-1] &= ~inside[1:]
    cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
    begin[cuts] = inside[cuts]
    finish[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    first = np.searchsorted(start, offsets)
    power, inverse = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODES[fold][data] * power[:n], out=total[1:])
    code = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * _Q)
    return Words(row, data, start, end, first, code)


def beginnings(words: Words, size: int, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the first `size` bytes of each word, and whether the word is longer than that."""
    n = len(words.data)
    power, inverse = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODES[fold][words.data] * power[:n], out=total[1:])
    longer = words.end - words.start > size
    end = np.minimum(words.start + size, n)
    return mix((total[end] - total[words.start]) * inverse[words.start] + _P * np.uint64(size)), longer


def shingles(words: Words, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each position, and whether those k words belong to one document."""
    n = len(words.code)
    value = np.zeros(n, np.uint64)
    valid = np.zeros(n, bool)
    if n >= k:
        m = n - k + 1
        for j in range(k):
            value[:m] = value[:m] * _Q + words.code[j : j + m]
        last = words.first[1:][words.doc()]
        valid = np.arange(n) + k <= last
    return mix(value + np.uint64(seed) * _P), valid


def sequence_code(words: Words) -> np.ndarray:
    """Hash of each document's whole word sequence; of no use where it has no words."""
    n = len(words.code)
    power, inverse = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words.code * power[:n], out=total[1:])
    return mix((total[words.first[1:]] - total[words.first[:-1]]) * inverse[words.first[:-1]] + words.counts.astype(np.uint64) * _Q)
