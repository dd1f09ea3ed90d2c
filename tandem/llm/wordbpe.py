"""BPE with word ends: encoding by merge rounds over flat arrays, and decoding.

The words of many texts are worked on together. Each distinct word's symbols lie in one flat array. In a round every word
looks for its pair of neighbours with the lowest rank: pairs are numbers, left * size + right, and are found by binary search over the sorted numbers of
all merges. Every word's lowest pair is merged, all its occurrences from left to right; words without one are done and leave the array. Where the product
of a merge may be merged again at a lower rank, only the leftmost occurrence is merged in a round, so the order is that of one merge after the other.

Words that are equal are merged once in a slice of text. They are put together by a hash and then compared byte by byte with the first of their hash.

Ids equal those of the tokenizers library, with special strings of the vocabulary file taken as their ids; decoding equals its decode() without skipped ids. Characters that Python's
own Unicode tables don't know yet are normalised and classed by that library.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.storage import require, text_or_empty
from tandem.llm.tokens import byte_letters
from tandem.llm.words import _CODES, _Q, _power_tables, mix, portions

SLICE_CHARS = 1 << 20  # of text that is worked on at a time; longer texts are cut before white space
SLICE_IDS = 1 << 18  # of which a worker holds the decoded tokens at a time
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)  # kinds of characters
NONE = np.int32(2**31 - 1)  # rank of a pair that isn't merged
#: The steps of vocabulary files that this module knows.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WHITE_SPACE = r"\s+"


def _kind(char: str) -> int:
    category = unicodedata.category(char)
    if category[0] == "Z" or char in "\t\n\v\f\r\x85":
        return SPACE
    return {"L": LETTER, "N": NUMBER}.get(category[0], UNKNOWN if category == "Cn" else OTHER)


class WordBpe:
    """A vocabulary file whose texts are brought to NFC, lower-cased and split at white space and kinds of characters."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps, pre = spec["model"], (spec["normalizer"] or {}).get("normalizers", []), (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if (
            [s["type"] for s in steps] != NORMALIZERS
            or (steps[1]["pattern"], steps[1]["content"]) != ({"Regex": WHITE_SPACE}, " ")
            or [s["type"] for s in pre] != ["Split", "ByteLevel"]
            or (pre[0]["pattern"], pre[0]["behavior"], pre[0]["invert"]) != ({"Regex": PATTERN}, "Removed", True)
            or (pre[1]["add_prefix_space"], pre[1]["use_regex"]) != (False, False)
            or model["type"] != "BPE"
            or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            or spec["decoder"]
            or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        ):
            raise ValueError(f"{path}: not a vocabulary of the kind that is supported")
        self._path = path
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self._symbols = np.zeros(512, np.int32)  # of bytes inside words, then of bytes that end one
        for letter, b in letters.items():
            self._symbols[b], self._symbols[256 + b] = vocabulary[letter], vocabulary[letter + suffix]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        names = {i: t for t, i in (vocabulary | self.special).items()}
        self._names = [names.get(i, "").encode() for i in range(max(names) + 1)]

        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self._size = len(self._names)
        left, right = (np.array([vocabulary[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self._into = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        keys = left * self._size + right
        self._rank = np.argsort(keys, kind="stable").astype(np.int32)
        self._keys = keys[self._rank]
        lowest = np.full(self._size, NONE, np.int32)  # rank of the first merge that a symbol is part of
        ranks = np.arange(len(pairs), dtype=np.int32)
        np.minimum.at(lowest, left, ranks)
        np.minimum.at(lowest, right, ranks)
        self._single = lowest[self._into] < ranks
        inner, both = np.meshgrid(self._symbols[:256], self._symbols, indexing="ij")
        self._starting = self._ranks(inner.ravel(), both.ravel()).reshape(256, 512)  # of pairs of bytes, the second of which may end a word
        self._kinds = np.fromiter((_kind(chr(c)) for c in range(0x110000)), np.uint8, 0x110000)

    # texts to words

    @lru_cache(maxsize=1)  # noqa: B019  one object for each vocabulary and worker
    def _library(self):  # noqa: ANN202
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self._path)

    def _learn(self, code: np.ndarray) -> None:
        """Kinds of characters that are new to Python, from the library."""
        for c in np.unique(code[self._kinds[code] == UNKNOWN]).tolist():
            found = len(self._library().pre_tokenizer.pre_tokenize_str(f"a{chr(c)}{chr(c)}!"))
            joined = len(self._library().pre_tokenizer.pre_tokenize_str(f"{chr(c)}!")) == 1
            self._kinds[c] = NUMBER if found == 4 else OTHER if joined else LETTER

    def _normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if any(unicodedata.category(c) == "Cn" for c in set(text)):
            return self._library().normalizer.normalize_str(text)
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # letter by letter: lower() alone has another sigma at ends of words

    def _segments(self, text: str) -> Iterator[str | int]:
        """A text as parts that are encoded apart, and ids of special strings between them."""
        at = 0
        for found in [*self._specials.finditer(text), None] if self._specials else [None]:
            part = text[at : found.start() if found else len(text)]
            begin = 0
            while len(part) - begin > SLICE_CHARS:
                cut = min((x for x in (part.find(s, begin + SLICE_CHARS) for s in " \n") if x > 0), default=len(part))
                yield part[begin:cut]
                begin = cut
            if part[begin:]:
                yield part[begin:]
            if found:
                yield self.special[found[0]]
                at = found.end()

    def _words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """UTF-8 bytes of a normalised text, and where its words begin and end."""
        data = np.frombuffer(text.encode(), np.uint8)
        code = data if len(data) == len(text) else np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = self._kinds[code]
        if (kind == UNKNOWN).any():
            self._learn(code)
            kind = self._kinds[code]
        begin = kind == NUMBER
        begin[:1] = True
        begin[1:] |= kind[1:] != kind[:-1]
        begin &= kind != SPACE
        n = len(code)
        quote = np.flatnonzero(begin & (code == ord("'")))
        after, second = (np.where(quote + k < n, code[np.minimum(quote + k, n - 1)], 0) for k in (1, 2))
        is_ = lambda a, c: a == ord(c)
        short = is_(after, "s") | is_(after, "t") | is_(after, "m") | is_(after, "d")
        long = (is_(after, "r") & is_(second, "e")) | (is_(after, "v") & is_(second, "e")) | (is_(after, "l") & is_(second, "l"))
        taken = quote[short | long]
        begin[taken + 1] = False
        rest = taken + np.where(long, 3, 2)[short | long]
        rest = rest[rest < n]
        begin[rest[kind[rest] == LETTER]] = True
        final = kind != SPACE
        final[:-1] &= begin[1:] | (kind[1:] == SPACE)
        start, end = np.flatnonzero(begin), np.flatnonzero(final) + 1
        if len(data) != n:
            place = np.zeros(n + 1, np.int64)
            np.cumsum(1 + (code >= 0x80).astype(np.int8) + (code >= 0x800) + (code >= 0x10000), out=place[1:])
            start, end = place[start], place[end]
        return data, start, end

    # words to ids

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self._size + right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._rank[at], NONE)

    def merge(self, symbols: np.ndarray, rank: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the symbols of words become, and where each word's begin.

        rank: of the pair that a symbol begins, NONE at the end of a word. first[i]:first[i+1] are word i's symbols; no word is empty.
        """
        word = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[begin, len(word)])
            lowest = np.minimum.reduceat(rank, begin)
            going = np.repeat(lowest < NONE, sizes)
            if not going.all():
                done.append((word[~going], symbols[~going]))
                symbols, word, rank = symbols[going], word[going], rank[going]
                sizes, lowest = sizes[lowest < NONE], lowest[lowest < NONE]
                if not len(symbols):
                    break
            chosen = np.flatnonzero(rank == np.repeat(lowest, sizes))
            run = np.r_[True, np.diff(chosen) > 1]
            offset = np.arange(len(chosen)) - np.maximum.accumulate(np.where(run, np.arange(len(chosen)), 0))
            chosen = chosen[offset % 2 == 0]  # of overlapping pairs every other one
            single = self._single[rank[chosen]] & np.r_[False, word[chosen[1:]] == word[chosen[:-1]]]
            chosen = chosen[~single]
            symbols[chosen] = self._into[rank[chosen]]
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            changed = np.zeros(len(symbols), bool)
            changed[chosen] = True
            symbols, word, rank, changed = symbols[keep], word[keep], rank[keep], changed[keep]
            changed[:-1] |= changed[1:]
            at = np.flatnonzero(changed)
            rank[at] = NONE
            at = at[at < len(symbols) - 1]
            at = at[word[at] == word[at + 1]]
            rank[at] = self._ranks(symbols[at], symbols[at + 1])
        if not done:
            return symbols, first
        owner = np.concatenate([w for w, _ in done])
        order = np.argsort(owner, kind="stable")
        return np.concatenate([s for _, s in done])[order], np.searchsorted(owner[order], np.arange(len(first)))

    def _encoded(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a normalised text, and where in its bytes each word begins and how many ids it has."""
        data, start, end = self._words(text)
        size = end - start
        if not len(start):
            return np.zeros(0, np.int32), start, size
        with np.errstate(over="ignore"):
            power, inverse = _power_tables(len(data) + 1)
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_CODES[False][data] * power[: len(data)], out=total[1:])
            code = mix((total[end] - total[start]) * inverse[start] + size.astype(np.uint64) * _Q)
        _, sample, same = np.unique(code, return_index=True, return_inverse=True)
        alike = size == size[sample[same]]
        within = _ranges(np.zeros(len(size), np.int64), size)
        differs = data[np.repeat(start, size) + within] != data[np.minimum(np.repeat(start[sample[same]], size) + within, len(data) - 1)]
        alike &= np.add.reduceat(differs, np.r_[0, np.cumsum(size)[:-1]], dtype=np.int64) == 0
        odd = np.flatnonzero(~alike)  # equal hashes of different words
        same[odd] = len(sample) + np.arange(len(odd))
        sample = np.r_[sample, odd]
        ids, first = self._distinct(data, start[sample], end[sample])
        counts = np.diff(first)[same]
        return ids[_ranges(first[:-1][same], counts)], start, counts

    def _distinct(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words and where each word's begin."""
        size = end - start
        letters = data[_ranges(start, size)].astype(np.int32)
        first = np.r_[0, np.cumsum(size)]
        final = first[1:] - 1
        letters[final] += 256
        rank = np.full(len(letters), NONE, np.int32)
        rank[:-1] = self._starting[letters[:-1] & 255, letters[1:]]
        rank[final] = NONE
        return self.merge(self._symbols[letters], rank, first)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin."""
        parts: list[tuple[int, np.ndarray]] = []
        held: list[tuple[int, str]] = []
        chars = 0

        def flush() -> None:
            nonlocal chars
            normal = [self._normal(s) for _, s in held]
            ids, start, counts = self._encoded("\n".join(normal))
            edges = np.cumsum([0, *(len(s.encode()) + 1 for s in normal)])
            before = np.r_[0, np.cumsum(counts)][np.searchsorted(start, edges)]
            parts.extend((row, ids[a:b]) for (row, _), a, b in zip(held, before[:-1].tolist(), before[1:].tolist(), strict=True))
            held.clear()
            chars = 0

        for row, text in enumerate(texts):
            for part in self._segments(text):
                if isinstance(part, int):
                    if held:
                        flush()
                    parts.append((row, np.array([part], np.int32)))
                    continue
                held.append((row, part))
                chars += len(part)
                if chars >= SLICE_CHARS:
                    flush()
        if held:
            flush()
        sizes = np.zeros(len(texts), np.int64)
        for row, ids in parts:
            sizes[row] += len(ids)
        return np.concatenate([np.zeros(0, np.int32), *(ids for _, ids in parts)]), np.r_[0, np.cumsum(sizes)]

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' own strings, joined by one space; ids that the vocabulary lacks are left out."""
        return b" ".join([self._names[i] for i in ids.tolist() if 0 <= i < self._size and self._names[i]]).decode()


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... in size[0] steps, then those of start[1] and so on."""
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and ids (array of int) of every whole text of docs, which has doc_id (long) and text.

    Null and empty texts, and such of white space alone, have no ids. Repeated rows and rows without doc_id are encoded like others; other columns are
    ignored, whatever their names; an empty table gives an empty one.
    """
    require(docs, "doc_id", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocabulary)
        for batch in portions(batches, "text", 1 << 20):
            ids, first = bpe.encode(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(encoded, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """encoded (doc_id, ids) with text, what the ids stand for: their tokens joined by one space. Null ids give an empty text, ids out of range nothing; other columns are ignored."""
    require(encoded, "doc_id", "ids")
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string())])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocabulary)
        for batch in batches:
            column = batch["ids"]
            first = np.r_[0, np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False))]
            values, row = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False), 0
            while row < len(column):
                stop = max(row + 1, int(np.searchsorted(first, first[row] + SLICE_IDS, "right")) - 1)
                texts = [bpe.decode(values[a:b]) for a, b in zip(first[row:stop].tolist(), first[row + 1 : stop + 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(row, stop - row), column.slice(row, stop - row), pa.array(texts, pa.string())], schema=schema)
                row = stop

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(decoded, "doc_id long, ids array<int>, text string")
