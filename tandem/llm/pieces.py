"""SentencePiece segmentation as a max-plus parallel scan, and decoding.

The best segmentation of a text is the heaviest path over its pieces, from piece border to piece border. A giant document is
cut into chunks of a fixed number of characters. At a cut the state is how many characters the piece
across it reaches into the next chunk; a chunk's transfer matrix holds, for each state at its begin and its end, the weight of the
heaviest path between them (null: none). Matrices are combined with (max, +), which is associative; the states on the best path follow, and then every
chunk is traced back by itself. Where a white-space run begins no piece crosses, so between such places
a chunk's matrix is a sum, and words are segmented once in a worker.

Scores are summed as fixed-point integers, so sums don't depend on their order. Of equally heavy paths the one whose last piece is longest is taken, at every place from the end
on; a chunk is traced from the weights at all its begin states, so cuts don't change the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.storage import LAST_ID, order_id, require, text_or_empty, written

SPACE = "▁"
CHUNK_CHARS = 16384
MEMORY = 150_000  # words whose segmentation a worker keeps, twice
ROWS = 256  # texts that a worker holds decoded at a time
FIXED = 1 << 20  # of which scores are whole multiples
BLOCK = 64  # chunks whose matrices one task multiplies
UNKNOWN_PENALTY = 10  # below the least score, as unigram models have it

Matrix = list[list[int | None]]
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6  # types of pieces in model files


class Pieces:
    """Pieces of a model file and the heaviest paths over them."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models that leave texts as they are, but for spaces, are supported")
        self.dummy_prefix = spec.add_dummy_prefix
        usual = [(p.piece, p.score, i) for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER)]
        self.weight = {piece: (round(score * FIXED), i) for piece, score, i in usual}
        self.unknown = min(w for w, _ in self.weight.values()) - UNKNOWN_PENALTY * FIXED
        self.longest = max(len(p) for p, _, _ in usual)
        self.byte = [0] * 256
        self.text = [p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.byte[int(p.piece[1:-1], 16)] = i
                self.text[i] = bytes([int(p.piece[1:-1], 16)])
            elif p.type not in (NORMAL, USER):
                self.text[i] = b""
        chars = set("".join(self.weight))
        self.alone = "".join(c for c in "\n\t\r" if c not in chars)
        if any(SPACE in p.lstrip(SPACE) for p in self.weight):
            raise ValueError("pieces that go on after a space are not supported")
        letter = re.compile(r"[^\W\d_]")
        if any(bool(letter.match(a)) != bool(letter.match(b)) for p in self.weight for a, b in zip(p.lstrip(SPACE), p.lstrip(SPACE)[1:], strict=False)):
            units = f"{SPACE}*[^{SPACE}{self.alone}]+|{SPACE}+"
        else:  # no piece holds letters and other characters: paths meet between them too
            units = rf"{SPACE}*[^\W\d_]+|{SPACE}*(?:[\W\d_](?<![{SPACE}{self.alone}]))+|{SPACE}+"
        self.words = re.compile(units + (f"|[{self.alone}]" if self.alone else ""))
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.of_id = np.array([self.weight[p.piece][0] if p.piece in self.weight else 0 for p in model.pieces], object)

    @cached_property
    def trie(self) -> dict:
        """Pieces by their characters: each node maps a character to the next node, and "" to the weight where a piece ends."""
        root: dict = {}
        for piece, (weight, _) in self.weight.items():
            node = root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = weight
        return root

    def escaped(self, text: str) -> str:
        text = text.replace(" ", SPACE)
        return SPACE + text if self.dummy_prefix and text else text

    def paths(self, text: str, begin: dict[int, int], last_start: int) -> tuple[list[int | None], list[int]]:
        """Weight of the heaviest path to each place, over pieces that start before last_start, and where its last piece starts.

        begin: places where paths may begin, with weights; there `back` is the place itself unless a piece leads there from another.
        """
        n = len(text)
        best: list[int | None] = [None] * (n + 1)
        back = list(range(n + 1))
        for i, w in begin.items():
            best[i] = w
        root, unknown = self.trie, self.unknown
        for i in range(min(begin), min(last_start, n)):
            here = best[i]
            if here is None:
                continue
            node = root.get(text[i])
            if node is None or "" not in node:
                if best[i + 1] is None or here + unknown > best[i + 1]:
                    best[i + 1], back[i + 1] = here + unknown, i
            j = i
            while node is not None:
                j += 1
                weight = node.get("")
                if weight is not None and (best[j] is None or here + weight > best[j]):
                    best[j], back[j] = here + weight, i
                if j == n:
                    break
                node = node.get(text[j])
        return best, back

    def ids(self, text: str, back: list[int], end: int) -> tuple[int, bytes]:
        """Where the path to `end` begins, and its ids."""
        out: list[int] = []
        while back[end] < end:
            piece = text[back[end] : end]
            found = self.weight.get(piece)
            out += [found[1]] if found else [self.byte[b] for b in reversed(piece.encode())]
            end = back[end]
        return end, np.array(out[::-1], "<u4").tobytes()

    def word(self, word: str) -> bytes:
        """Ids of one word. Words met lately are remembered; when there are too many, those not met since the last time go."""
        found = self.known.get(word)
        if found is None:
            found = self.before.get(word)
            if found is None:
                _, back = self.paths(word, {0: 0}, len(word))
                found = self.ids(word, back, len(word))[1]
            if len(word) <= 64:
                if len(self.known) >= MEMORY:
                    self.known, self.before = {}, self.known
                self.known[word] = found
        return found

    def heaviness(self, word: str) -> int:
        """Weight of the heaviest path over a word."""
        return self.paths(word, {0: 0}, len(word))[0][-1]

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, little-endian unsigned 32-bit."""
        word = self.word
        return b"".join([word(w) for w in self.words.findall(self.escaped(text))])

    def decode(self, ids: bytes) -> str:
        data = b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return data.decode("utf-8", "replace").removeprefix(" " if self.dummy_prefix else "")

    # chunks: a chunk's text is followed by up to longest - 1 characters of the next

    def cuts(self, chunk: str, size: int) -> tuple[int, int] | None:
        """The first and last place before size in a chunk which no piece crosses; None without one."""
        places = [m.start() for m in self.words.finditer(chunk) if 0 < m.start() < size]
        # the match at 0 may go on a word that began in the chunk before: only later ones begin for certain
        return (places[0], places[-1]) if places else None

    def _middle(self, text: str) -> int:
        """Weight of a text that begins and ends where paths meet; characters without a piece count as such."""
        total = 0
        for w in self.words.findall(text):
            ids = np.frombuffer(self.word(w), "<u4")
            weights = self.of_id[ids]
            total += self.heaviness(w) if (weights == 0).any() else int(weights.sum())
        return total

    def transfer(self, chunk: str, size: int) -> Matrix:
        """[begin state][end state] of a chunk whose own part is the first size characters."""
        reach = lambda best, e: best[size + e] if size + e < len(best) else None
        cut = self.cuts(chunk, size)
        if cut is None:
            rows = [[reach(self.paths(chunk, {i: 0}, size)[0], e) for e in range(self.longest)] for i in range(min(self.longest, size + 1))]
            for i in range(size + 1, min(self.longest, len(chunk) + 1)):  # a piece over the whole chunk
                rows.append([0 if size + e == i else None for e in range(self.longest)])
            return rows + [[None] * self.longest] * (self.longest - len(rows))
        first, last = cut
        middle = self._middle(chunk[first:last])
        tail, _ = self.paths(chunk[last:], {0: 0}, size - last)
        end = [tail[size - last + e] if size - last + e < len(tail) else None for e in range(self.longest)]
        rows = []
        for i in range(self.longest):
            head = self.paths(chunk[:first], {i: 0}, first)[0][first] if i <= first else None
            rows.append([None if head is None or e is None else head + middle + e for e in end])
        return rows

    def trace(self, chunk: str, size: int, before: list[int | None]) -> tuple[bytes, list[int | None], list[bytes]]:
        """Paths to every end state, given the weights of the heaviest paths to each begin state.

        Returns ids that they have in common first, and for each end state the begin state it comes from (None: not reached) and the ids that follow.
        """
        begin = {i: w for i, w in enumerate(before) if w is not None and i <= len(chunk)}
        cut = self.cuts(chunk, size)
        if cut is None:
            best, back = self.paths(chunk, begin, size)
            ends = [size + e for e in range(self.longest)]
            found = [self.ids(chunk, back, e) if e < len(best) and best[e] is not None else (None, b"") for e in ends]
            return b"", [f[0] for f in found], [f[1] for f in found]
        first, last = cut
        _, back = self.paths(chunk[:first], {i: w for i, w in begin.items() if i <= first}, first)
        origin, head = self.ids(chunk[:first], back, first)
        best, back = self.paths(chunk[last:], {0: 0}, size - last)
        ends = [size - last + e for e in range(self.longest)]
        there = [e < len(best) and best[e] is not None for e in ends]
        common = head + b"".join(self.word(w) for w in self.words.findall(chunk[first:last]))
        return common, [origin if t else None for t in there], [self.ids(chunk[last:], back, e)[1] if t else b"" for e, t in zip(ends, there, strict=True)]


def combine(a: Matrix, b: Matrix) -> Matrix:
    """The transfer matrix of two neighbouring parts."""
    out = []
    for row in a:
        reach = [(x, k) for k, x in enumerate(row) if x is not None]
        out.append([max((x + b[k][j] for x, k in reach if b[k][j] is not None), default=None) for j in range(len(b[0]))])
    return out


def weights_before(matrices: list[Matrix], begin: list[int | None] | None = None) -> list[list[int | None]]:
    """For each part the weights of the heaviest paths from the text's begin to its begin states, less the largest of them; begin: those of the first part."""
    now: Matrix = [begin or [0] + [None] * (len(matrices[0]) - 1)]
    out = []
    for m in matrices:
        top = max(x for x in now[0] if x is not None)
        now = [[None if x is None else x - top for x in now[0]]]
        out.append(now[0])
        now = combine(now, m)
    return out


def product(matrices: list[Matrix]) -> Matrix:
    """The transfer matrix of neighbouring parts, combined in pairs of neighbours."""
    while len(matrices) > 1:
        matrices = [combine(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0]


def chain(traced: list[tuple[bytes, list[int | None], list[bytes]]]) -> bytes:
    """The ids of a whole text from its parts' traces; the text ends in state 0."""
    state, out = 0, []
    for common, origins, tails in reversed(traced):
        out += [tails[state], common]
        state = origins[state]
    return b"".join(reversed(out))


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def chunks(text: str, size: int, more: int) -> list[tuple[int, str, int]]:
    """(number, characters with up to `more` of the next chunk, number of own characters)."""
    return [(k, text[s : s + size + more], min(size, len(text) - s)) for k, s in enumerate(range(0, len(text), size))]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def encode(docs: DataFrame, model: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, n_chars and ids (little-endian unsigned 32-bit numbers as bytes) of every text.

    Texts of more than four chunks are cut; others are segmented in one go, with the same result. Null and empty texts have no ids. Repeated rows give
    repeated results, a null doc_id stays null, an empty table gives none; other columns are ignored.
    Characters without a piece become their bytes' pieces.
    """
    require(docs, "doc_id", "text")
    rows = docs.select(order_id().alias("id"), text_or_empty().alias("text"))
    giant = F.length("text") > 4 * chunk_chars

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in _slices(batches):
            texts = batch["text"].to_pylist()
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([len(t) for t in texts], pa.int64()), pa.array([own.encode(t) for t in texts], pa.binary())], ["id", "n_chars", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in _slices(batches):
            for one in batch.to_pylist():
                parts = chunks(own.escaped(one["text"]), chunk_chars, own.longest - 1)
                yield pa.RecordBatch.from_pylist([{"id": one["id"], "key": one["key"], "chunk": k, "part": part, "size": size} for k, part, size in parts], pa.schema([("id", pa.int64()), ("key", pa.int64()), ("chunk", pa.int32()), ("part", pa.string()), ("size", pa.int32())]))

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in _slices(batches):
            found = [own.transfer(p, s) for p, s in zip(batch["part"].to_pylist(), batch["size"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["key"], batch["chunk"], pa.array(found, pa.list_(pa.list_(pa.int64())))], ["id", "key", "chunk", "matrix"])

    def multiply(table: pa.Table) -> pa.Table:
        by = dict(zip(table["chunk"].to_pylist(), table["matrix"].to_pylist(), strict=True))
        whole = product([by[k] for k in sorted(by)])
        return pa.Table.from_arrays([table["id"][:1], table["key"][:1], pa.array([min(by) // BLOCK], pa.int32()), pa.array([whole], pa.list_(pa.list_(pa.int64())))], ["id", "key", "block", "matrix"])

    def scan(at: str):  # noqa: ANN202
        def run(table: pa.Table) -> pa.Table:
            by = dict(zip(table[at].to_pylist(), table["matrix"].to_pylist(), strict=True))
            begin = table["begin"][0].as_py() if "begin" in table.column_names else None
            before = weights_before([by[k] for k in sorted(by)], begin)
            head = [pa.array([table[c][0].as_py()] * len(before), pa.int64()) for c in ("id", "key")]
            return pa.Table.from_arrays([*head, pa.array(sorted(by), pa.int32()), pa.array(before, pa.list_(pa.int64()))], ["id", "key", at, "before"])

        return run

    traces = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("chunk", pa.int32()), ("common", pa.binary()), ("origins", pa.list_(pa.int32())), ("tails", pa.list_(pa.binary()))])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in _slices(batches):
            found = [own.trace(*x) for x in zip(*(batch[c].to_pylist() for c in ("part", "size", "before")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["key"], batch["chunk"], *(pa.array([f[i] for f in found], traces.field(3 + i).type) for i in range(3))], schema=traces)

    def join(table: pa.Table) -> pa.Table:
        by = {k: x for k, *x in zip(*(table[c].to_pylist() for c in ("chunk", "common", "origins", "tails")), strict=True)}
        return pa.table({"id": table["id"][:1], "key": table["key"][:1], "ids": pa.array([chain([by[k] for k in sorted(by)])], pa.binary())})

    small = rows.where(~giant).mapInArrow(whole, "id long, n_chars long, ids binary")
    large = rows.where(giant).withColumn("key", F.xxhash64("id", "text"))
    parts = large.mapInArrow(cut, "id long, key long, chunk int, part string, size int")
    chunked = written(parts.mapInArrow(transfers, "id long, key long, chunk int, matrix array<array<long>>").withColumn("block", F.floor(F.col("chunk") / BLOCK).cast("int")), "transfers")
    # the scan in two levels: matrices of whole blocks, weights at their begins, and from there the weights at each chunk's begin
    blocks = chunked.groupBy("id", "key", "block").applyInArrow(multiply, "id long, key long, block int, matrix array<array<long>>")
    begins = blocks.groupBy("id", "key").applyInArrow(scan("block"), "id long, key long, block int, before array<long>").withColumnRenamed("before", "begin")
    before = chunked.join(begins, ["id", "key", "block"]).groupBy("id", "key", "block").applyInArrow(scan("chunk"), "id long, key long, chunk int, before array<long>")
    traced = parts.join(before, ["id", "key", "chunk"]).mapInArrow(trace, "id long, key long, chunk int, common binary, origins array<int>, tails array<binary>")
    joined = traced.groupBy("id", "key").applyInArrow(join, "id long, key long, ids binary")
    met = large.select("id", "key", F.length("text").cast("long").alias("n_chars")).join(joined, ["id", "key"]).select("id", "n_chars", "ids")
    return small.unionByName(met).select(F.when(F.col("id") != LAST_ID, F.col("id")).alias("doc_id"), "n_chars", "ids")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded with text: what its ids stand for. Null ids stand for an empty text; other columns stay as they are, and none of them may be named text."""
    if "text" in encoded.columns:
        raise ValueError("encoded has a column named text")
    at = encoded.columns.index("ids")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in _slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([own.decode(x or b"") for x in batch.column(at).to_pylist()], pa.string())], [*batch.schema.names, "text"])

    return encoded.mapInArrow(back, f"{schema}, text string")
