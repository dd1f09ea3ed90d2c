"""Token counts of parts of documents, from one encoding of the whole document.

Byte-level tokens cover a text's bytes without gaps, so the running sum of their sizes gives every token's
character span. Spans are joined to sections by binary search, and a token that lies in several sections is
counted in one of them by an explicit rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.storage import require, text_or_empty
from tandem.llm.tokens import byte_bpe

RULES = ("majority", "first", "last")


def token_spans(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and one past the last of each token; data: the text's UTF-8 bytes, sizes: the tokens' numbers of bytes.

    A character whose bytes are split over tokens belongs to the span of each.
    """
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    ends = np.cumsum(sizes)
    return char[ends - sizes], char[ends - 1] + 1


def attribute(starts: np.ndarray, ends: np.ndarray, edges: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """For each token the section it counts in, and whether it lies in several.

    edges: 0, the ends of all sections but the last, and the text's length; sections may be empty. "first" and "last" take the section of
    the token's first and last character; "majority" the one that holds most of its characters, the earliest of equals.
    """
    first = np.searchsorted(edges, starts, "right") - 1
    last = np.searchsorted(edges, ends - 1, "right") - 1
    crossing = last > first
    if rule == "first":
        return first, crossing
    if rule == "last":
        return last, crossing
    section = first.copy()
    for i in np.flatnonzero(crossing):
        own = np.arange(first[i], last[i] + 1)
        held = np.minimum(edges[own + 1], ends[i]) - np.maximum(edges[own], starts[i])
        section[i] = own[np.argmax(held)]
    return section, crossing


def section_edges(fields: list[str], chars: list[np.ndarray]) -> np.ndarray:
    """Edges of the lines of each field in the document that joins the fields by a line end; a line end closes its line.

    chars: each field's code points.
    """
    edges, at = [0], 0
    for k, code in enumerate(chars):
        breaks = np.flatnonzero(code == 10) + 1
        edges += (at + breaks[breaks < len(code)]).tolist()
        at += len(code) + (k < len(fields) - 1)
        if k < len(fields) - 1:
            edges.append(at)
    return np.array([*edges, at])


def section_tokens(docs: DataFrame, vocabulary: str, fields: tuple[str, ...] = ("text",), rule: str = "majority") -> DataFrame:
    """Tokens of every field and line of each document.

    A document is its fields joined by a line end, encoded once and whole. Returns doc_id, n_chars, n_tokens, n_sections, n_crossing (tokens that lie
    in several sections), field (of each section the index of its field) and section_tokens (of each section its number of tokens; their sum is n_tokens).
    A field that ends in a line end has no empty line after it. Null fields count as empty, and an empty document is one section
    without tokens. Repeated rows give repeated results, an empty table none; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule is {rule!r}")
    require(docs, "doc_id", *fields)
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64()), ("n_sections", pa.int64()), ("n_crossing", pa.int64()), ("field", pa.list_(pa.int32())), ("section_tokens", pa.list_(pa.int64()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocabulary)
        for batch in batches:
            out = []
            columns = [batch[f"f{k}"] for k in range(len(fields))]
            for row, doc_id in enumerate(batch["doc_id"].to_pylist()):
                own = [c[row].as_py() for c in columns]
                whole = "\n".join(own)
                chars = [np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in own]
                edges = section_edges(own, chars)
                field = np.searchsorted(np.cumsum([len(c) + 1 for c in chars]), edges[:-1], "right").clip(max=len(own) - 1)
                ids = bpe.encode(whole)
                counts, crossing = np.zeros(len(edges) - 1, np.int64), np.zeros(0, bool)
                if len(ids):
                    starts, ends = token_spans(np.frombuffer(whole.encode(), np.uint8), bpe.sizes[ids])
                    section, crossing = attribute(starts, ends, edges, rule)
                    counts = np.bincount(section, minlength=len(edges) - 1)
                out.append((doc_id, len(whole), len(ids), len(counts), int(crossing.sum()), field.tolist(), counts.tolist()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(text_or_empty(c).alias(f"f{k}") for k, c in enumerate(fields)))
    return texts.mapInArrow(count, "doc_id long, n_chars long, n_tokens long, n_sections long, n_crossing long, field array<int>, section_tokens array<long>")
