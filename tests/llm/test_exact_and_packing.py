import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tandem.llm import exact, packing, tokencount
from tandem.llm.tokens import byte_bpe

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["Ab c", "aB C", None, "", "É", "é", "x " * 3000, "X " * 3000, "tie", "tie", "naïve 😀\n\nend"]
SCHEMA = "doc_id long, text string, id string, slot int"


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "other", 1) for i, t in zip(ids, texts, strict=True)], SCHEMA)


@pytest.fixture(scope="module")
def hugging():
    return Tokenizer.from_file(VOCABULARY)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_groups_against_brute_force(spark, keep):
    ids = [*range(len(TEXTS) - 1), None]
    got = {(r["doc_id"], r["text_sha256"]): r for r in exact.exact_groups(table(spark, TEXTS, ids), keep).collect()}
    norm = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") for t in TEXTS]
    for i, n in zip(ids, norm, strict=True):
        same = [2**63 - 1 if j is None else j for j, m in zip(ids, norm, strict=True) if m == n]
        best = max(same) if keep == "largest" else min(same)
        r = got[i, hashlib.sha256(n.encode()).hexdigest()]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (None if best == 2**63 - 1 else best, len(same), (2**63 - 1 if i is None else i) == best)


def test_exact_repeated_rows_and_empty_table(spark):
    rows = table(spark, ["a", "A", "a", "b"], [1, 1, 1, 1])
    got = exact.exact_groups(rows).collect()
    assert sorted((r["group_size"], r["kept"]) for r in got) == [(1, True), (3, False), (3, False), (3, True)]
    assert exact.drop_exact(rows).columns == rows.columns
    assert exact.drop_exact(rows).count() == 2
    assert exact.exact_groups(rows.limit(0)).collect() == []


def test_exact_hot_group_and_plan(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    hot = exact.exact_groups(rows).where("group_size > 1").agg(F.count(F.lit(1)), F.max("keep_id"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(hot) == (1000, 2997, 1)
    assert "Python" not in exact.exact_groups(rows)._jdf.queryExecution().toString()


@pytest.mark.parametrize("text", ["<|endoftext|>", "<|endoftext|> a", "a <|endoftext|>b", "a<|endoftext|>", "<|endoftext|><|endoftext|>", "<|endoftext|", "<<|endoftext|>> é"])
def test_special_strings_are_ids(hugging, spark, text):
    bpe, want = byte_bpe(VOCABULARY), hugging.encode(text, add_special_tokens=False)
    assert bpe.encode(text).tolist() == want.ids
    assert bpe.sizes[want.ids].sum() == len(text.encode())
    (piece,) = packing.pack_documents(table(spark, [text]), VOCABULARY, 64).collect()
    assert (piece["length"], piece["ids_crc32"]) == (len(want.ids) + 1, zlib.crc32(np.array([*want.ids, 0], "<u4").tobytes()))
    (counted,) = tokencount.section_tokens(table(spark, [text + "\n" + text]), VOCABULARY).collect()
    assert counted["n_tokens"] == len(hugging.encode(text + "\n" + text, add_special_tokens=False).ids) and sum(counted["section_tokens"]) == counted["n_tokens"]


def test_ids_equal_the_tokenizers_library(hugging):
    bpe = byte_bpe(VOCABULARY)
    for t in [*TEXTS, "<|endoftext|> it's 12½ …\x85  x", "a b  c \t\r\n"]:
        if t is not None:
            assert bpe.encode(t).tolist() == hugging.encode(t, add_special_tokens=False).ids


def test_cuts():
    assert packing.cuts(5, 2) == [(0, 1), (1, 2), (3, 2)]
    assert packing.cuts(4, 2) == [(0, 2), (2, 2)]
    assert packing.cuts(1, 2) == [(0, 1)]


def best_sum(lengths, room):
    sums = {0}
    for x in lengths:
        sums |= {s + x for s in sums if s + x <= room}
    return max(sums)


def test_minimum_bin_slack_against_brute_force():
    random.seed(5)
    for _ in range(200):
        room = random.randint(1, 25)
        lengths = [random.randint(1, room) for _ in range(random.randint(0, 14))]
        counts = {x: lengths.count(x) for x in lengths}
        assert sum(x * k for x, k in packing.fullest(counts, room).items()) == best_sum(lengths, room)
        left = sorted(lengths, reverse=True)
        for p in packing.minimum_bin_slack(counts, room):
            for _ in range(p.times):
                longest = left.pop(0)
                assert sum(p.lengths) == longest + best_sum(left, room - longest)
                for x in sorted(p.lengths, reverse=True)[1:]:
                    left.remove(x)
        assert not left


def test_pack_documents_is_lossless(spark, hugging):
    texts = [*TEXTS, *["word " * k for k in range(60)]]
    rows = [r.asDict() for r in packing.pack_documents(table(spark, texts), VOCABULARY, 64).collect()]
    for i, t in enumerate(texts):
        ids = [*hugging.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in own] == packing.cuts(len(ids), 64)
        assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in own)
    for s in {r["sequence_id"] for r in rows}:
        own = sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == s)
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist()
        assert sum(n for _, n in own) <= 64
    assert packing.pack_documents(table(spark, []), VOCABULARY, 64).collect() == []


def test_best_fit_decreasing_against_brute_force():
    random.seed(6)
    for _ in range(200):
        capacity = random.randint(1, 30)
        lengths = [random.randint(1, capacity) for _ in range(random.randint(0, 25))]
        rooms = []
        for x in sorted(lengths, reverse=True):
            fits = [i for i, r in enumerate(rooms) if r >= x]
            if fits:
                rooms[min(fits, key=lambda i: rooms[i])] -= x
            else:
                rooms.append(capacity - x)
        bins = packing.best_fit_decreasing(np.array(lengths, int), capacity)
        assert sorted(capacity - sum(lengths[i] for i in b) for b in bins) == sorted(rooms)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))


def test_packed_matrix_round_trip(spark, hugging):
    got: dict[int, dict[int, list[int]]] = {}
    rows = packing.packed_matrix(table(spark, TEXTS), VOCABULARY, 128, window=4).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u2")
        assert len(ids) == 128
        resets = np.flatnonzero(np.unpackbits(np.frombuffer(r["position_resets"], np.uint8), bitorder="little"))
        assert resets.tolist() == r["cu_seqlens"][:-1]
        for d, s, i, j in zip(r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            got.setdefault(d, {})[s] = ids[i:j].tolist()
    for i, t in enumerate(TEXTS):
        assert [x for s in sorted(got[i]) for x in got[i][s]] == [*hugging.encode(t or "", add_special_tokens=False).ids, 0]
    assert packing.packed_matrix(table(spark, []), VOCABULARY).collect() == []


def sections_by_hand(fields):
    """Every field's lines with their ends; the line end that joins two fields closes the last line of the first."""
    out = []
    for k, t in enumerate(fields):
        lines = [x + "\n" for x in t.split("\n")]
        lines[-1] = lines[-1][:-1]
        if len(lines) > 1 and not lines[-1]:
            lines.pop()
        if k < len(fields) - 1:
            lines[-1] += "\n"
        out += [(k, x) for x in lines]
    return out


@pytest.mark.parametrize("rule", tokencount.RULES)
def test_section_tokens_against_library_offsets(spark, hugging, rule):
    texts = ["a b\nc\n\n\nd", "", None, "\n", "né\nü😀x\n", "one  \n  two", "x" * 50 + "\n" * 9 + "y", "z " * 20_000]
    docs = spark.createDataFrame([(None if i == 5 else i, t, f"src{i}\n" if i % 2 else None) for i, t in enumerate(texts)] + [(0, texts[0], None)], "doc_id long, text string, source string")
    rows = tokencount.section_tokens(docs, VOCABULARY, ("source", "text"), rule).collect()
    assert sum(r["doc_id"] == 0 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 1
    got = {r["doc_id"]: r for r in rows}
    for i, t in enumerate(texts):
        parts = sections_by_hand((f"src{i}\n" if i % 2 else "", t or ""))
        whole = "".join(x for _, x in parts)
        edges = np.cumsum([0, *(len(x) for _, x in parts)]).tolist()
        counts, crossing = [0] * len(parts), 0
        for a, b in hugging.encode(whole, add_special_tokens=False).offsets:
            held = [min(b, y) - max(a, x) for x, y in zip(edges, edges[1:], strict=False)]
            inside = [k for k, h in enumerate(held) if h > 0]
            crossing += len(inside) > 1
            counts[{"first": inside[0], "last": inside[-1], "majority": max(inside, key=lambda k: (held[k], -k))}[rule]] += 1
        r = got[None if i == 5 else i]
        assert (r["field"], r["section_tokens"], r["n_crossing"]) == ([k for k, _ in parts], counts, crossing), (t, rule)
        assert (r["n_chars"], r["n_tokens"], r["n_sections"]) == (len(whole), sum(counts), len(parts))
    assert tokencount.section_tokens(docs.limit(0), VOCABULARY, ("source", "text"), rule).collect() == []


def test_packing_of_null_and_repeated_ids(spark):
    docs = table(spark, ["a b", "c d e", "c d e", None], [None, 1, 1, None])
    placed = packing.pack_documents(docs, VOCABULARY, 64).collect()
    assert sorted(str(r["doc_id"]) for r in placed) == ["1", "1", "None", "None"]
    assert len({(r["sequence_id"], r["offset"]) for r in placed}) == 4
    rows = packing.packed_matrix(docs, VOCABULARY, 64).collect()
    assert sorted(str(d) for r in rows for d in r["doc_ids"]) == ["1", "1", "None", "None"]
