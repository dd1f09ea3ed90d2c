import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tandem.llm import periodic, ranked, wordbpe
from tandem.llm.words import scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, id string, score int, words string, item long, part int"
BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark, rows):
    """doc_id and text, with other columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "other", 1, "other", 1, 1) for i, t in rows], SCHEMA)


# --- ranked lexical search ---


def ranked_by_hand(docs, items, k):
    terms = lambda t: TERM.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    own = [(i, terms(t)) for i, t in docs]
    own = [(i, w) for i, w in own if w]
    n_docs, n_terms = len(own), sum(len(w) for _, w in own)
    out = []
    for item_id, text in set(items):
        found = []
        for i, w in own:
            score = 0
            for t in terms(text):
                tf, df = w.count(t), sum(t in set(x) for _, x in own)
                m = 75 + 25 * len(w) * n_docs // n_terms
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (10**9 * tf // (1000 * tf + 12 * m))
            if score:
                found.append((-score, 2**63 - 1 if i is None else i, i))
        out += [(item_id, r, i, -s) for r, (s, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def search_corpus(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "émile", "x1", "İ", *(f"w{i}" for i in range(30))]
    weight = [20, 10, *([3] * 3), *(30 / (1 + i) for i in range(30))]
    docs = [(i, rng.choice([" ", "-", "\n"]).join(rng.choices(words, weight, k=rng.randint(0, 40)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " .,!\n"), (None, docs[3][1]), (None, docs[4][1]), (5, docs[5][1]), (n + 3, docs[5][1]), (n + 4, "the w1 " * 3000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 9)))) for i in range(12)]
    return docs, [*items, items[2], (3, "w3 w3 the"), (3, None), (None, "w4"), (20, ""), (21, "unheard")]


@pytest.mark.parametrize(("seed", "n", "k", "rows", "block"), [(1, 150, 5, 8192, 1 << 22), (2, 200, 3, 16, 200), (3, 60, 20, 8192, 1 << 22)])
def test_search_against_brute_force(spark, monkeypatch, seed, n, k, rows, block):
    monkeypatch.setattr(ranked, "DOCS", rows)
    monkeypatch.setattr(ranked, "BLOCK_BYTES", block)
    docs, items = search_corpus(seed, n)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, number int")
    got = ranked.search(table(spark, docs).repartition(5), asked, k).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got), key=str) == ranked_by_hand(docs, items, k)


def test_search_of_nothing(spark):
    docs, items = table(spark, []), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked.search(docs, items).count() == 0
    assert ranked.search(table(spark, [(1, "a b")]), items.limit(0)).count() == 0
    assert ranked.search(table(spark, [(1, None)]), items).count() == 0


def test_accumulators_are_limited_and_results_are_not():
    import pyarrow as pa

    rng = random.Random(5)
    texts = [" ".join(["the"] * 3 + rng.choices([f"c{i}" for i in range(400)], k=20)) for _ in range(3000)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(3000)), "text": texts})
    items = ranked.Items(["the c1 c2 c3"])
    (row,) = ranked._index(iter([batch]), items.codes)
    arrays = [np.frombuffer(row[c][0].as_buffer(), kind) for c, kind in zip(ranked._ARRAYS, ("<i4", "<i4", np.int64, np.int64, "<i4", "<i4"), strict=True)]
    holding = arrays[1].astype(np.int64)
    few, all_ = (ranked.Ranking(items, holding, 3000, 23 * 3000, k) for k in (20, 3000))
    few.add(*arrays)
    all_.add(*arrays)
    assert few.made < 700 < all_.made == 3000
    assert [x[:20].tolist() for x in all_.best[0]] == [x.tolist() for x in few.best[0]]


# --- periodic runs ---


def runs_by_hand(w, least=12):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            a = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - a + q >= max(least, 2 * q):
                out.setdefault((a, i - a + q), q)
            i += 1
    return sorted(((a, n, q) for (a, n), q in out.items()), key=lambda r: (r[0], r[2]))


def digest_by_hand(i, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(i).encode())
    if i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p, old = 1 + (n - a) // (3 + g % 8), list(w)
        w[a:] = [old[a + (j - a) % p] for j in range(a, n)]
    runs = runs_by_hand(w)
    lost = {j for a, m, q in runs for j in range(a + q, a + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return i, len(runs), *four, sha("".join(f"{a},{m},{q}\n" for a, m, q in runs)), sha(" ".join(x for j, x in enumerate(w) if j not in lost))


def periodic_texts(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = rng.choices("abcdefghé"[: rng.choice([1, 2, 3, 9])], k=rng.choice([0, 1, 11, 12, 13, 24, 60, 150]))
        if w and rng.random() < 0.7:
            a = rng.randrange(len(w))
            p = 1 + rng.randrange(max(1, (len(w) - a) // 2))
            w[a:] = [w[a + (j - a) % p] for j in range(a, len(w))]
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = "Z"
        out.append(rng.choice([" ", "\n\t"]).join(w))
    return out


def test_runs_against_brute_force(spark):
    rows = [*enumerate(periodic_texts(4, 300)), (300, None), (301, ""), (302, " \n"), (None, "a b " * 9), (5, "x " * 30), (5, "x " * 30)]
    got = periodic.run_digests(periodic.with_periods(table(spark, rows)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((digest_by_hand(i, t) for i, t in rows), key=str)
    assert periodic.periodic_runs(table(spark, [])).count() == 0


def test_a_run_of_a_very_long_text(spark):
    text = "head " + "long one " * 20000 + "tail"
    (row,) = periodic.periodic_runs(table(spark, [(1, text)])).collect()
    assert (row.n_words, [tuple(r) for r in row.runs], row.collapsed) == (40002, [(1, 40000, 2)], "head long one tail")


@pytest.mark.parametrize("least", [2, 3, 7, 12, 40])
def test_runs_of_any_least_length(least):
    import pyarrow as pa

    texts = periodic_texts(least, 200)
    (words,) = scan(pa.array(texts))
    got = [[] for _ in texts]
    for d, *run in zip(*(x.tolist() for x in periodic.find_runs(words.code, words.first, least)), strict=True):
        got[d].append(tuple(run))
    assert got == [runs_by_hand(WORD.findall(t), least) for t in texts]


# --- BPE with word ends ---


def bpe_texts():
    rng = random.Random(7)
    letters = "aabbttsre'll'd 1!é ßΣσ中文́\n<|>endoftext"
    special = ["<|endoftext|>", "a<|endoftext|>b", "<|endoftext|><|endoftext|> x", "x <|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|> É<|endoftext|>́"]
    odd = ["", " ", "It's we'll can't 'rest '' ''s !'s 1's DON'T", "ΣΑΣ İı ﬁ Å", "\x1c a\x85b", "Ᲊ a՘b \U0003fc3b", "aaaa" * 300, "ab" * 501]
    return [*special, *odd, *("".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(400))]


@pytest.mark.parametrize("chars", [1 << 21, 40])
def test_bpe_against_library(monkeypatch, chars):
    monkeypatch.setattr(wordbpe, "SLICE_CHARS", chars)
    bpe, library, texts = wordbpe.word_bpe(BPE), Tokenizer.from_file(BPE), bpe_texts()
    ids, first = bpe.encode(texts)
    for i, want in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        own = ids[first[i] : first[i + 1]]
        assert own.tolist() == want.ids, texts[i]
        assert bpe.decode(own) == library.decode(want.ids, skip_special_tokens=False)


def test_every_kind_of_character_against_library():
    bpe, library = wordbpe.word_bpe(BPE), Tokenizer.from_file(BPE)
    texts = [f"a{chr(c)}b{chr(c)}1" for c in range(0, 0x110000, 7) if not 0xD800 <= c <= 0xDFFF]
    ids, first = bpe.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_merges_of_lower_rank_come_first(tmp_path):
    """A merge whose product is merged at a lower rank is done once, then the other."""
    import json

    with open(BPE, encoding="utf-8") as f:
        spec = json.load(f)
    letters = list(spec["model"]["vocab"])[:512]
    merges = ["b c", "a bc", "abc a", "a b", "ab c", "c a</w>"]
    tokens = [*letters, "bc", "abc", "abca", "ab", "ca</w>"]
    spec["model"] |= {"vocab": {t: i for i, t in enumerate(tokens)}, "merges": merges}
    for token, i in zip(spec["added_tokens"], (len(tokens), len(tokens) + 1), strict=True):
        token["id"] = i
    path = tmp_path / "small.json"
    path.write_text(json.dumps(spec))
    bpe, library = wordbpe.WordBpe(str(path)), Tokenizer.from_file(str(path))
    rng = random.Random(1)
    texts = ["".join(rng.choices("abc", k=rng.randint(1, 12))) for _ in range(500)]
    ids, first = bpe.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [x.ids for x in library.encode_batch(texts)]


def test_bpe_tables(spark):
    library = Tokenizer.from_file(BPE)
    rows = [*enumerate(bpe_texts()[:40]), (40, None), (41, ""), (None, "no id"), (3, "again"), (3, "again"), (42, "long text here " * 20000)]
    encoded = wordbpe.encode(table(spark, rows), BPE)
    got = {(r.doc_id, tuple(r.ids), r.text) for r in wordbpe.decode(encoded.withColumn("text", F.lit(1)), BPE).collect()}
    want = [(i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert got == {(i, ids, library.decode(list(ids), skip_special_tokens=False)) for i, ids in want}
    assert encoded.count() == len(rows)
    assert wordbpe.decode(wordbpe.encode(table(spark, []), BPE), BPE).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, [-1, 10**6, None])], "doc_id long, ids array<int>")
    assert [r.text for r in wordbpe.decode(nothing, BPE).collect()] == ["", ""]
