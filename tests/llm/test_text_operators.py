import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tandem.llm import blobs, exact, jaccard, media, parsing, pieces, skew, substring, toxicity, warc
from tandem.llm.components import least_labels
from tandem.llm.words import scan, shingles

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, id string, bucket int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "other", 1) for i, t in rows], SCHEMA)


def corpus(seed, n, words=12, length=60):
    """Random texts, copies, near copies, shared passages, and odd rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(words)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, length))) for _ in range(n)]
    passage = " ".join(rng.choices(vocabulary, k=20))
    for i in range(0, n, 3):
        texts[i] = rng.choice(["", texts[i], texts[i] + "\n"]) + passage + rng.choice(["", " tail", "\t\t"])
    for i in range(1, n, 7):
        source = texts[rng.randrange(n)].split()
        if source:
            source[rng.randrange(len(source))] = "edit"
        texts[i] = " ".join(source).replace("a", rng.choice("aA"))
    return [*enumerate(texts), (n, None), (n + 1, ""), (n + 2, " \n "), (None, texts[0]), (n + 3, texts[2]), (n + 3, texts[2])]


def test_words_against_regular_expressions():
    texts = ["", "a", " a  b\x0b", None, "é\x85ü b", "x" * 5000, "a\tb\nc\rd\x0ce"] * 3
    seen = []
    for w in scan(pa.array(texts)):
        for d in range(len(w.first) - 1):
            seen.append([w.data[s:e].tobytes().decode() for s, e in zip(w.start[w.first[d] : w.first[d + 1]], w.end[w.first[d] : w.first[d + 1]], strict=True)])
    assert seen == [WORD.findall(t or "") for t in texts]
    w = next(scan(pa.array(["a b c a b", "A B", "c a b"]), fold=True))
    code, valid = shingles(w, 2)
    assert valid.tolist() == [True, True, True, True, False, True, False, True, True, False]
    assert code[0] == code[3] == code[5] == code[8] != code[1]


# --- substring ---


def cut_by_hand(rows, width):
    words = [WORD.findall(t or "") for _, t in rows]
    key = lambda i: 2**63 - 1 if i is None else i
    first = {}
    for (i, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - width + 1):
            x = tuple(w[k : k + width])
            first[x] = min(first.get(x, key(i)), key(i))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        lost = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < key(i):
                lost[k : k + width] = [True] * width
        out.append((i, len(w), sum(lost), hashlib.sha256(" ".join(x for x, gone in zip(w, lost, strict=True) if not gone).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "width", "words"), [(1, 13, 12), (2, 6, 3), (3, 5, 2)])
def test_substring_against_brute_force(spark, seed, width, words):
    rows = corpus(seed, 80, words)
    got = substring.repeat_digests(table(spark, rows), width).collect()
    assert sorted(map(tuple, got), key=str) == cut_by_hand(rows, width)


@pytest.mark.parametrize("most", [300, 2000, 1 << 26])
def test_parsing_against_brute_force(spark, most):
    rows = corpus(4, 80, 3)
    got = parsing.parsed_repeats(table(spark, rows), 6, most).collect()
    assert sorted(map(tuple, got), key=str) == cut_by_hand(rows, 6)
    assert parsing.parsed_repeats(table(spark, []), 6, most).collect() == []


def test_common_phrase_is_one_row_of_a_batch():
    n = 1000
    same = np.full(n, 7, np.uint64)
    e = blobs.Entries(np.arange(n), np.arange(n), same, np.arange(n, dtype=np.uint64), np.zeros(n, np.uint32))
    rows = substring._thinned(e, 16, substring.FACTOR, substring.BORDER)
    count = lambda kind: sum(len(np.frombuffer(r[4], np.uint32)) for r in rows if r[1] == kind)
    assert (count(substring.INDEX), count(substring.TOLD), count(substring.BORDER)) == (0, 1, n)
    assert len({r[0] for r in rows if r[1] == substring.BORDER}) == 16
    # equal factors are settled at once, and one document alone goes on as it is
    e = e._replace(b=np.zeros(n, np.uint64))
    rows = substring._thinned(e, 16, substring.FACTOR, substring.BORDER)
    assert (count(substring.INDEX), count(substring.TOLD), count(substring.FACTOR)) == (1, 0, n - 1)


def test_substring_of_a_common_phrase(spark):
    rng = random.Random(9)
    phrase = "this notice must be kept with every copy of the text and its parts"
    rows = [(i, " ".join([*(f"{i}x{k}" for k in range(rng.randint(0, 20))), phrase, *(f"{i}y{k}" for k in range(20))])) for i in range(150)]
    rows += [(200, f"{rows[3][1]} {rows[7][1]}"), (201, "w " * 30_000)]
    assert sorted(map(tuple, substring.repeat_digests(table(spark, rows)).collect()), key=str) == cut_by_hand(rows, 13)


def clashing(spark, rows):
    """rows with further columns that are called what operators might call theirs."""
    names = ["_id", "_key", "_digest", "_n_words", "n_words", "id", "row", "key", "digest", "code", "head", "a.b", "c0"]
    return spark.createDataFrame([(i, t, *range(len(names))) for i, t in rows], ", ".join(["doc_id long", "text string", *(f"`{n}` int" for n in names)]))


@pytest.mark.parametrize("drop", [exact.drop_exact, jaccard.drop_near, substring.drop_repeats, lambda d: toxicity.drop_toxic(d, d.selectExpr("doc_id", "0 AS toxic").limit(0))])
def test_stages_keep_columns_of_any_name(spark, drop):
    docs = clashing(spark, [(1, "a b c d e f"), (2, "x y z"), (None, None), (4, "A b c d e f")])
    out = drop(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) >= 3 and all(tuple(r)[2:] == tuple(range(13)) for r in rows)
    assert drop(docs.limit(0)).collect() == []


def test_split_joins(spark):
    rows = [(1 if i % 3 else i, i) for i in range(3000)]
    many, one = spark.createDataFrame(rows, "k long, v long"), spark.createDataFrame([(i, -i) for i in range(0, 3000, 2)] + [(1, 5)], "k long, w long")
    counts = many.groupBy("k").agg(F.count(F.lit(1)).alias("rows"))
    hot = skew.hot_keys(counts, ["k"], 3000)
    assert [r["k"] for r in hot.collect()] == [1] and hot.first()["_parts"] > 1
    for how in ("inner", "left"):
        got = skew.split_join(many, one, ["k"], hot, F.col("v"), how).select("k", "v", "w")
        assert sorted(got.collect(), key=str) == sorted(many.join(one, "k", how).select("k", "v", "w").collect(), key=str)
    assert skew.hot_keys(counts.where("k <> 1"), ["k"], 3000) is None


def test_substring_keeps_columns_and_untouched_texts(spark):
    passage = " ".join(f"w{i}" for i in range(15))
    rows = [(1, f"a\t{passage}  z"), (2, f"b  {passage}\n c\n"), (3, " as  is\n"), (4, None)]
    docs = table(spark, rows)
    out = substring.drop_repeats(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: rows[0][1], 2: "b  c\n", 3: " as  is\n", 4: None}
    assert substring.repeat_digests(table(spark, [])).collect() == []


# --- n-gram Jaccard ---


def near_by_hand(rows, k, num, den):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(fold))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = [2**63 - 1 if i is None else i for i, _ in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return sorted(((i, len(s), None if x == 2**63 - 1 else x) for (i, _), s, x in zip(rows, sets, label, strict=True)), key=str)


@pytest.mark.parametrize(("seed", "k", "num", "words"), [(1, 4, 85, 12), (2, 5, 80, 30), (3, 2, 60, 8)])
def test_near_classes_against_brute_force(spark, seed, k, num, words):
    rows = corpus(seed, 90, words)
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(90)]
    for n in range(200, 260):  # a chain of near copies
        base[rng.randrange(90)] = f"n{n}"
        rows.append((n, " ".join(base)))
    got = jaccard.near_classes(table(spark, rows), k, num, 100).collect()
    assert sorted(map(tuple, got), key=str) == near_by_hand(rows, k, num, 100)


def test_near_classes_edges(spark):
    assert jaccard.near_classes(table(spark, [])).collect() == []
    hot = [(i, " ".join(f"w{k}" for k in range(40)) + (f" own{i}" if i % 2 else "")) for i in range(300)]
    assert {r["component_id"] for r in jaccard.near_classes(table(spark, hot)).collect()} == {0}
    assert jaccard.drop_near(table(spark, [*hot, (900, None), (901, "")])).count() == 3


def test_drop_near_with_null_and_repeated_ids(spark):
    text = lambda name, edit="": " ".join(f"{name}{i}" for i in range(40)) + edit
    groups = [
        [(1, text("a")), (None, text("a", " x"))],  # a null id's near copy of a smaller id
        [(None, text("b")), (None, text("b", " x")), (None, text("b", " y"))],  # null ids alone
        [(5, text("c")), (5, text("c", " x"))],  # the smallest id twice, with near texts
        [(2, text("d")), (6, text("d", " x"))],  # 6 goes here
        [(6, text("e"))],  # and stays here
        [(7, text("f")), (7, text("f"))],  # a repeated row
        [(None, text("g")), (None, text("g"))],
        [(None, text("h"))],  # unrelated to all others
    ]
    wordless = [(None, None), (None, " "), (9, ""), (9, "")]
    for seed in range(2):
        rows = [*(r for g in groups for r in g), *wordless]
        random.Random(seed).shuffle(rows)
        kept = [tuple(r) for r in jaccard.drop_near(table(spark, rows)).select("doc_id", "text").collect()]
        for g in groups:
            left = [r for r in kept if r in g]
            assert len(left) == 1, g
            assert left[0][0] == min((i for i, _ in g if i is not None), default=None)
        assert len(kept) == len(groups) + len(wordless)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10 != 9] + [(50, 3)], "a long, b long")
    vertices = spark.createDataFrame([(i, i % 7) for i in range(60)], "v long, label long")
    got = {r["v"]: r["label"] for r in least_labels(vertices, edges).collect()}
    group = lambda v: 0 if v == 50 else v // 10 if v <= 40 else v
    assert all(got[v] == min(u % 7 for u in range(60) if group(u) == group(v)) for v in range(60))


# --- media ---


def test_media_round_trip(spark):
    rows = [*corpus(4, 30), (77, "x" * 100_000), (78, "é" * 96)]
    got = sorted(media.text_media(table(spark, rows)).collect(), key=lambda r: (str(r["doc_id"]), r["payload_sha256"]))
    want = []
    for i, t in rows:
        data = (t or "").encode()
        payload = data + b" " * (-len(data) % 192 or (192 if not data else 0))
        stored = media.to_png(payload)
        assert media.from_png(stored) == payload
        want.append((i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), media.image_feature(payload)))
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: (str(r[0]), r[3]))


def test_media_append_overwrite_and_failed_tasks(spark, tmp_path):
    path, rows = str(tmp_path / "a"), lambda: sorted(r["doc_id"] for r in media.media_rows(spark, path).collect())
    media.store_texts(table(spark, [(1, "a"), (2, "b")]).repartition(2), path)
    media.store_texts(table(spark, [(3, "c")]), path)
    media.store_texts(table(spark, []), path)
    assert rows() == [1, 2, 3]

    def failing(batches):
        yield from batches
        raise RuntimeError("after its rows were written")

    stored = table(spark, [(4, "d"), (5, "e")]).repartition(2).select("doc_id", F.lit(1).cast("long").alias("n_bytes"), F.lit(b"x").alias("media"))
    with pytest.raises(Exception, match="after its rows"):
        stored.mapInArrow(failing, media.SCHEMA).write.format("media_archive").mode("append").option("path", path).save()
    assert rows() == [1, 2, 3]
    listed = {name for m in media._manifests(*media._open(path)).values() for name, _ in m}
    assert {f.name for f in (tmp_path / "a").iterdir() if f.name.endswith(".archive")} == listed
    media.store_texts(table(spark, [(6, "f")]), path, "overwrite")
    assert rows() == [6]
    media.store_texts(table(spark, [(7, "g"), (6, "f")]), path)
    assert rows() == [6, 6, 7]
    assert sum(f.name.endswith(".archive") for f in (tmp_path / "a").iterdir()) == len({name for m in media._manifests(*media._open(path)).values() for name, _ in m})


def test_media_byte_ranges_and_retries(spark, tmp_path):
    docs = table(spark, corpus(5, 40))
    media.store_texts(docs, str(tmp_path / "a"))
    wide = media.media_rows(spark, str(tmp_path / "a"))
    fine = spark.read.format("media_archive").option("path", str(tmp_path / "a")).option("range_bytes", 500).option("batch_bytes", 300).load()
    assert fine.rdd.getNumPartitions() > wide.rdd.getNumPartitions()
    assert sorted(map(str, fine.collect())) == sorted(map(str, wide.collect()))

    class Flaky:
        failures = 2

        def open_input_file(self, path):
            if self.failures:
                self.failures -= 1
                raise OSError("gone")
            return pa.OSFile(path)

    path = str(next((tmp_path / "a").glob("*.archive")))
    system, name = media._open(path)
    entry = media.read_directory(system, name)[0]
    good = media.read_member(system, name, int(entry["offset"]), int(entry["length"]), int(entry["crc32"]))
    with pytest.raises(media.MemberError):
        media.read_member(system, name, int(entry["offset"]), int(entry["length"]), int(entry["crc32"]) ^ 1, wait_s=0)

    class Wrapped(Flaky):
        def open_input_file(self, path):
            super().open_input_file(path)
            return system.open_input_file(path)

    assert media.read_member(Wrapped(), name, int(entry["offset"]), int(entry["length"]), int(entry["crc32"]), wait_s=0) == good
    media.store_texts(table(spark, []), str(tmp_path / "b"))
    assert media.media_rows(spark, str(tmp_path / "b")).collect() == []


# --- SentencePiece ---


@pytest.fixture(scope="module")
def library():
    """The library's own search over the same pieces; its 32-bit sums need scores of moderate size."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        p.score = max(p.score, -40000)
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def test_pieces_equal_the_librarys_best_path(library):
    own = pieces.pieces(MODEL)
    for t in ["Hello world", "the of theouation", "Größe naïve 12345,67 (x)", "internationalisation", "a"]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t)


def test_fractional_scores_against_the_library(tmp_path, spark):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    kept = [p for p in model.pieces if p.type not in (1, 4)]
    del model.pieces[:]
    model.pieces.extend(kept)
    rng = random.Random(4)
    pieces_ = ["▁", "a", "b", "c", "ab", "ba", "abc", "▁a", "▁ab", "bc", "cab", "aa"]
    for piece in pieces_:
        model.pieces.add(piece=piece, score=-rng.uniform(1, 4) * (1 if len(piece) > 1 else 1.7), type=1)
    model.trainer_spec.model_type = 1
    path = str(tmp_path / "few.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    theirs, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Pieces(path)
    texts = ["".join(rng.choices("abc  ", k=rng.randint(1, 25))) for _ in range(200)]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == theirs.encode(t), t
    got = {r["doc_id"]: bytes(r["ids"]) for r in pieces.encode(table(spark, list(enumerate(texts))), path, 4).collect()}
    assert got == {i: own.encode(t) for i, t in enumerate(texts)}


def test_scan_in_two_levels():
    own = pieces.pieces(MODEL)
    parts = [own.transfer(p, s) for _, p, s in pieces.chunks(own.escaped("internationalisation of things, " * 4), 6, own.longest - 1)]
    whole = pieces.weights_before(parts)
    middle = len(parts) // 2
    begin = pieces.weights_before([pieces.product(parts[:middle]), pieces.product(parts[middle:])])[1]
    assert pieces.weights_before(parts[middle:], begin) == whole[middle:]


def test_pieces_do_not_depend_on_cuts(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices(["the", "tion", " ", "é", "\n", "😀", "▁", "zq", "  "], k=rng.randint(0, 200))) for _ in range(40)] + ["ab" * 400, "", None]
    own = pieces.pieces(MODEL)
    docs = table(spark, list(enumerate(texts)) + [(7, texts[7])])
    for size in (5, 40):
        got = pieces.decode(pieces.encode(docs, MODEL, size), MODEL).collect()
        assert len(got) == len(texts) + 1
        for r in got:
            t = texts[r["doc_id"]] or ""
            assert bytes(r["ids"]) == own.encode(t)
            assert r["text"] == t.replace("▁", " ")
    mats = [own.transfer(p, s) for _, p, s in pieces.chunks(own.escaped("internationalisation of things"), 7, own.longest - 1)]
    assert pieces.combine(pieces.combine(mats[0], mats[1]), mats[2]) == pieces.combine(mats[0], pieces.combine(mats[1], mats[2]))


# --- toxicity ---


def test_label_model_finds_the_weak_voter():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.2
    good = [(rng.random(4000) < 0.7) & truth for _ in range(5)]
    noise = rng.random(4000) < 0.02
    votes = np.array([*good, good[0], noise]).T
    rows, inverse, times = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post = toxicity.label_model(rows, times.astype(float), 0.2)[0][inverse.ravel()]
    assert ((post > 0.5) == truth).mean() > 0.98
    assert post[noise & ~votes[:, :6].any(axis=1)].mean() < 0.5


def test_lexicon_words_are_known_without_labels(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices([f"word{k}" for k in range(50)], k=20)) + (" slurword vile" if i % 5 == 0 else "")) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(table(spark, [*rows, (1000, "word1 word2 Trottel word3"), (1001, "word1 word2 word3"), (1002, "Des imbéciles word1")]), labels).collect()}
    assert (got[1000], got[1001], got[1002]) == (1, 0, 1)


def test_toxicity_held_out(spark):
    rng = random.Random(3)
    plain = [f"word{i}" for i in range(200)]
    rows, marks = [], []
    for i in range(900):
        words = rng.choices(plain, k=30)
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(30), rng.choice(["nasty", "vile", "slurword", "slurthing"]))
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    docs = table(spark, [*rows, (None, "nasty vile"), (5000, None), (5001, "")])
    labels = spark.createDataFrame([*marks, (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    truth = dict(marks)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert held and all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) > 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id in (5000, 5001)").count() == 2
    none = toxicity.toxicity(docs, labels.limit(0)).select("score").distinct().collect()
    assert len(none) == 1
    assert toxicity.toxicity(table(spark, []), labels).collect() == []


# --- web archives ---


def test_canonical_urls(spark):
    same = [
        ("http://A.org/x?pref=1", "a.org/x?pref=1"), ("a.org/x?xref=5&a=1", "a.org/x?xref=5&a=1"), ("https://www.a.org/x/?ref=q&b=2&utm_source=z#top", "a.org/x?b=2"), ("a.org/?ref", "a.org"), ("a.org?&&b=1&", "a.org?b=1"),
        ("http://m.example", "m.example"), ("http://m.example.com/", "example.com"), ("http://www.m.org/A?B=C", "m.org/A?B=C"), ("", ""), (None, None), ("a.org/x?utm_=1&u=utm_a=2", "a.org/x?utm_=1&u=utm_a=2"),
    ]
    urls = spark.createDataFrame(same, "url string, want string")
    for r in urls.select("url", "want", warc.canonical_url(F.col("url")).alias("got")).collect():
        assert r["got"] == r["want"], r


def test_repeated_and_tied_records(spark):
    row = lambda i, seq, kind, tag: (i, seq, "http://a.org/x", kind, {"etag": tag}, "D" if kind == "response" else None)
    rows = [row(1, 5, "response", "1"), row(2, 5, "response", "2"), row(3, 5, "revisit", "2"), row(3, 5, "revisit", "2"), row(1, 5, "response", "1")]
    records = spark.createDataFrame(rows, "record_id long, seq long, url string, kind string, headers map<string,string>, digest string")
    got = warc.resolve_revisits(records).collect()
    assert [(r["record_id"], r["state"], r["refers_to"]) for r in got] == [(3, "resolved", 2)] * 2
    assert warc.slot_size(records) == warc.SLOT_RECORDS
    assert warc.slot_size(spark.range(1).selectExpr("0L AS seq").union(spark.range(1).selectExpr("4096000000L AS seq"))) == 1_000_001


def test_revisits_by_hand(spark):
    h = lambda **x: {k.replace("_", "-"): v for k, v in x.items()}
    rows = [
        (1, 10, "http://www.A.org/x/?utm_source=q", "response", h(etag="1", date="d1", content_length="5"), "D1"),
        (2, 20, "https://a.org/x", "revisit", h(etag="W/1", date="d2", content_length="0", expires="e"), None),
        (3, 30, "a.org/x#f", "response", h(etag="2", last_modified="m"), "D3"),
        (4, 40, "http://a.org/x", "revisit", h(etag="1"), None),
        (5, 50, "http://a.org/x", "revisit", h(last_modified="m", server="s"), None),
        (6, 5, "http://a.org/x", "revisit", h(etag="1"), None),
        (7, 60, None, "revisit", h(etag="1"), None),
        (8, 60, "http://b.org", "request", h(), None),
    ]
    records = spark.createDataFrame(rows, "record_id long, seq long, url string, kind string, headers map<string,string>, digest string").withColumn("canonical", F.lit("clash"))
    for slot in (1, 7, 1000):
        got = {r["record_id"]: (r["state"], r["refers_to"], r["digest"], r["headers"]) for r in warc.resolve_revisits(records, slot).collect()}
        assert got == {
            2: ("resolved", 1, "D1", h(etag="W/1", date="d2", content_length="5", expires="e")),
            4: ("changed", None, None, h(etag="1")),
            5: ("resolved", 3, "D3", h(etag="2", last_modified="m")),
            6: ("missing", None, None, h(etag="1")),
            7: ("missing", None, None, h(etag="1")),
        }
    assert warc.resolve_revisits(records.limit(0)).collect() == []
