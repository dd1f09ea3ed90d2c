"""The pipeline's stages one by one, each against brute force on its own input."""

import random

import pytest
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from test_text_operators import WORD, cut_by_hand

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(21)
    plain = [f"word{i}" for i in range(400)]
    texts = [rng.choices(plain, k=rng.randint(30, 90)) for _ in range(120)]
    passage = rng.choices(plain, k=40)
    rows = []
    for i, words in enumerate(texts):
        if i % 6 == 0:
            words = [*words[:10], "slurword", "vileterm", *words[10:], "slurword"]
        if i % 10 == 1:
            words = [*words[:7], *passage, *words[7:]]
        rows.append((i, " ".join(words)))
    near = rows[5][1].split()
    near[3] = "edited"
    rows += [(200, rows[3][1].upper()), (201, rows[3][1]), (202, " ".join(near)), (None, rows[8][1]), (None, " ".join(rng.choices(plain, k=50))), (None, None), (7, "quite another text with the number seven in it"), (204, ""), (203, ""), (205, "\n"), (9, rows[9][1]), (9, rows[9][1])]
    rng.shuffle(rows)
    return [(i, t, "en", "a" if k % 3 else None, None if t is None else len(t)) for k, (i, t) in enumerate(rows)]


def key(i):
    return 2**63 - 1 if i is None else i


def fold(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_stages(spark, corpus, tmp_path):
    labels = spark.createDataFrame([(i, int("slurword" in (t or "")), 1) for i, t, *_ in corpus if i is not None], "doc_id long, toxic int, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(corpus, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages, before = dict(corpus_pipeline.STAGES), None
    assert list(stages) == ["toxicity", "exact_dedup", "ngram_jaccard", "substring_dedup", "best_fit_packing"]
    found = {}
    for name in list(stages)[:-1]:
        out = stages[name](spark, docs, str(tmp_path))
        assert out.schema.names == docs.schema.names
        before, found[name] = docs, (rows := [tuple(r) for r in out.collect()])
        docs = spark.createDataFrame(rows, SCHEMA)

    kept = found["toxicity"]
    assert sorted(kept, key=str) == sorted((r for r in corpus if "slurword" not in (r[1] or "")), key=str)

    groups = {}
    for r in kept:
        groups.setdefault(fold(r[1]), []).append(r)
    left = found["exact_dedup"]
    assert len(left) == len(groups)
    assert all(key(r[0]) == min(key(x[0]) for x in groups[fold(r[1])]) for r in left) and set(left) <= set(kept)

    pairs = [r[:2] for r in left]
    label = {}
    for (i, t), c in zip(pairs, (x for _, x in classes(pairs)), strict=True):
        label.setdefault(c, []).append((key(i), t))
    stay = found["ngram_jaccard"]
    assert len(stay) == len(label) and set(stay) <= set(left)
    assert sorted(key(r[0]) for r in stay) == sorted(min(x)[0] for x in label.values())

    cut = found["substring_dedup"]
    want = cut_by_hand([r[:2] for r in stay], 13)
    assert len(cut) == len(stay)
    assert sorted((str(r[0]), len(WORD.findall(r[1] or ""))) for r in cut) == sorted((str(i), n - gone) for i, n, gone, _ in want)
    assert any(gone for _, _, gone, _ in want) and sorted(map(str, (r[2:] for r in cut))) == sorted(map(str, (r[2:] for r in stay)))

    hugging = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    placed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["length"]) for r in placed) == sorted((str(r[0]), len(hugging.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in cut)
    by = {}
    for r in placed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048


def classes(pairs):
    """(row, component) of every row: components of near copies by brute force, a row without words alone."""
    sets = []
    for _, t in pairs:
        w = WORD.findall(fold(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    of = list(range(len(pairs)))
    for _ in pairs:
        for a in range(len(pairs)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    of[a] = of[b] = min(of[a], of[b])
    return list(zip(pairs, of, strict=True))


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_what_a_group_freed_leaves_the_worker():
    import numpy as np
    import psutil

    from tandem.llm.storage import give_back

    held = [np.ones(6000) for _ in range(2000)]  # 96 MB in pieces too small for maps of their own
    last = np.ones(6000)  # keeps the heap's end in use
    del held
    before = psutil.Process().memory_info().rss
    give_back()
    assert before - psutil.Process().memory_info().rss > 50 << 20 and last.any()
