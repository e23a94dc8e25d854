import os
import random
from collections import Counter

import numpy as np
import pytest

from stockpot.llm import encode as E
from stockpot.llm import pack, split

if not os.path.exists(E.VOCABULARY):
    pytest.skip("no vocabulary", allow_module_level=True)

PIECES = ["土豆。", "鸡蛋，", "don't", " it's", "  ", "\n\n", "\r\n", "12345678901234567890", "a" * 50, "…", "😀👍🏽", "é", "​", "''s", " 's", "\x1c", "\x85", "　", "\U000323af", "x'll y", "!?", "ß", "Ⅷ", "½"]


def texts(seed, n=150):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_same_ids_as_whole_texts(seed):
    enc, all_texts = E.encoder(E.VOCABULARY), texts(seed) + [None, "", "7" * 5000, "字" * 3000]
    ids, off = E.encode_batch(all_texts, enc)
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [enc.bpe.encode_ordinary(t or "") for t in all_texts]
    assert E.encode_batch([], enc)[1].tolist() == [0] and E.encode_batch([None, ""], enc)[1].tolist() == [0, 0, 0]


def test_reuse_has_a_bound():
    enc = E.Encoder(E.VOCABULARY, keep_chars=2_000)
    for s in range(5):
        E.encode_batch(texts(s), enc)
    assert sum(map(len, enc.known)) <= 2_500 + max(map(len, texts(0) + [""])) * 200


def test_shared_chunks_give_the_ids_of_whole_texts(spark):
    """Passages stand in many documents, at other places and cut within words, numbers, spaces and contractions."""
    rng, enc = random.Random(5), E.encoder(E.VOCABULARY)
    passages = ["".join(rng.choice(["土豆。", "word ", " 12345", ", ", "don't ", "\n\n", "字", "é", "!? "]) for _ in range(120)) for _ in range(6)]
    all_texts = ["".join(rng.choice([rng.choice(passages), rng.choice(passages)[rng.randint(0, 60) :], rng.choice(PIECES)]) for _ in range(rng.randint(0, 5))) for _ in range(80)]
    rows = list(enumerate(all_texts)) + [(7, all_texts[3]), (None, passages[0]), (500, None), (501, ""), (502, passages[0] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS k", "2 AS ids", "3 AS digest")
    got = sorted(((r.doc_id, r.ids) for r in E.encode(df).collect()), key=str)
    assert got == sorted(((i, enc.bpe.encode_ordinary(t or "")) for i, t in rows), key=str)
    marks, encoded = E.shared_chunks(df.selectExpr("doc_id AS k", "text AS t"))
    assert encoded.count() == encoded.select("digest").distinct().count() > 20
    assert marks.where("k = 7 OR k IS NULL").count() == 0


def test_against_the_other_library(spark, data):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(E.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: r.ids for r in E.encode(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows) and all(got[r.doc_id] == t.encode(r.text or "", add_special_tokens=False).ids for r in rows)
    assert E.encode(docs.where("false")).count() == 0


def check_packing(rows, sizes, capacity):
    load, per = Counter(), Counter()
    for r in rows:
        load[r.container] += r.n_tokens
        per[r["item"]] += r.n_tokens
    assert max(load.values()) <= capacity and dict(per) == {i: n or 0 for i, n in sizes.items()}
    assert all(sum(1 for r in rows if r["item"] == i) == 1 for i, n in sizes.items() if (n or 0) <= capacity)
    return len(load)


def test_containers(spark):
    rng = random.Random(1)
    sizes = {i: rng.choice([0, 1, 30, 45, 60, 99, 100]) for i in range(400)} | {1000: 250, 1001: 200, 1002: None}
    df = spark.createDataFrame(list(sizes.items()) + [(0, 0)], "item long, n_tokens int").selectExpr("*", "1 AS container", "2 AS part", "3 AS block")
    rows = pack.fill_containers(df, 100, block_items=120, epochs=2, generations=10).collect()
    n = check_packing(rows, sizes, 100)
    single = sum(1 for s in sizes.values() if (s or 0) in (60, 99, 100))
    assert n <= single + 4 + -(-sum((s or 0) for s in sizes.values() if (s or 0) in (1, 30, 45)) // 60)
    assert pack.fill_containers(df.where("false"), 100).count() == 0
    ones = pack.fill_containers(spark.createDataFrame([(i, 100) for i in range(5)], "item long, n_tokens int"), 100)
    assert ones.select("container").distinct().count() == 5


def test_evolution_beats_or_equals_best_fit():
    rng = np.random.default_rng(0)
    sizes = rng.integers(20, 70, 120)
    down = np.argsort(-sizes, kind="stable")
    first = len(np.unique(pack.best_fit(sizes, down, 100, np.full(120, -1, np.int64), [])))
    best = pack.evolve(sizes, 100, [], 60, 8, 1)[0]
    assert np.bincount(best, weights=sizes).max() <= 100 and len(np.unique(best)) <= first
    a, b = pack.evolve(sizes, 100, [], 0, 4, 2)[:2]
    child = pack.crossover(sizes, a, b, 100, rng)
    assert (child >= 0).all() and np.bincount(child, weights=sizes).max() <= 100


@pytest.mark.parametrize("limit, overlap", [(40, 8), (64, 0), (200, 20)])
def test_pieces(spark, limit, overlap):
    enc = E.encoder(E.VOCABULARY)
    rng = random.Random(limit)
    all_texts = texts(9, 60) + ["7" * 900, "字" * 500, "", None, "a b " * 400, "\n" * 300, "".join(rng.choice("土豆鸡蛋。，\n ab1😀") for _ in range(2000))]
    df = spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string").selectExpr("*", "1 AS piece", "2 AS k")
    by = {}
    for r in split.split_long(df, limit, overlap).collect():
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {i for i, t in enumerate(all_texts) if len(enc.ids(t or "")) > limit}
    for i, rows in by.items():
        rows.sort(key=lambda r: r.piece)
        t = all_texts[i]
        assert [r.piece for r in rows] == list(range(len(rows))) and "".join(t[r.body_from : r.to_char] for r in rows) == t
        for n, r in enumerate(rows):
            assert r.text == t[r.from_char : r.to_char] and r.n_tokens == len(enc.ids(r.text)) <= limit
            assert r.body_from < r.to_char and (n > 0 or r.from_char == 0)
            assert len(enc.ids(t[r.from_char : r.body_from])) <= overlap
    assert split.split_long(df.where("false"), limit, overlap).count() == 0


def test_cuts_fall_between_topics():
    cutter = split.Cutter(E.VOCABULARY, 200, 0)
    a, b = "把土豆切成小块放进锅里。" * 6, "Bake the bread until it is brown. " * 8
    assert cutter.pieces(a + b)[0][1] == len(a)


def test_cuts_fall_on_planted_seams(data, monkeypatch):
    """Two texts one after the other: the first cut is at the seam far more often than by paragraphs alone."""
    import pyarrow.parquet as pq

    pool = [t for t in pq.read_table(f"{data}/documents.parquet", columns=["text"]).column("text").to_pylist() if t and 150 < len(t) < 1500 and "\n" in t]
    cutter, rng, cases = split.Cutter(E.VOCABULARY, 400, 0), random.Random(3), []
    while len(cases) < 60:
        a, b = (x.strip() for x in rng.sample(pool, 2))
        size = len(cutter.enc.ids(a))
        if 220 < size < 380 and size + len(cutter.enc.ids(b)) > 450:
            cases.append((a + "\n" + b, len(a)))
    hits = sum(cutter.pieces(t)[0][1] == at for t, at in cases)
    monkeypatch.setattr(split, "cohesion_depths", lambda cp, bounds: np.zeros(len(bounds)))
    assert hits >= 30 and hits > 1.5 * sum(cutter.pieces(t)[0][1] == at for t, at in cases)


def test_overlap_is_less_than_half():
    with pytest.raises(ValueError):
        split.Cutter(E.VOCABULARY, 100, 50)
