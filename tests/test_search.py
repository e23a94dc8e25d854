import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stockpot.functions import text as X
from stockpot.operators import search as S


def test_bm25_small(spark):
    docs = spark.createDataFrame([(1, "土豆 鸡蛋 土豆"), (2, "鸡蛋 牛奶"), (3, "苹果"), (4, None)], "doc_id long, text string")
    q = spark.createDataFrame([(7, "鸡蛋 土豆")], "query_id long, text string")
    hits = [(r.doc_id, r["rank"]) for r in S.bm25_topk(S.build_index(docs), q, 10).orderBy("rank").collect()]
    assert hits == [(1, 1)] or hits == [(1, 1), (2, 2)]
    assert S.bm25_topk(S.build_index(docs.where("false")), q, 10).count() == 0


def test_bm25_against_model(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    docs = {i: [rng.choice(words) for _ in range(rng.randint(1, 20))] for i in range(40)}
    n, avgdl = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for d in docs.values() for w in set(d))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in raw.items()}
    asked = ["w1", "w2", "w2", "nothing"]
    want = {}
    for i, d in docs.items():
        tf = Counter(d)
        s = sum(idf.get(t, 0) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / avgdl)) for t in asked)
        if s > 0:
            want[i] = s
    index = S.build_index(spark.createDataFrame([(i, " ".join(d)) for i, d in docs.items()], "doc_id long, text string"))
    got = {r.doc_id: r.score for r in S.bm25_best(index, spark.createDataFrame([(1, " ".join(asked))], "query_id long, text string"), 1_000).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"a b{i}") for i in range(5)], "doc_id long, text string")
    index, path = S.build_index(docs), str(tmp_path / "index")
    S.save_index(index, path, S.inputs_fingerprint(docs))
    again = S.load_index(spark, path, S.inputs_fingerprint(docs))
    assert again.postings.count() == index.postings.count()
    assert S.load_index(spark, path, "other") is None
    assert S.load_index(spark, str(tmp_path / "none")) is None


def test_refresh_follows_its_inputs(spark, tmp_path):
    docs, built = spark.createDataFrame([(1, "a b"), (2, "a c")], "doc_id long, text string"), []

    def corpus(df):
        built.append(1)
        return df

    path = str(tmp_path / "index")
    for df in (docs, docs, docs.where("doc_id = 1"), docs):
        index = S.refreshed_index(path, (df,), lambda: corpus(df))
        assert index.totals.first().n == df.count()
    assert len(built) == 2


def test_best_keeps_the_least_ids_of_ties(spark):
    docs = spark.createDataFrame([(i, "same text") for i in range(200)] + [(999, None), (998, "other")], "doc_id long, text string").repartition(7)
    q = spark.createDataFrame([(1, "same"), (2, "other nothing"), (3, ""), (4, None)], "query_id long, text string")
    hits = [(r.query_id, r.doc_id) for r in S.bm25_topk(S.build_index(docs), q, 3).orderBy("query_id", "rank").collect()]
    assert [d for q_, d in hits if q_ == 2] == [998] and [d for q_, d in hits if q_ == 1] in ([], [0, 1, 2])
    best = S._Best(2, 2)
    for ids in (np.array([5, 6, 7]), np.array([1, 2, 9])):
        best.add(np.zeros(3, np.int64), np.full(3, 0.5), ids)
    assert best.ident.tolist() == [1, 2]


def test_blocks_of_queries_give_the_same(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdefghij") for _ in range(6))) for i in range(80)], "doc_id long, text string")
    q = spark.createDataFrame([(i, " ".join(rng.choice("abcdefghij") for _ in range(3))) for i in range(20)], "query_id long, text string")
    index = S.build_index(docs)
    one, many = ({tuple(r) for r in S.top(S.bm25_best(index, q, 4, most), 4).select("query_id", "doc_id", "rank").collect()} for most in (1_000, 7))
    assert one == many and len(one) > 20


def test_states_and_vectors(spark):
    hits = spark.createDataFrame([(1, 1, 9, 0.1, 1), (2, 2, 5, 0.1, 1), (2, 3, 9, 0.2, 2), (3, 4, None, 0.1, 1)], "query_id long, chunk_id long, doc_id long, distance double, rank int")
    known, q = spark.createDataFrame([(5,)], "doc_id long"), spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "query_id long")
    assert {tuple(r) for r in S.branch_states(q, hits, known, True).collect()} == {(1, True, "orphans only"), (2, False, ""), (3, False, ""), (4, False, "")}
    assert {r.reasons for r in S.branch_states(q, hits, known, False).collect()} == {"no vectors"}
    old = spark.createDataFrame([(1, "a", [1.0]), (2, "b", [1.0]), (3, "c", [1.0])], "id long, text string, vec array<double>")
    new = spark.createDataFrame([(1, "a", [2.0]), (2, "B", [2.0]), (4, "d", [2.0])], "id long, text string, vec array<double>")
    vectors, changes = S.refreshed_vectors(old, new)
    assert {(r.id, r.vec[0]) for r in vectors.collect()} == {(1, 1.0), (2, 2.0), (4, 2.0)}
    assert {tuple(r) for r in changes.collect()} == {(1, "unchanged"), (2, "changed"), (3, "stale"), (4, "new")}
    rows = spark.createDataFrame([("x", [1.0, 0.0]), ("y", None), ("z", [0.0, 2.0])], "item string, vec array<double>")
    near = {r["item"]: r.id for r in S.nearest_entry(rows, spark.createDataFrame([(7, [3.0, 0.1]), (6, [3.0, 0.1]), (5, [0.0, 1.0])], "id long, vec array<double>"), block=2).collect()}
    assert near == {"x": 6, "z": 5}


def test_knn_against_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    chunks = spark.createDataFrame([(i, i % 7, v[i].tolist()) for i in range(60)] + [(99, 1, None)], "chunk_id long, doc_id long, vec array<double>")
    q = chunks.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vec")
    for block in (2, 4096):
        got = {(r.query_id, r["rank"]): r.chunk_id for r in S.knn(chunks, q, 5, block).collect()}
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        for a in (0, 20, 40):
            assert [got[a, k] for k in range(1, 6)] == np.argsort(1 - u @ u[a], kind="stable")[:5].tolist()


def test_fusion_and_roll_up(spark):
    hits = spark.createDataFrame([(1, 10, 100, 0.1, 1), (1, 11, 100, 0.2, 2), (1, 12, 200, 0.3, 3), (2, 13, 200, 0.1, 1), (3, 14, None, 0.1, 1)], "query_id long, chunk_id long, doc_id long, distance double, rank int")
    known = spark.createDataFrame([(100,)], "doc_id long")
    scores, state = S.roll_up(hits, known)
    assert [(r.query_id, r.doc_id, round(r.vector_score, 12)) for r in scores.collect()] == [(1, 100, round(0.5 * (1 / 61 + 1 / 62) / 2, 12))]
    # a query whose hits are all orphans is degraded; one without any document is not
    assert {r.query_id: r.degraded for r in state.collect()} == {1: False, 2: True}
    keyword = spark.createDataFrame([(1, 100, 1)], "query_id long, doc_id long, rank int")
    top = S.fuse(keyword, spark.createDataFrame([(1, 100, 0.5 / 61), (1, 300, 0.1)], "query_id long, doc_id long, vector_score double"), 1)
    assert [(r.doc_id, r["rank"]) for r in top.collect()] == [(300, 1)]
    both = S.fuse(keyword, spark.createDataFrame([(1, 100, 0.5 / 61)], "query_id long, doc_id long, vector_score double"), 5).first()
    assert abs(both.score - 2 * 0.5 / 61) < 1e-12


def test_within_ranks_after_the_threshold(spark):
    hits = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.2, 2), (1, 3, None, 3)], "query_id long, chunk_id long, distance double, rank int")
    assert [(r.chunk_id, r["rank"]) for r in S.within(hits, 0.5).collect()] == [(2, 1)]


def test_vector_upkeep(spark):
    old = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [0.0, 1.0])], "chunk_id long, doc_id long, vec array<double>")
    new = spark.createDataFrame([(2, 5, [1.0, 1.0])], "chunk_id long, doc_id long, vec array<double>")
    assert {(r.chunk_id, r.doc_id) for r in S.upsert_vectors(old, new, 2).collect()} == {(1, 1), (2, 5)}
    assert S.delete_vectors(old, new.select("chunk_id")).count() == 1
    assert S.delete_vectors(old, where=F.col("doc_id") == 1).count() == 0
    assert S.one_dimension(old).first().ok


def test_terms_are_counted_as_the_tokens(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("土豆鸡蛋丝一鿿䷿ꀀaBz09 _\n\t,é１ÅİK😀") for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, "", "土", "土\n豆", "土豆", "A", "a1B2", "土a豆", "\n\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", X.tokens("text").alias("t")).collect()
    want = {r.id: Counter(r.t) for r in rows}
    dl, off, terms, tfs = S.count_terms(texts)
    terms = terms.to_pylist()
    got = {i: dict(zip(terms[off[i] : off[i + 1]], tfs[off[i] : off[i + 1]].tolist())) for i in range(len(texts))}
    assert got == want and dl.tolist() == [sum(want[i].values()) for i in range(len(texts))]
    assert all(len(x) == 0 for x in S.count_terms([None, "", " "])[2:])


def test_texts_are_derived_once(spark):
    """Building an index runs what gives the texts once, not again to count its partitions."""
    runs = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            runs.add(len(b))
            yield b

    docs = spark.range(50).repartition(3, "id").selectExpr("id AS doc_id", "concat('w', id) AS text").mapInArrow(told, "doc_id long, text string")
    index = S.build_index(docs.groupBy("doc_id").agg(F.first("text").alias("text")))
    assert index.totals.first().n == 50 and runs.value == 50


def test_lots_of_a_task_are_scored_together():
    """What lies in different lots of documents competes for the same places, and ties go by id."""
    known = pa.array(["a", "b"])
    docs = [(i, 4, ["a", "x"] if i % 3 else ["b", "a"], [1 + i % 2, 1]) for i in range(40)]
    rows = pa.RecordBatch.from_pylist([dict(zip(("doc_id", "dl", "terms", "tfs"), d)) for d in reversed(docs)], pa.schema([("doc_id", pa.int64()), ("dl", pa.int32()), ("terms", pa.list_(pa.string())), ("tfs", pa.list_(pa.int32()))]))
    part = lambda tf: tf * 2.5 / (tf + 1.5)
    want = sorted(((sum(w * part(n) for t, n in zip(ts, ns) for u, w in (("a", 1.0), ("b", 0.5)) if t == u), i) for i, _, ts, ns in docs), key=lambda x: (-round(x[0], 9), x[1]))[:7]
    for most in (3, 1_000):
        best = S._Best(1, 7)
        for ids, lists in S._lots(iter([rows.slice(at, 10) for at in range(0, 40, 10)]), known, 4.0, most):
            for q, score, at in S._scored(lists, len(ids), [0, 2], [0, 1], [1.0, 0.5], best, 7):
                best.add(q, score, ids[at])
        assert best.ident.tolist() == [i for _, i in want]


def test_equal_texts_are_searched_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 5} v{i % 3} u") for i in range(30)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "w1 v1"), (2, "w2"), (3, "w1 v1"), (4, None), (5, "w1"), (5, "v1")], "query_id long, text string")
    index, asked, best = S.build_index(docs), [], S.bm25_best
    monkeypatch.setattr(S, "bm25_best", lambda i, queries, k: asked.append(queries.select("query_id").distinct().count()) or best(i, queries, k))
    got = {i: [(r.doc_id, round(r.score, 9)) for r in S.bm25_topk(index, q, 4).where(F.col("query_id") == i).orderBy("rank").collect()] for i in (1, 2, 3, 4, 5)}
    want = {i: [(r.doc_id, round(r.score, 9)) for r in S.top(best(index, q, 4), 4).where(F.col("query_id") == i).orderBy("rank").collect()] for i in (1, 2, 3, 4, 5)}
    # the two texts of query 5 are other than the one text of 1 and 3
    assert set(asked) == {3} and got == want and got[1] and got[1] == got[3] and not got[4]


def test_a_lot_holds_each_term_once(spark):
    docs = spark.range(0, 60_000, 1, 1).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 40), x -> concat('w', pmod(xxhash64(id, x), 500)))) AS text").coalesce(1)
    index = S.build_index(docs)
    lots = index.forward.selectExpr("size(docs) AS n", "size(known) AS k", "size(array_distinct(known)) AS d", "size(terms) AS t", "aggregate(sizes, 0, (a, x) -> a + x) AS s").collect()
    assert sum(r.n for r in lots) == 60_000 and all(r.n <= 4_000 and r.k == r.d <= 500 and r.t == r.s for r in lots)
    assert index.postings.count() == sum(r.t for r in lots) and index.term_stats.agg(F.sum("df")).first()[0] == sum(r.t for r in lots)


def test_common_terms_are_looked_up_for_what_can_come_in():
    """Scores are whole, with terms of many documents and of few, of positive and negative weight, over all lots."""
    rng = np.random.default_rng(2)
    known = [f"t{i}" for i in range(40)]
    share = np.concatenate([np.full(6, 0.7), np.full(34, 0.03)])
    has = rng.random((3_000, 40)) < share
    rows = [{"doc_id": i, "dl": int(h.sum()) + 1, "terms": [known[t] for t in np.flatnonzero(h)], "tfs": [1 + (i + t) % 3 for t in np.flatnonzero(h)]} for i, h in enumerate(has)]
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("dl", pa.int32()), ("terms", pa.list_(pa.string())), ("tfs", pa.list_(pa.int32()))]))
    asked = [[0, 9, 20], [1, 2, 3], [30], [0, 1, 2, 10, 11, 12, 13, 14], [], [4, 33, 34]]
    weight = [[0.2, 3.0, 4.0], [0.3, -0.1, 0.2], [5.0], [0.1, 0.2, -0.5, 2.0, 3.0, 4.0, 5.0, 6.0], [], [9.0, 0.1, 0.1]]
    start = [0, *np.cumsum([len(a) for a in asked]).tolist()]
    best = S._Best(len(asked), 20)
    for ids, lists in S._lots(iter([batch]), pa.array(known), 6.0, 1_000):
        for q, score, at in S._scored(lists, len(ids), start, sum(asked, []), sum(weight, []), best, 20):
            best.add(q, score, ids[at])
    for n, (ts, ws) in enumerate(zip(asked, weight)):
        score = {i: s for i, r in enumerate(rows) if (s := sum(w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * r["dl"] / 6.0)) for t, w in zip(ts, ws) for u, tf in zip(r["terms"], r["tfs"]) if u == known[t])) > 0}
        want = sorted(score, key=lambda i: (-math.floor(score[i] * 1e9 + 0.5), i))[:20]
        assert best.ident[best.query == n].tolist() == want
        assert np.allclose(best.rest["score"][best.query == n], [score[i] for i in want])
