import pytest

from stockpot.operators import feedback as FB
from stockpot.operators import ingest as I


def test_status(spark):
    bodies = ['{"schema_version":1,"recipe":{"title":"a"}}', '{"schema_version":2,"recipe":{"title":"a"}}', "{", None, "[]", '{"schema_version":1}', '{"schema_version":1,"recipe":{"title":""}}']
    df = spark.createDataFrame(list(enumerate(bodies)), "envelope_id long, body string")
    got = {r.envelope_id: r.reason for r in I.envelope_status(df).collect()}
    assert got == {0: None, 1: "version", 2: "unreadable", 3: "null", 4: "not an object", 5: "no recipe", 6: "no title"}


def test_inserts(spark):
    old = spark.createDataFrame([("a",)], "u string")
    new = spark.createDataFrame([("a", 1), ("b", 3), ("b", 2)], "u string, o int")
    assert [tuple(r) for r in I.insert_new(old, new, "u", "o").collect()] == [("b", 2)]
    dim = spark.createDataFrame([(5, "x")], "id long, name string")
    got = {r.name: r.id for r in I.get_or_create(dim, spark.createDataFrame([("x",), ("y",), ("y",), ("z",), (None,)], "name string")).collect()}
    assert got["x"] == 5 and sorted(got.values()) == [5, 6, 7]
    ch = I.upsert_changes(spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, None), (4, "d")], "k int, v string"), "k", ["v"])
    assert {r.k: r.change for r in ch.collect()} == {1: "updated", 2: "unchanged", 3: "kept", 4: "created"}


def test_merges(spark):
    rows = [(1, "酱油", "1勺", False, None, 1), (1, "酱油 ", "半勺", True, "调料", 2), (1, "盐", None, True, None, 3), (1, " ", "1", True, None, 4)]
    rows = spark.createDataFrame(rows, "recipe int, name string, amount string, is_essential boolean, category string, pos int")
    assert {(r.name, r.amount, r.is_essential, r.category) for r in I.merge_amounts(rows).collect()} == {("酱油", "1勺、半勺", False, "调料"), ("盐", "", True, None)}
    aliases = spark.createDataFrame([("葱", "葱"), ("干辣椒", "干辣椒"), ("番茄酱", "番茄酱"), ("酱油", "酱油"), ("生抽", "酱油")], "alias string, canonical string")
    names = spark.createDataFrame([("葱花",), ("干辣椒",), ("生抽",), ("牛油果",), ("  葱  ",)], "name string")
    assert {r.name: r.canonical for r in I.classify_by_alias(names, aliases).collect()} == {"葱花": "葱", "干辣椒": "干辣椒", "生抽": "酱油", "牛油果": None, "  葱  ": "葱"}
    assert I.classify_by_alias(names, aliases.where("false")).where("canonical is not null").count() == 0
    got = {(r.section, r.name, r.amount, r.pos) for r in I.split_seasonings(rows, aliases).collect()}
    assert got == {("seasonings", "酱油", "1勺、半勺", 1), ("ingredients", "盐", None, 3), ("ingredients", " ", "1", 4)}


def test_loads(spark):
    rows = [(1, "a", "valid"), (2, "a", "valid"), (3, "b", "valid"), (4, "c", "invalid"), (5, None, "valid"), (6, None, "valid")]
    s, old = spark.createDataFrame(rows, "envelope_id long, source_url string, status string"), spark.createDataFrame([("b",), ("b",)], "source_url string")
    got = {r.envelope_id: r.outcome for r in I.load_outcomes(s, old).collect()}
    assert got == {1: "saved", 2: "skipped", 3: "skipped", 4: "invalid", 5: "saved", 6: "saved"}
    assert {r.envelope_id: r.outcome for r in I.load_outcomes(s, old, force=True).collect()}[3] == "saved"
    outcomes = spark.createDataFrame([("saved",), ("failed",), ("invalid",)], "outcome string")
    assert tuple(I.load_summary(outcomes).first()) == (3, 1, 0, 1, 1, 1)
    failed = spark.createDataFrame([("x", i, True) for i in range(5)], "stream string, pos int, failed boolean")
    assert I.load_summary(outcomes, failed).first().exit_code == 3 and I.load_summary(outcomes.where("false")).first().exit_code == 0


def chunk_model(units, size):
    """The greedy join, one unit after another."""
    out = []
    for kind, step, text in units:
        if out and out[-1][0] == kind and len(out[-1][3]) + len(text) <= size:
            out[-1][3] += "\n\n" + text
            out[-1][2] = step if step is not None else out[-1][2]
        else:
            out.append([kind, step, step, text])
    return [tuple(x) for x in out]


def test_chunks(spark):
    steps = [("a" * 30,), ("",), ("b" * 30,), (None,), ("c" * 50,)]
    df = spark.createDataFrame([(1, "t", None, steps), (2, None, None, None)], "id long, title string, description string, steps array<struct<instruction:string>>")
    items = [(1, "seasonings", 7, "盐", "1g"), (1, "ingredients", 9, "土豆", " "), (1, "ingredients", 8, "葱", None), (1, "ingredients", 1, " ", "x")]
    items = spark.createDataFrame(items, "id long, section string, pos int, name string, amount string")
    units = I.recipe_units(df, items)
    want = [("header", None, "t"), ("ingredients", None, "用料：葱；土豆；盐：1g"), ("steps", 1, "步骤1：" + "a" * 30), ("steps", 3, "步骤3：" + "b" * 30), ("steps", 5, "步骤5：" + "c" * 50)]
    assert [tuple(r)[2:] for r in I.chunk_units(units, 70).orderBy("id", "chunk").collect()] == chunk_model(want, 70)
    assert [r.text for r in I.recipe_documents(units).collect()] == ["\n\n".join(w[2] for w in want)]
    assert I.recipe_units(df.where("false"), items.where("false")).count() == 0
    long = spark.createDataFrame([(1, 2, "step", 1, "一二三四五。" * 20 + "x" * 130)], "id long, seq int, unit_type string, step int, text string")
    texts = [r.text for r in I.chunk_units(long, 50).orderBy("chunk").collect()]
    assert max(map(len, texts)) <= 52 and "".join(texts).replace("\n", "") == "一二三四五。" * 20 + "x" * 130


def test_upkeep(spark):
    f = spark.createDataFrame([("u", "s", 1, "old"), ("u", "s", 2, "new"), ("v", "s", 3, "e")], "url string, stage string, pos int, error string")
    assert [r.error for r in I.latest_failures(f, spark.createDataFrame([("v", "s")], "url string, stage string")).collect()] == ["new"]
    s = spark.createDataFrame([("a", i, i != 3) for i in range(9)], "stream string, pos int, failed boolean")
    assert [tuple(r) for r in I.circuit_breaks(s, 5).collect()] == [("a", 4, 5)]
    # one run over the ends of several ranges
    long = spark.createDataFrame([("a", i, i % 1000 != 0) for i in range(3000)] + [("b", 1, True)], "stream string, pos int, failed boolean").repartition(8)
    assert sorted(tuple(r) for r in I.circuit_breaks(long, 5).collect()) == [("a", 1, 999), ("a", 1001, 999), ("a", 2001, 999)]
    assert I.circuit_breaks(s.where("false")).count() == 0
    rules = spark.createDataFrame([("/a", False), ("/a/b", True), ("/c*d$", False), ("/c.d", True)], "pattern string, allow boolean")
    urls = spark.createDataFrame([("http://x/a/q",), ("http://x/a/b1",), ("http://x/cxxd",), ("http://x/cxxde",), ("http://x",)], "url string")
    assert {r.url: r.allowed for r in I.allowed_by_rules(urls, rules).collect()} == {"http://x/a/q": False, "http://x/a/b1": True, "http://x/cxxd": False, "http://x/cxxde": True, "http://x": True}


def test_delete(spark):
    ids = spark.createDataFrame([(1,)], "id long")
    r = spark.createDataFrame([(1,), (2,)], "id long")
    b = spark.createDataFrame([(1, 5), (2, 5)], "recipe_id long, ingredient_id long")
    fb = spark.createDataFrame([(7, 1), (8, None), (9, 2)], "id long, recipe_id long")
    r2, b2, t2, f2 = I.delete_recipes(ids, r, b, b, fb)
    assert (r2.count(), b2.count(), t2.count()) == (1, 1, 1)
    assert {tuple(x) for x in f2.collect()} == {(7, None), (8, None), (9, 2)}


def test_feedback(spark):
    rows = [(1, 1, "f", "like"), (2, 1, "f", " LIKE"), (3, 1, "f", "dislike"), (4, None, "f", "like"), (5, 2, None, "like"), (5, 2, None, "like")]
    frame = spark.createDataFrame(rows, "id long, recipe_id long, client_fingerprint string, action string").selectExpr("*", "CASE WHEN id < 5 THEN timestamp_ntz'2025-03-04 05:06:07' END AS created_at")
    d = FB.distinct_feedback(frame)
    assert sorted(r.id for r in d.collect()) == [1, 3, 4, 5]
    assert {r.recipe_id: (r.likes, r.dislikes, r.total) for r in FB.action_counts(d).collect()} == {1: (1, 1, 2), None: (1, 0, 1), 2: (1, 0, 1)}
    lines = [r.line for r in FB.export_lines(d, "now").orderBy("line_no").collect()]
    assert lines[0] == '{"_meta":{"exported_at":"now","count":4,"like":3,"dislike":1,"recipes":3}}'
    assert lines[3:] == ['{"id":4,"recipe_id":null,"action":"like","created_at":"2025-03-04T05:06:07"}', '{"id":5,"recipe_id":2,"action":"like","created_at":null}']
    asked = spark.createDataFrame([(1, 1, "f", "Like"), (2, 2, "g", "like"), (3, 2, "g", "like"), (4, 9, "g", "like")], "request_id long, recipe_id long, client_fingerprint string, action string")
    got = {r.request_id: (r.status, r.id) for r in FB.accept_feedback(frame, asked, spark.createDataFrame([(1,), (2,)], "id long")).collect()}
    assert got == {1: ("known", 1), 2: ("new", None), 3: ("repeated", None), 4: ("no recipe", None)}


def test_evaluation(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 6), (2, 12, 1)], "query_id long, doc_id long, rank int")
    relevant = spark.createDataFrame([(1, 10), (1, 11), (2, 99)], "query_id long, doc_id long")
    r = FB.recall_at_k(ranked, relevant, 5).first()
    assert (r.queries, r.recall, r.coverage) == (2, pytest.approx(0.25), pytest.approx(0.5))
    found = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "case_id long, name string")
    expected = spark.createDataFrame([(1, 1, ["x", "a"]), (1, 2, ["c"]), (2, 1, ["a"]), (3, 1, [])], "case_id long, item_no int, alternatives array<string>")
    r = FB.linking_accuracy(found, expected).first()
    assert (r.hits, r.total, r.accuracy) == (1, 4, 0.25) and FB.linking_accuracy(found, expected.where("false")).first().accuracy == 1.0
    s = spark.createDataFrame([("a", float(i)) for i in range(1, 41)] + [("b", 3.0)], "kind string, ms double")
    assert {x.kind: x.p95 for x in FB.latency_p95(s).collect()} == {"a": 38.0, "b": 3.0}
