from stockpot.operators import matching as M

DICTIONARY = [(1, "土豆", ["马铃薯", None, ""], "蔬菜"), (2, "青椒", [], "蔬菜"), (3, "蚝油", None, "调料"), (4, "油麦菜", [], None), (5, "土豆丝饼", [], "主食")]


def dictionary(spark):
    return spark.createDataFrame(DICTIONARY, "id long, name string, aliases array<string>, category string")


def test_missing(spark):
    d = dictionary(spark)
    bridge = spark.createDataFrame([(10, 1, True), (10, 2, True), (10, 3, True), (10, 1, True), (11, 4, True), (12, 3, True), (13, 1, False)], "recipe_id long, ingredient_id long, is_essential boolean")
    asked = spark.createDataFrame([(1, " 马铃薯"), (1, "油"), (1, "nothing"), (1, None)], "query_id long, raw string")
    have = M.resolve_names(asked, d)
    assert {(r.raw, r.id) for r in have.collect()} == {(" 马铃薯", 1), ("油", None), ("nothing", None)}
    cands = spark.createDataFrame([(1, r) for r in (10, 11, 12, 13)], "query_id long, recipe_id long")
    got = {r.recipe_id: (r.essential_total, r.missing) for r in M.missing_items(cands, M.essential_items(bridge, d), have).collect()}
    assert got == {10: (2, ["青椒"]), 11: (1, ["油麦菜"]), 12: (0, []), 13: (0, [])}


def test_score_and_rank(spark):
    rows = spark.createDataFrame([(0.8, 1, 2, 1, 20), (0.0, 0, 0, None, None)], "norm double, m int, t int, d int, c int")
    from pyspark.sql import functions as F

    got = [r[0] for r in rows.select(M.blended_score(*(F.col(c) for c in "norm m t d c".split()))).collect()]
    assert [round(x, 9) for x in got] == [0.67, 0.5]
    cands = spark.createDataFrame([(1, 10, 0.2), (1, 11, 0.9), (1, 12, 0.9)], "query_id long, recipe_id long, match double")
    missing = spark.createDataFrame([(1, 10, 1, []), (1, 11, 2, ["x"]), (1, 12, 2, ["y"])], "query_id long, recipe_id long, essential_total int, missing array<string>")
    recipes = spark.createDataFrame([(10, None, None), (11, 1, 20), (12, 1, 20)], "id long, difficulty int, cook_time_minutes int")
    got = M.rank_candidates(cands, missing, recipes, 5).orderBy("rank").collect()
    assert [r.recipe_id for r in got] == [10, 11, 12]


def test_exclude(spark):
    cands = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "query_id long, recipe_id long")
    tags = spark.createDataFrame([(1, "nuts")], "id long, name string")
    used = spark.createDataFrame([(10, 1), (10, 1)], "recipe_id long, tag_id long")
    out = M.exclude_tagged(cands, used, tags, spark.createDataFrame([(1, "nuts")], "query_id long, tag string"))
    assert {tuple(r) for r in out.collect()} == {(1, 11), (2, 10)}


def test_link(spark):
    items = spark.createDataFrame([("土豆",), ("马铃薯",), ("土豆丁",), ("神秘食材",), ("",), (None,)], "item string")
    got = {r["item"]: (r.id, r.tier) for r in M.link_items(items, dictionary(spark)).collect()}
    assert got["土豆"] == (1, 1) and got["马铃薯"] == (1, 2) and got["土豆丁"] == (1, 3) and got["神秘食材"] == (None, None)
    vecs = spark.createDataFrame([("神秘食材", [1.0, 0.0])], "item string, vec array<double>"), spark.createDataFrame([(2, [1.0, 0.1])], "id long, vec array<double>")
    got = {r["item"]: (r.id, r.tier) for r in M.link_items(items, dictionary(spark), vecs).collect()}
    assert got["神秘食材"] == (2, 4)


def test_query_and_choices(spark):
    rows = [(1, p, n) for p, n in enumerate(["土豆", " 土豆", "鸡蛋", "", "神秘果"] + [f"n{i}" for i in range(40)])]
    q = M.build_query(spark.createDataFrame(rows, "query_id long, pos int, name string")).first().query.split(" ")
    assert q[:3] == ["土豆", "鸡蛋", "神秘果"] and len(q) == 28
    chosen = spark.createDataFrame([(1, 2, 0, ["x"]), (1, 1, 1, None), (1, 2, 2, []), (1, 9, 3, None), (2, 9, 1, None)], "query_id long, recipe_id long, pos int, steps array<string>")
    cands = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 3, 1), (2, 1, 2)], "query_id long, recipe_id long, rank int")
    recipes = spark.createDataFrame([(i, f"r{i}", 1, 5, [("a",), ("b",)]) for i in (1, 2, 3)], "id long, title string, difficulty int, cook_time_minutes int, steps array<struct<instruction:string>>")
    got = [(r.query_id, r.recipe_id, r.title, r.n_steps, r.steps_from, r.degraded) for r in M.valid_choices(chosen, cands, recipes).orderBy("query_id", "place").collect()]
    assert got == [(1, 1, "r1", 2, "recipe", False), (1, 2, "r2", 1, "choice", False), (2, 3, "r3", 2, "recipe", True), (2, 1, "r1", 2, "recipe", True)]


def test_request_faults(spark):
    ok = ("q", "a,b", None, 10)
    rows = [ok, (" ", "", "", 1), ("x" * 201, "", "", 1), ("a\x07", "", "", 1), ("q", "", "", 51), ("q", "", "", None), ("q", ",".join("a" * 31), "", 1), ("q", "b" * 51, "", 1), ("q", "", "a,\x01b", 1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "request_id long, q string, ingredients string, exclude_tags string, limit_n int")
    got = {r.request_id: r.reason for r in M.request_faults(df).collect()}
    assert list(map(got.get, range(9))) == [None, "empty text", "long text", "control character", "limit", "limit", "many ingredients", "long ingredients", "control character in exclude_tags"]


def test_facts_and_groups(spark):
    d = dictionary(spark)
    recipes = spark.createDataFrame([(10, "t", 1, 5, None), (11, "u", None, None, [("a",)])], "id long, title string, difficulty int, cook_time_minutes int, steps array<struct<instruction:string>>")
    bridge = spark.createDataFrame([(10, 3, "1勺"), (10, 1, "2个"), (10, 3, "1勺")], "recipe_id long, ingredient_id long, amount string")
    wanted = spark.createDataFrame([(1, 10), (1, 10), (2, 11), (3, 99), (4, None)], "query_id long, recipe_id long")
    got = {(r.query_id, r.recipe_id, r.n_steps, r.seasonings) for r in M.recipe_facts(wanted, recipes, bridge, d).collect()}
    assert got == {(1, 10, 0, "蚝油：1勺"), (2, 11, 1, "")}
    tags = spark.createDataFrame([("b", "taste"), ("a", "taste"), ("c", "unknown"), ("d", "allergen"), ("e", None)], "name string, kind string")
    assert {tuple(r) for r in M.grouped_tags(tags).collect()} == {("taste", 4, "a、b"), ("allergen", 1, "d")}


def test_autocomplete(spark):
    found = M.autocomplete(spark.createDataFrame([("土",), ("薯",), ("",)], "q string"), dictionary(spark), 1)
    assert {(r.q, r.id) for r in found.collect()} == {("土", 1), ("薯", 1)}
    near = spark.createDataFrame([("土", 1, 1), ("土", 4, 2)], "q string, id long, pos int")
    filled = M.autocomplete_topup(found.select("q", "id", "pos"), near, 2).where("q = '土'").orderBy("place").collect()
    assert [(r.id, r.tier) for r in filled] == [(1, 0), (4, 1)]


def test_exclusion_follows_the_candidates(spark):
    """What is excluded is looked for among the candidates, not for every query over all recipes with the tag."""
    queries = recipes = 300
    tags = spark.createDataFrame([(1, "nuts"), (2, "milk")], "id long, name string")
    worn = spark.createDataFrame([(i, 1 + i % 2) for i in range(recipes)] * 2, "recipe_id long, tag_id long")
    excluded = spark.createDataFrame([(q, "nuts") for q in range(queries)] + [(0, "milk"), (0, "nuts")], "query_id long, tag string")
    candidates = spark.createDataFrame([(q, (q + d) % recipes) for q in range(queries) for d in range(3)], "query_id long, recipe_id long")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = M.exclude_tagged(candidates, worn, tags, excluded)
        got = {tuple(r) for r in out.collect()}

        def most(p):
            own = p.metrics().apply("numOutputRows").value() if p.metrics().contains("numOutputRows") else 0
            return max([own, *(most(p.children().apply(i)) for i in range(p.children().size()))])

        rows = most(out._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert got == {(q, (q + d) % recipes) for q in range(1, queries) for d in range(3) if (q + d) % recipes % 2}
    assert 0 < rows < queries * 3 * 3


def test_branches_are_searched_once(spark, data, monkeypatch):
    from stockpot.plans import matching as P

    asked, near = [], P.Q.near_hits
    monkeypatch.setattr(P.Q, "near_hits", lambda s, d: asked.append(1) or near(s, d))
    assert P.hybrid_states(spark, data).count() and len(asked) == 1


def test_ranking_starts_from_what_is_kept(spark, data):
    """Exclusions are joined once, not for each of the sides that need what is left."""
    from stockpot.plans import matching as P

    for query in (P.rank_lexicographic, P.rank_hybrid):
        assert "recipe_tags" not in query(spark, data)._jdf.queryExecution().toString()


def test_facts_start_from_what_is_ranked(spark, data):
    from stockpot.plans import matching as P

    assert "row_number" not in P.recommend(spark, data)._jdf.queryExecution().toString()
