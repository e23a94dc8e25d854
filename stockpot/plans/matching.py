"""Queries on missing items, ranking, linking and free text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import feedback as FB
from ..operators import matching as M
from ..operators import search as S
from ..runtime import bounded_broadcast, table, written
from . import search as Q


def _available(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, raw): a pantry for each recipe asked for, the names of two in three of its ingredients.

    No table holds pantries; the rule on ingredient_id only makes one up, every row of it is used.
    """
    b = table(spark, d, "recipe_ingredients").where("recipe_id % 50 = 0 and ingredient_id % 3 <> 0")
    names = table(spark, d, "ingredients").select(F.col("id").alias("ingredient_id"), F.col("name").alias("raw"))
    return b.join(names, "ingredient_id").select(F.col("recipe_id").alias("query_id"), "raw").distinct()


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    hits = S.bm25_topk(Q.index(spark, d), Q.asked(spark, d), Q.DEPTH)
    return written(hits.select("query_id", F.col("doc_id").alias("recipe_id"), "score"), "hits")


def _missing(spark: SparkSession, d: str, candidates: DataFrame) -> DataFrame:
    dictionary = table(spark, d, "ingredients")
    items = M.essential_items(table(spark, d, "recipe_ingredients"), dictionary)
    return M.missing_items(candidates, items, M.resolve_names(_available(spark, d), dictionary))


def _excluded(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, tag): every second request wants no recipe with an allergen tag."""
    q = table(spark, d, "recipes").where("id % 100 = 0").select(F.col("id").alias("query_id"))
    return q.crossJoin(bounded_broadcast(table(spark, d, "tags").where("kind = 'allergen'").select(F.col("name").alias("tag")), 1_000))


def _fused(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(query_id, recipe_id, score, degraded, reasons), the fused candidates of each request with the state of its branches,
    and (query_id, degraded, reasons) of every request."""
    asked = Q.asked(spark, d)
    keyword = S.bm25_topk(Q.index(spark, d), asked, 2 * Q.DEPTH)
    hits, known = written(Q.near_hits(spark, d), "near"), Q.known(spark, d)
    states = S.branch_states(asked, hits, known, True)
    fused = S.fuse(keyword, S.roll_up(hits, known)[0], Q.DEPTH).select("query_id", F.col("doc_id").alias("recipe_id"), "score")
    # vectors may also be asked for without a text; requests are those with one
    return written(fused.join(states, "query_id"), "fused"), states


def hybrid_states(spark: SparkSession, d: str) -> DataFrame:
    """For each request how many candidates it has, whether a branch was degraded and why."""
    fused, states = _fused(spark, d)
    counts = fused.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"), F.bool_or("degraded").alias("d"))
    out = states.join(counts, "query_id", "left")
    # without candidates nothing is degraded
    return out.select("query_id", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("d", F.lit(False)).alias("degraded"), "reasons")


def rank_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Keyword and vector search fused, without what has an excluded tag, ranked by what is missing."""
    c = _fused(spark, d)[0]
    kept = written(M.exclude_tagged(c, table(spark, d, "recipe_tags"), table(spark, d, "tags"), _excluded(spark, d)), "kept")
    out = M.rank_candidates(kept.withColumnRenamed("score", "match"), _missing(spark, d, kept), table(spark, d, "recipes"), 5)
    out = out.join(c.select("query_id", "recipe_id", "degraded"), ["query_id", "recipe_id"])
    return out.select("query_id", "recipe_id", "rank", "n_missing", F.round("score", 6).alias("score"), "degraded")


def recommend(spark: SparkSession, d: str) -> DataFrame:
    """The ranked recipes with their facts and seasonings from storage, as they are told when nothing is generated."""
    ranked = written(rank_hybrid(spark, d).select("query_id", "recipe_id", "rank"), "ranked")
    facts = M.recipe_facts(ranked, *(table(spark, d, t) for t in ("recipes", "recipe_ingredients", "ingredients")))
    return facts.join(ranked, ["query_id", "recipe_id"])


def valid_choices(spark: SparkSession, d: str) -> DataFrame:
    """Choices as a generator may give them: some candidates in reversed order and twice, with and without steps, and ids
    that are no candidates."""
    c = _candidates(spark, d)
    ranked = S.top(c.withColumnRenamed("recipe_id", "doc_id"), 5).select("query_id", F.col("doc_id").alias("recipe_id"), "rank")
    steps = F.when(F.col("rank") == 3, F.array(F.lit("all in one")))
    some = ranked.where("query_id % 100 = 0 and rank <> 2").select("query_id", "recipe_id", (10 - F.col("rank")).alias("pos"), steps.alias("steps"))
    again = ranked.where("query_id % 100 = 0 and rank = 3").select("query_id", "recipe_id", F.lit(20).alias("pos"), F.lit(None).cast("array<string>").alias("steps"))
    wrong = ranked.where("rank = 1").select("query_id", (-F.col("recipe_id")).alias("recipe_id"), F.lit(0).alias("pos"), F.lit(None).cast("array<string>").alias("steps"))
    return M.valid_choices(some.unionByName(again).unionByName(wrong), ranked, table(spark, d, "recipes"))


def recipe_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts from storage of the recipes that documents name; vanished recipes give no row."""
    wanted = table(spark, d, "documents").where("recipe_id is not null").select(F.col("doc_id").alias("query_id"), "recipe_id")
    return M.recipe_facts(wanted, *(table(spark, d, t) for t in ("recipes", "recipe_ingredients", "ingredients")))


def lookup_by_url(spark: SparkSession, d: str) -> DataFrame:
    """The recipe of each envelope's address; addresses without a recipe have none."""
    urls = table(spark, d, "crawled_recipes").where("source_url is not null").select("envelope_id", "source_url")
    return urls.join(table(spark, d, "recipes").select("source_url", F.col("id").alias("recipe_id"), "title"), "source_url", "left").select("envelope_id", "recipe_id", "title")


def request_faults(spark: SparkSession, d: str) -> DataFrame:
    """Search requests as people type them: a name, an amount in place of a list, and the place as limit."""
    rows = table(spark, d, "crawled_ingredients").select(F.col("item_id").alias("request_id"), F.col("name").alias("q"), F.col("amount").alias("ingredients"), F.col("name").alias("exclude_tags"), F.col("pos").alias("limit_n"))
    return M.request_faults(rows.distinct())


def _entry_texts(spark: SparkSession, d: str) -> DataFrame:
    """(id, text): name and aliases of each entry."""
    aliases = F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.coalesce(a, F.lit("")) != "")
    return table(spark, d, "ingredients").select("id", F.array_join(F.concat(F.array("name"), aliases), " ").alias("text"))


def _entry_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(id, vec) of the entries by hash embedding."""
    return written(S.dense_embeddings(_entry_texts(spark, d).withColumnRenamed("id", "doc_id"), 64).withColumnRenamed("doc_id", "id"), "entry-vectors")


def link_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Each different crawled name by the four-step linker, vectors of names being hash embeddings."""
    items = table(spark, d, "crawled_ingredients").select(F.col("name").alias("item")).where("item is not null").distinct()
    vectors = S.dense_embeddings(items.select(F.col("item").alias("doc_id"), F.col("item").alias("text")), 64).withColumnRenamed("doc_id", "item")
    return M.link_items(items, table(spark, d, "ingredients"), (vectors, _entry_vectors(spark, d)), 0.6)


def autocomplete_topup(spark: SparkSession, d: str) -> DataFrame:
    """For the first word or two characters of every crawled name up to ten entries: those that contain it, then the nearest."""
    q = table(spark, d, "crawled_ingredients").select(F.regexp_extract("name", r"^([A-Za-z0-9]+|[一-鿿]{1,2})", 1).alias("q")).where("q <> ''").distinct()
    found = M.autocomplete(q, table(spark, d, "ingredients"), 10)
    vectors = S.dense_embeddings(q.select(F.col("q").alias("doc_id"), F.col("q").alias("text")), 64).withColumnRenamed("doc_id", "query_id")
    chunks = _entry_vectors(spark, d).select(F.col("id").alias("chunk_id"), F.col("id").alias("doc_id"), "vec")
    near = S.knn(chunks, vectors, 40).select(F.col("query_id").alias("q"), F.col("chunk_id").alias("id"), F.col("rank").alias("pos"))
    return M.autocomplete_topup(found, near, 10).select("q", "id", "tier", "place")


def dictionary_vectors(spark: SparkSession, d: str) -> DataFrame:
    """What a refresh of the dictionary's vectors changes, after a table of names alone from the entries before 2024."""
    texts = S.dense_embeddings(_entry_texts(spark, d).withColumnRenamed("id", "doc_id"), 64).withColumnRenamed("doc_id", "id").join(_entry_texts(spark, d), "id")
    names = table(spark, d, "ingredients").where("created_at < timestamp'2024-01-01'").select(F.col("id").alias("doc_id"), F.col("name").alias("text"))
    old = S.dense_embeddings(names, 64).join(names, "doc_id").withColumnRenamed("doc_id", "id")
    vectors, changes = S.refreshed_vectors(old, texts)
    return changes.join(vectors.select("id", F.size("vec").alias("dim")), "id", "left")


def linking_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """How many of the ingredients of a recipe the linker finds among the names crawled for its address."""
    items = table(spark, d, "crawled_ingredients").select(F.col("source_url").alias("case_id"), F.col("name").alias("item")).where("case_id is not null and item is not null").distinct()
    names = table(spark, d, "ingredients").select("id", "name")
    found = items.join(M.link_items(items.select("item"), table(spark, d, "ingredients")), "item").join(bounded_broadcast(names, 10_000), "id").select("case_id", "name")
    used = table(spark, d, "recipe_ingredients").select("recipe_id", F.col("ingredient_id").alias("item_no")).distinct()
    used = used.join(table(spark, d, "recipes").select(F.col("id").alias("recipe_id"), F.col("source_url").alias("case_id")), "recipe_id").join(items.select("case_id").distinct(), "case_id", "left_semi")
    expected = used.join(bounded_broadcast(names.withColumnRenamed("id", "item_no"), 10_000), "item_no").select("case_id", "item_no", F.array("name").alias("alternatives"))
    out = FB.linking_accuracy(found, expected)
    return out.select("hits", "total", F.round("accuracy", 6).alias("accuracy"))


def parse_canonical(spark: SparkSession, d: str) -> DataFrame:
    """As parse_items, with the entry's name where a name or an alias is exactly it."""
    terms = M.dictionary_terms(table(spark, d, "ingredients")).groupBy("term").agg(F.min_by("id", "tier").alias("id"))
    names = bounded_broadcast(terms.join(table(spark, d, "ingredients").select("id", F.col("name").alias("canonical")), "id").select("term", "canonical"))
    items = parse_items(spark, d)
    return items.join(names, items["name"] == names["term"], "left").select("item_id", "pos", F.coalesce("canonical", "name").alias("name"), "quantity")


def tags_grouped(spark: SparkSession, d: str) -> DataFrame:
    """The tags of each kind in one row, kinds in their fixed order; other kinds are left out."""
    return M.grouped_tags(table(spark, d, "tags"))


def resolve_names(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "crawled_ingredients").select(F.col("item_id").alias("query_id"), F.col("name").alias("raw")).distinct()
    return M.resolve_names(names, table(spark, d, "ingredients"))


def essential_items(spark: SparkSession, d: str) -> DataFrame:
    return M.essential_items(table(spark, d, "recipe_ingredients"), table(spark, d, "ingredients"))


def missing_items(spark: SparkSession, d: str) -> DataFrame:
    m = _missing(spark, d, _candidates(spark, d))
    return m.select("query_id", "recipe_id", "essential_total", F.array_join("missing", "、").alias("missing"))


def exclude_tagged(spark: SparkSession, d: str) -> DataFrame:
    out = M.exclude_tagged(_candidates(spark, d), table(spark, d, "recipe_tags"), table(spark, d, "tags"), _excluded(spark, d))
    return out.select("query_id", "recipe_id")


def rank_lexicographic(spark: SparkSession, d: str) -> DataFrame:
    """Search, drop what has an excluded tag, and rank by what is missing."""
    c = _candidates(spark, d)
    kept = written(M.exclude_tagged(c, table(spark, d, "recipe_tags"), table(spark, d, "tags"), _excluded(spark, d)), "kept")
    out = M.rank_candidates(kept.withColumnRenamed("score", "match"), _missing(spark, d, kept), table(spark, d, "recipes"), 5)
    return out.select("query_id", "recipe_id", "rank", "n_missing", F.round("score", 6).alias("score"))


def link_items(spark: SparkSession, d: str) -> DataFrame:
    """Each different crawled name by the four-step linker, the last step left to the vectors of a provider."""
    return M.link_items(table(spark, d, "crawled_ingredients").select(F.col("name").alias("item")), table(spark, d, "ingredients")).where("item is not null")


def autocomplete(spark: SparkSession, d: str) -> DataFrame:
    """For the first character of every crawled name the first ten entries that contain it."""
    q = table(spark, d, "crawled_ingredients").select(F.left("name", F.lit(1)).alias("q")).distinct()
    return M.autocomplete(q, table(spark, d, "ingredients"), 10).select("q", "id", "name", "pos")


def parse_items(spark: SparkSession, d: str) -> DataFrame:
    """Names and quantities in the running text of amount and name."""
    t = table(spark, d, "crawled_ingredients").select("item_id", F.concat(F.coalesce("amount", F.lit("")), F.coalesce("name", F.lit(""))).alias("t")).distinct()
    return t.select("item_id", F.posexplode(X.split_items("t")).alias("pos", "x")).select("item_id", "pos", "x.name", "x.quantity")


def build_query(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "crawled_ingredients").select(F.col("source_url").alias("query_id"), "pos", F.coalesce("name", F.lit("")).alias("name")).distinct()
    return M.build_query(rows)


def detail_lists(spark: SparkSession, d: str) -> DataFrame:
    return M.detail_lists(table(spark, d, "recipe_ingredients"), table(spark, d, "ingredients"))


def tags_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """Each tag in order of kind and name with its number of recipes."""
    used = table(spark, d, "recipe_tags").distinct().groupBy("tag_id").agg(F.count(F.lit(1)).alias("n"))
    full = table(spark, d, "tags").join(used, F.col("id") == F.col("tag_id"), "left")
    return full.select("kind", "name", F.coalesce("n", F.lit(0)).alias("n")).orderBy("kind", "name")


def tag_sets(spark: SparkSession, d: str) -> DataFrame:
    """The set of tag names of each recipe as one key."""
    named = table(spark, d, "recipe_tags").join(table(spark, d, "tags").select(F.col("id").alias("tag_id"), "name"), "tag_id")
    return named.groupBy("recipe_id").agg(F.array_join(X.canonical_set(F.collect_set("name")), "|").alias("tag_key"))


QUERIES = {
    f.__name__: f
    for f in (resolve_names, essential_items, missing_items, exclude_tagged, rank_lexicographic, link_items, autocomplete, parse_items, build_query, detail_lists, tags_by_kind, tag_sets)
    + (hybrid_states, rank_hybrid, recommend, valid_choices, recipe_facts, lookup_by_url, request_faults, link_vectors, autocomplete_topup, dictionary_vectors)
    + (linking_accuracy, parse_canonical, tags_grouped)
}

_TERMS = """
    known AS (SELECT term, arg_min(id, tier) AS id FROM (
                SELECT term, tier, min(id) AS id FROM (
                  SELECT name AS term, id, 1 AS tier FROM ingredients UNION ALL SELECT unnest(aliases), id, 2 FROM ingredients)
                WHERE term <> '' GROUP BY 1, 2) GROUP BY 1)"""
_ESSENTIAL = """
    essential AS (SELECT b.recipe_id, b.ingredient_id, i.name FROM (SELECT recipe_id, ingredient_id, max(is_essential) AS e FROM recipe_ingredients GROUP BY 1, 2) b
                  JOIN ingredients i ON i.id = b.ingredient_id WHERE e AND i.category IS DISTINCT FROM '调料')"""
_MISSING = f"""{_TERMS}, {_ESSENTIAL},
    have AS (SELECT DISTINCT b.recipe_id AS query_id, t.id AS ingredient_id FROM recipe_ingredients b JOIN ingredients i ON i.id = b.ingredient_id
             JOIN known t ON t.term = {Q.sql_clean('i.name')} WHERE b.recipe_id % 50 = 0 AND b.ingredient_id % 3 <> 0),
    cand AS (SELECT query_id, doc_id AS recipe_id, score FROM keyword WHERE rank <= 50),
    missing AS (SELECT c.query_id, c.recipe_id, count(e.ingredient_id) AS essential_total,
                       coalesce(string_agg(e.name, '、' ORDER BY e.ingredient_id) FILTER (WHERE h.ingredient_id IS NULL), '') AS missing,
                       count(e.ingredient_id) FILTER (WHERE h.ingredient_id IS NULL) AS n_missing
                FROM cand c LEFT JOIN essential e ON e.recipe_id = c.recipe_id LEFT JOIN have h ON h.query_id = c.query_id AND h.ingredient_id = e.ingredient_id GROUP BY 1, 2)"""
_KEPT = """
    kept AS (SELECT * FROM cand c WHERE NOT (c.query_id % 100 = 0 AND c.recipe_id IN (
               SELECT recipe_id FROM recipe_tags JOIN tags ON tags.id = tag_id WHERE kind = 'allergen')))"""
_NAME_OF = f"regexp_replace(regexp_replace(x, '{X.QUANTITY}', ''), '{Q._STRIP}', '', 'g')"
_QUANTITY_OF = f"nullif(regexp_extract(x, '{X.QUANTITY}', 1), '')"
_SPLIT = X.ITEM_SPLIT.replace(r"\s", r"\s\x0B")
_ITEMS = f"""t AS (SELECT DISTINCT item_id, concat(coalesce(amount, ''), coalesce(name, '')) AS t FROM crawled_ingredients),
        p AS (SELECT item_id, list_filter(list_transform(regexp_split_to_array(t, '{_SPLIT}'), lambda x: regexp_replace(x, '{Q._STRIP}', '', 'g')), lambda x: x <> '') AS ps FROM t),
        n AS (SELECT item_id, list_filter(list_transform(ps, lambda x: {{'name': {_NAME_OF}, 'quantity': {_QUANTITY_OF}}}), lambda s: s.name <> '') AS xs FROM p),
        items AS (SELECT item_id, i AS pos, xs[i + 1].name AS name, xs[i + 1].quantity AS quantity FROM (SELECT *, unnest(range(len(xs))) AS i FROM n))"""
_HYBRID = """
    both_sides AS (SELECT query_id, doc_id, coalesce(0.5 / (60 + k.rank), 0) + coalesce(vector_score, 0) AS score
                   FROM (SELECT * FROM keyword WHERE rank <= 100) k FULL JOIN vec USING (query_id, doc_id)),
    fused AS (SELECT query_id, doc_id AS recipe_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM both_sides)
              WHERE rank <= 50 AND query_id IN (SELECT id FROM recipes WHERE id % 50 = 0)),
    lost AS (SELECT query_id, count(*) FILTER (WHERE doc_id IN (SELECT id FROM recipes)) = 0 AS degraded FROM near WHERE doc_id IS NOT NULL GROUP BY 1),
    states AS (SELECT id AS query_id, coalesce(degraded, FALSE) AS degraded, CASE WHEN degraded THEN 'orphans only' ELSE '' END AS reasons
               FROM recipes LEFT JOIN lost ON lost.query_id = id WHERE id % 50 = 0)"""
_FACTS = """
    stored AS (SELECT r.id AS recipe_id, title, difficulty, cook_time_minutes, coalesce(len(steps), 0) AS n_steps,
        coalesce((SELECT string_agg(concat_ws('：', i.name, nullif(b.amount, '')), '；' ORDER BY i.id)
                  FROM (SELECT ingredient_id, min(amount) AS amount FROM recipe_ingredients x WHERE x.recipe_id = r.id GROUP BY 1) b
                  JOIN ingredients i ON i.id = b.ingredient_id WHERE i.category = '调料'), '') AS seasonings FROM recipes r)"""


def _vectors(of: str, name: str) -> str:
    """CTEs: ``name`` (item, vec), the hash embeddings of the table ``of`` (item, text) in 64 dimensions."""
    return f"""
    {name}_t AS (SELECT item, unnest({Q.sql_tokens("text")}) AS term FROM {of}),
    {name}_c AS (SELECT item, CAST(('0x' || right(md5(term), 3)) AS INT) % 64 AS slot, count(*) AS c FROM {name}_t GROUP BY 1, 2),
    {name}_m AS (SELECT item, map_from_entries(list((slot, c))) AS m, sqrt(sum(c * c)) AS norm FROM {name}_c GROUP BY 1),
    {name} AS (SELECT item, list_transform(range(64), lambda i: CAST(coalesce(m[i], 0) / norm AS DOUBLE)) AS vec FROM {name}_m)"""


_ENTRIES = """
    entries AS (SELECT id AS item, array_to_string(list_concat([name], list_filter(coalesce(aliases, []), lambda a: a IS NOT NULL AND a <> '')), ' ') AS text FROM ingredients)"""
_LINK = f"""
        asked AS (SELECT DISTINCT name AS item, {Q.sql_clean('name')} AS term FROM crawled_ingredients WHERE name IS NOT NULL),
        terms AS (SELECT term, tier, min(id) AS id FROM (SELECT name AS term, id, 1 AS tier FROM ingredients UNION ALL SELECT unnest(aliases), id, 2 FROM ingredients) WHERE term <> '' GROUP BY 1, 2),
        direct AS (SELECT item, arg_min(id, tier) AS id, min(tier) AS tier FROM asked JOIN terms USING (term) WHERE term <> '' GROUP BY 1),
        held AS (SELECT item, i.id, row_number() OVER (PARTITION BY item ORDER BY length(i.name) DESC, i.id) AS rn
                 FROM asked a JOIN ingredients i ON contains(a.term, {Q.sql_clean('i.name')}) OR contains({Q.sql_clean('i.name')}, a.term)
                 WHERE a.term <> '' AND item NOT IN (SELECT item FROM direct)),
        linked AS (SELECT * FROM direct UNION ALL SELECT item, id, 3 FROM held WHERE rn = 1)"""


def _ranked(candidates: str, extra: str = "") -> str:
    """The five best of ``candidates`` (query_id, recipe_id, score) with what they miss."""
    return f"""
        blended AS (SELECT k.query_id, k.recipe_id, n_missing{extra},
            0.4 * CASE WHEN max(k.score) OVER q > 0 THEN k.score / max(k.score) OVER q ELSE 0 END
            + 0.5 * CASE WHEN essential_total > 0 THEN (essential_total - n_missing) / essential_total ELSE 1 END
            + 0.05 * CASE difficulty WHEN 1 THEN 1 WHEN 2 THEN 0.5 ELSE 0 END
            + 0.05 * CASE WHEN cook_time_minutes <= 30 THEN 1 WHEN cook_time_minutes <= 60 THEN 0.5 ELSE 0 END AS score
          FROM {candidates} k JOIN missing USING (query_id, recipe_id) JOIN recipes r ON r.id = k.recipe_id WINDOW q AS (PARTITION BY k.query_id)),
        ranked AS (SELECT query_id, recipe_id, rank, n_missing, round(score, 6) AS score{extra} FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_missing, round(score, 9) DESC, recipe_id) AS rank FROM blended) WHERE rank <= 5)"""


_MISSING_FUSED = _MISSING.replace("SELECT query_id, doc_id AS recipe_id, score FROM keyword WHERE rank <= 50", "SELECT query_id, recipe_id, score, degraded FROM fused JOIN states USING (query_id)")
_RANKED_HYBRID = f"{Q.BM25}, {Q.KNN}, {_HYBRID}, {_MISSING_FUSED}, {_KEPT}, {_ranked('kept', ', degraded')}"
SQL = {
    "resolve_names": f"WITH {_TERMS} SELECT item_id AS query_id, name AS raw, t.id FROM (SELECT DISTINCT item_id, name FROM crawled_ingredients) c LEFT JOIN known t ON t.term = {Q.sql_clean('c.name')} WHERE {Q.sql_clean('c.name')} <> ''",
    "essential_items": f"WITH {_ESSENTIAL} SELECT * FROM essential",
    "missing_items": f"WITH {Q.BM25}, {_MISSING} SELECT query_id, recipe_id, essential_total, missing FROM missing",
    "exclude_tagged": f"WITH {Q.BM25}, {_MISSING}, {_KEPT} SELECT query_id, recipe_id FROM kept",
    "rank_lexicographic": f"WITH {Q.BM25}, {_MISSING}, {_KEPT}, {_ranked('kept')} SELECT * FROM ranked",
    "link_items": f"WITH {_LINK} SELECT a.item, l.id, l.tier FROM asked a LEFT JOIN linked l USING (item)",
    "link_vectors": f"""WITH {_LINK}, {_ENTRIES}, names AS (SELECT item, item AS text FROM asked), {_vectors('entries', 'ev')}, {_vectors('names', 'nv')},
        near AS (SELECT n.item, e.item AS id, round(1 - list_cosine_similarity(n.vec, e.vec), 9) AS d FROM nv n, ev e WHERE n.item NOT IN (SELECT item FROM linked)),
        best AS (SELECT item, arg_min(id, (d, id)) AS id, min(d) AS d FROM near GROUP BY 1),
        every AS (SELECT * FROM linked UNION ALL SELECT item, id, 4 FROM best WHERE 1 - d >= 0.6)
        SELECT a.item, l.id, l.tier FROM asked a LEFT JOIN every l USING (item)""",
    "hybrid_states": f"""WITH {Q.BM25}, {Q.KNN}, {_HYBRID}
        SELECT s.query_id, coalesce(n, 0) AS candidates, s.degraded AND n IS NOT NULL AS degraded, reasons FROM states s LEFT JOIN (SELECT query_id, count(*) AS n FROM fused GROUP BY 1) f USING (query_id)""",
    "rank_hybrid": f"WITH {_RANKED_HYBRID} SELECT * FROM ranked",
    "recommend": f"WITH {_RANKED_HYBRID}, {_FACTS} SELECT query_id, recipe_id, rank, title, difficulty, cook_time_minutes, n_steps, seasonings FROM ranked JOIN stored USING (recipe_id)",
    "recipe_facts": f"WITH {_FACTS} SELECT doc_id AS query_id, s.* FROM documents d JOIN stored s ON s.recipe_id = d.recipe_id",
    "lookup_by_url": "SELECT envelope_id, r.id AS recipe_id, r.title FROM crawled_recipes c LEFT JOIN recipes r ON r.source_url = c.source_url WHERE c.source_url IS NOT NULL",
    "valid_choices": f"""WITH {Q.BM25}, c AS (SELECT query_id, doc_id AS recipe_id, rank FROM keyword WHERE rank <= 5)
        SELECT query_id, recipe_id, row_number() OVER (PARTITION BY query_id ORDER BY c.rank, recipe_id) AS place, title, difficulty, cook_time_minutes,
               CASE WHEN query_id % 100 = 0 AND c.rank = 3 THEN 1 ELSE coalesce(len(steps), 0) END AS n_steps, CASE WHEN query_id % 100 = 0 AND c.rank = 3 THEN 'choice' ELSE 'recipe' END AS steps_from,
               query_id % 100 <> 0 AS degraded FROM c JOIN recipes r ON r.id = recipe_id WHERE query_id % 100 <> 0 OR c.rank <> 2""",
    "request_faults": f"""WITH r AS (SELECT DISTINCT item_id, name, amount, pos, regexp_replace(coalesce(name, ''), '{Q._STRIP}', '', 'g') AS q FROM crawled_ingredients),
        l AS (SELECT *, {Q.sql_csv('amount')} AS xs, {Q.sql_csv('name')} AS ys FROM r),
        f AS (SELECT *, CASE WHEN q = '' THEN 'empty text' WHEN length(q) > 200 THEN 'long text' WHEN regexp_matches(q, '{Q._CONTROLS}') THEN 'control character'
            WHEN pos IS NULL OR pos NOT BETWEEN 1 AND 50 THEN 'limit' WHEN len(xs) > 30 THEN 'many ingredients' WHEN len(list_filter(xs, lambda v: length(v) > 50)) > 0 THEN 'long ingredients'
            WHEN len(list_filter(xs, lambda v: regexp_matches(v, '{Q._CONTROLS}'))) > 0 THEN 'control character in ingredients' WHEN len(ys) > 20 THEN 'many exclude_tags'
            WHEN len(list_filter(ys, lambda v: length(v) > 50)) > 0 THEN 'long exclude_tags' WHEN len(list_filter(ys, lambda v: regexp_matches(v, '{Q._CONTROLS}'))) > 0 THEN 'control character in exclude_tags' END AS reason FROM l)
        SELECT item_id AS request_id, reason IS NULL AS valid, reason FROM f""",
    "autocomplete_topup": f"""WITH qs AS (SELECT DISTINCT regexp_extract(name, '^([A-Za-z0-9]+|[\\x{{4e00}}-\\x{{9fff}}]{{1,2}})', 1) AS q FROM crawled_ingredients),
        asked AS (SELECT q FROM qs WHERE q <> ''), {_ENTRIES}, names AS (SELECT q AS item, q AS text FROM asked), {_vectors('entries', 'ev')}, {_vectors('names', 'nv')},
        found AS (SELECT * FROM (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY name, id) AS pos FROM asked JOIN ingredients i
                  ON contains(i.name, q) OR len(list_filter(coalesce(i.aliases, []), lambda a: contains(coalesce(a, ''), q))) > 0) WHERE pos <= 10),
        near AS (SELECT * FROM (SELECT n.item AS q, e.item AS id, row_number() OVER (PARTITION BY n.item ORDER BY round(1 - list_cosine_similarity(n.vec, e.vec), 9), e.item) AS pos FROM nv n, ev e) WHERE pos <= 40),
        every AS (SELECT q, id, 0 AS tier, pos FROM found UNION ALL SELECT q, id, 1, pos FROM near WHERE (q, id) NOT IN (SELECT (q, id) FROM found)),
        placed AS (SELECT q, id, tier, row_number() OVER (PARTITION BY q ORDER BY tier, pos, id) AS place FROM every)
        SELECT * FROM placed WHERE place <= 10""",
    "dictionary_vectors": f"""WITH {_ENTRIES}, e AS (SELECT i.id, i.name, created_at < TIMESTAMP '2024-01-01' AND len({Q.sql_tokens('i.name')}) > 0 AS was, e.text FROM ingredients i JOIN entries e ON e.item = i.id WHERE len({Q.sql_tokens('e.text')}) > 0)
        SELECT id, CASE WHEN NOT was THEN 'new' WHEN name = text THEN 'unchanged' ELSE 'changed' END AS change, 64 AS dim FROM e""",
    "linking_accuracy": f"""WITH {_LINK}, cases AS (SELECT DISTINCT source_url, name FROM crawled_ingredients WHERE source_url IS NOT NULL AND name IS NOT NULL),
        found AS (SELECT DISTINCT source_url, id FROM cases JOIN linked ON linked.item = cases.name),
        expected AS (SELECT DISTINCT r.source_url, b.ingredient_id AS id FROM recipe_ingredients b JOIN recipes r ON r.id = b.recipe_id JOIN ingredients i ON i.id = b.ingredient_id WHERE r.source_url IN (SELECT source_url FROM cases)),
        n AS (SELECT count(f.id) AS hits, count(*) AS total FROM expected LEFT JOIN found f USING (source_url, id))
        SELECT hits, total, round(hits / total, 6) AS accuracy FROM n""",
    "parse_canonical": f"""WITH {_TERMS}, {_ITEMS} SELECT item_id, pos, coalesce(i.name, items.name) AS name, quantity FROM items LEFT JOIN known k ON k.term = items.name LEFT JOIN ingredients i ON i.id = k.id""",
    "tags_grouped": """SELECT kind, list_position(['allergen', 'avoid', 'cuisine', 'taste'], kind) AS place, string_agg(name, '、' ORDER BY name) AS names FROM tags
        WHERE kind IN ('allergen', 'avoid', 'cuisine', 'taste') GROUP BY 1""",
    "autocomplete": """WITH q AS (SELECT DISTINCT left(name, 1) AS q FROM crawled_ingredients WHERE name <> ''),
        hit AS (SELECT q, id, name, row_number() OVER (PARTITION BY q ORDER BY name, id) AS pos FROM q JOIN ingredients i
                ON contains(i.name, q) OR len(list_filter(coalesce(i.aliases, []), lambda a: contains(coalesce(a, ''), q))) > 0)
        SELECT * FROM hit WHERE pos <= 10""",
    "parse_items": f"WITH {_ITEMS} SELECT * FROM items",
    "build_query": f"""WITH r AS (SELECT DISTINCT source_url, pos, coalesce(name, '') AS name FROM crawled_ingredients),
        f AS (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY pos NULLS FIRST, name) AS n FROM r),
        c AS (SELECT source_url, {Q.sql_clean('name')} AS name, min(n) AS n FROM f WHERE n <= 30 GROUP BY 1, 2)
        SELECT s.source_url AS query_id, coalesce(string_agg(c.name, ' ' ORDER BY c.n), '') AS query
        FROM (SELECT DISTINCT source_url FROM r) s LEFT JOIN (SELECT * FROM c WHERE name <> '' AND length(name) <= 50) c ON c.source_url = s.source_url GROUP BY 1""",
    "detail_lists": """SELECT recipe_id, coalesce(string_agg(name, '、' ORDER BY id) FILTER (WHERE category IS DISTINCT FROM '调料'), '') AS ingredients,
        coalesce(string_agg(name, '、' ORDER BY id) FILTER (WHERE category IS NOT DISTINCT FROM '调料'), '') AS seasonings
        FROM (SELECT DISTINCT recipe_id, ingredient_id FROM recipe_ingredients) b JOIN ingredients i ON i.id = b.ingredient_id GROUP BY 1""",
    "tags_by_kind": "SELECT kind, name, count(r.recipe_id) AS n FROM tags LEFT JOIN (SELECT DISTINCT * FROM recipe_tags) r ON r.tag_id = tags.id GROUP BY tags.id, kind, name",
    "tag_sets": f"""SELECT recipe_id, string_agg(DISTINCT {Q.sql_clean('name')}, '|' ORDER BY {Q.sql_clean('name')}) AS tag_key FROM recipe_tags JOIN tags ON tags.id = tag_id GROUP BY 1""",
}
