"""Queries on text, keyword search, vectors and their fusion.

A search takes as queries every row whose id is divisible by 50, against all rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import feedback as FB
from ..operators import search as S
from ..runtime import own_dir, table

TOP_K, DEPTH = 10, 50
#: The tables of the corpus, and what of them it is made of.
CORPUS_COLUMNS = {"recipes": ("id", "title", "description"), "recipe_ingredients": ("recipe_id", "ingredient_id"), "ingredients": ("id", "name", "aliases"), "recipe_tags": ("recipe_id", "tag_id"), "tags": ("id", "name")}


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return S.corpus_text(*(table(spark, d, t) for t in CORPUS_COLUMNS))


def asked(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, text): titles of the recipes whose id is divisible by 50."""
    return table(spark, d, "recipes").where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("title").alias("text"))


def index(spark: SparkSession, d: str) -> S.TextIndex:
    """The index of the corpus: stored below the shared folder and built anew when a column that it is made of has changed."""
    inputs = tuple(table(spark, d, t).select(*cols) for t, cols in CORPUS_COLUMNS.items())
    return S.refreshed_index(f"{own_dir(spark)}/index-{hashlib.md5(d.encode()).hexdigest()}", inputs, lambda: corpus(spark, d))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("long").alias("doc_id"), F.col("embedding").alias("vec"))


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", X.clean_text("text").alias("cleaned"))


def clean_lines(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", X.clean_lines("text").alias("cleaned"))


def tokenize(spark: SparkSession, d: str) -> DataFrame:
    t = docs(spark, d).select("doc_id", X.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


def corpus_text(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d)


def corpus_probe(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "recipes")
    return r.agg(F.count("id").alias("n"), F.coalesce(F.max("id"), F.lit(0)).alias("max_id"), F.max("updated_at").alias("last_change"))


def bm25_term_stats(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).term_stats.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = S.bm25_topk(index(spark, d), asked(spark, d), TOP_K)
    return hits.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = S.knn(chunks(spark, d), vector_queries(spark, d), 4 * TOP_K)
    return hits.select("query_id", "chunk_id", "rank", F.round("distance", 6).alias("distance"))


def knn_within(spark: SparkSession, d: str) -> DataFrame:
    hits = S.within(S.knn(chunks(spark, d), vector_queries(spark, d), 4 * TOP_K), 0.8)
    return hits.select("query_id", "chunk_id", "rank", F.round("distance", 6).alias("distance"))


def near_hits(spark: SparkSession, d: str) -> DataFrame:
    return S.within(S.knn(chunks(spark, d), vector_queries(spark, d), 4 * TOP_K), 0.8)


def known(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "recipes").select(F.col("id").alias("doc_id"))


def _rolled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return S.roll_up(near_hits(spark, d), known(spark, d))


def collection_counts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, different documents, and whether all vectors are of one size."""
    c = chunks(spark, d)
    sizes = S.one_dimension(c)
    return c.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("doc_id").alias("docs")).crossJoin(F.broadcast(sizes))


def vector_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _rolled(spark, d)[0].select("query_id", "doc_id", F.round("vector_score", 9).alias("vector_score"))


def vector_degraded(spark: SparkSession, d: str) -> DataFrame:
    return _rolled(spark, d)[1]


def hybrid_fusion(spark: SparkSession, d: str) -> DataFrame:
    keyword = S.bm25_topk(index(spark, d), asked(spark, d), 2 * TOP_K)
    out = S.fuse(keyword, _rolled(spark, d)[0], TOP_K)
    return out.select("query_id", "doc_id", "rank", F.round("score", 9).alias("score"))


def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    return S.hash_embeddings(docs(spark, d), 64).select("doc_id", "slot", F.round("value", 6).alias("value"))


def vector_upkeep(spark: SparkSession, d: str) -> DataFrame:
    """Chunks left when those of vanished recipes are deleted."""
    gone = chunks(spark, d).join(table(spark, d, "recipes").select(F.col("id").alias("doc_id")), "doc_id", "left_anti")
    return S.delete_vectors(chunks(spark, d), gone).select("chunk_id", "doc_id")


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """How many of the recipes with the same cleaned title the search finds."""
    title = table(spark, d, "recipes").select("id", X.clean_text("title").alias("t"))
    q = title.where("id % 50 = 0").select(F.col("id").alias("query_id"), "t")
    relevant = q.join(title.withColumnRenamed("id", "doc_id"), "t").select("query_id", "doc_id")
    out = FB.recall_at_k(S.bm25_topk(index(spark, d), asked(spark, d), 5), relevant, 5)
    return out.select("queries", F.round("recall", 6).alias("recall"), F.round("coverage", 6).alias("coverage"))


QUERIES = {
    f.__name__: f
    for f in (clean_text, clean_lines, tokenize, corpus_text, corpus_probe, bm25_term_stats, bm25_topk, knn_topk, knn_within, vector_rollup, vector_degraded)
    + (hybrid_fusion, hash_embedding, vector_upkeep, recall_at_k, collection_counts)
}

_CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
_STRIP = r"^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$"


def sql_clean(c: str) -> str:
    inner = f"regexp_replace(regexp_replace(coalesce({c}, ''), '{_CONTROLS}', '', 'g'), '[ \\t\\x{{3000}}]+', ' ', 'g')"
    return f"regexp_replace({inner}, '{_STRIP}', '', 'g')"


def sql_csv(c: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({c}, ''), ','), lambda v: regexp_replace(v, '{_STRIP}', '', 'g')), lambda v: v <> '')"


def sql_tokens(c: str) -> str:
    runs = f"regexp_extract_all({c}, '[\\x{{4e00}}-\\x{{9fff}}]+')"
    pairs = f"flatten(list_transform({runs}, lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substring(r, i, 2)) END))"
    return f"list_concat({pairs}, list_transform(regexp_extract_all({c}, '[A-Za-z0-9]+'), lambda w: lower(w)))"


CORPUS = f"""
    used AS (SELECT b.recipe_id, string_agg(array_to_string(list_concat([i.name], list_filter(coalesce(i.aliases, []), lambda a: a IS NOT NULL AND a <> '')), ' '), ' ' ORDER BY i.id) AS w
             FROM (SELECT DISTINCT recipe_id, ingredient_id FROM recipe_ingredients) b JOIN ingredients i ON i.id = b.ingredient_id GROUP BY 1),
    tagged AS (SELECT b.recipe_id, string_agg(t.name, ' ' ORDER BY t.id) AS t FROM (SELECT DISTINCT recipe_id, tag_id FROM recipe_tags) b JOIN tags t ON t.id = b.tag_id GROUP BY 1),
    corpus AS (SELECT r.id AS doc_id, {sql_clean("concat_ws(' ', nullif(title, ''), nullif(description, ''), nullif(w, ''), nullif(t, ''))")} AS text
               FROM recipes r LEFT JOIN used ON used.recipe_id = r.id LEFT JOIN tagged ON tagged.recipe_id = r.id)"""
INDEX = f"""{CORPUS},
    toks AS (SELECT doc_id, {sql_tokens("text")} AS toks FROM corpus),
    totals AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM toks),
    postings AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM toks) GROUP BY 1, 2),
    dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
    raws AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, totals),
    term_stats AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raws) ELSE raw END AS idf FROM raws)"""
BM25 = f"""{INDEX},
    terms AS (SELECT query_id, term, count(*) AS times FROM (SELECT id AS query_id, unnest({sql_tokens("coalesce(title, '')")}) AS term FROM recipes WHERE id % 50 = 0) GROUP BY 1, 2),
    scored AS (SELECT query_id, p.doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks) / avgdl))) AS score
               FROM terms JOIN term_stats USING (term) JOIN postings p USING (term) JOIN toks ON toks.doc_id = p.doc_id, totals GROUP BY 1, 2),
    keyword AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored WHERE score > 0)"""
KNN = """
    vecs AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    dist AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, CAST(c.label AS BIGINT) AS doc_id, 1 - list_cosine_similarity(q.v, c.v) AS distance FROM vecs q, vecs c WHERE q.vec_id % 50 = 0),
    knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), chunk_id) AS rank FROM dist) WHERE rank <= 40),
    near AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS rank FROM knn WHERE distance <= 0.8),
    vec AS (SELECT query_id, doc_id, 0.5 * avg(1.0 / (60 + rank)) AS vector_score FROM near WHERE doc_id IN (SELECT id FROM recipes) GROUP BY 1, 2)"""
_LINES = f"regexp_replace(regexp_replace(coalesce(text, ''), '{_CONTROLS}', '', 'g'), '\\r\\n?', chr(10), 'g')"

SQL = {
    "clean_text": f"SELECT doc_id, {sql_clean('text')} AS cleaned FROM documents",
    "clean_lines": f"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split({_LINES}, chr(10)),
        lambda x: regexp_replace(regexp_replace(x, '[ \\t\\x{{3000}}]+', ' ', 'g'), '{_STRIP}', '', 'g')), lambda x: x <> ''), chr(10)) AS cleaned FROM documents""",
    "tokenize": f"""SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {sql_tokens("coalesce(text, '')")} AS t FROM documents)""",
    "corpus_text": f"WITH {CORPUS} SELECT * FROM corpus",
    "corpus_probe": "SELECT count(id) AS n, coalesce(max(id), 0) AS max_id, max(updated_at) AS last_change FROM recipes",
    "bm25_term_stats": f"WITH {INDEX} SELECT term, df, round(idf, 6) AS idf FROM term_stats",
    "bm25_topk": f"WITH {BM25} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM keyword WHERE rank <= 10",
    "knn_topk": f"WITH {KNN} SELECT query_id, chunk_id, rank, round(distance, 6) AS distance FROM knn",
    "knn_within": f"WITH {KNN} SELECT query_id, chunk_id, rank, round(distance, 6) AS distance FROM near",
    "vector_rollup": f"WITH {KNN} SELECT query_id, doc_id, round(vector_score, 9) AS vector_score FROM vec",
    "vector_degraded": f"WITH {KNN} SELECT query_id, count(*) FILTER (WHERE doc_id IN (SELECT id FROM recipes)) = 0 AS degraded FROM near WHERE doc_id IS NOT NULL GROUP BY 1",
    "hybrid_fusion": f"""WITH {BM25}, {KNN},
        both_sides AS (SELECT query_id, doc_id, coalesce(0.5 / (60 + k.rank), 0) + coalesce(vector_score, 0) AS score
                       FROM (SELECT * FROM keyword WHERE rank <= 20) k FULL JOIN vec USING (query_id, doc_id)),
        fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM both_sides)
        SELECT query_id, doc_id, rank, round(score, 9) AS score FROM fused WHERE rank <= 10""",
    "hash_embedding": f"""WITH t AS (SELECT doc_id, unnest({sql_tokens("coalesce(text, '')")}) AS term FROM documents),
        c AS (SELECT doc_id, CAST(('0x' || right(md5(term), 3)) AS INT) % 64 AS slot, count(*) AS c FROM t GROUP BY 1, 2)
        SELECT doc_id, slot, round(c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)), 6) AS value FROM c""",
    "collection_counts": "SELECT count(*) AS chunks, count(DISTINCT label) AS docs, count(DISTINCT len(embedding)) AS dims, count(DISTINCT len(embedding)) <= 1 AS ok FROM embeddings",
    "vector_upkeep": "SELECT vec_id AS chunk_id, CAST(label AS BIGINT) AS doc_id FROM embeddings WHERE label IN (SELECT id FROM recipes)",
    "recall_at_k": f"""WITH {BM25},
        title AS (SELECT id, {sql_clean('title')} AS t FROM recipes),
        relevant AS (SELECT q.id AS query_id, r.id AS doc_id FROM title q JOIN title r USING (t) WHERE q.id % 50 = 0),
        each AS (SELECT query_id, count(*) AS n, count(k.doc_id) AS found FROM relevant LEFT JOIN (SELECT * FROM keyword WHERE rank <= 5) k USING (query_id, doc_id) GROUP BY 1)
        SELECT count(*) AS queries, round(avg(found / n), 6) AS recall, round(avg(CAST(found > 0 AS INT)), 6) AS coverage FROM each""",
}
