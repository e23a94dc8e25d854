"""Queries on ingest, upkeep, feedback and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import feedback as FB
from ..operators import ingest as I
from ..runtime import bounded_broadcast, table
from . import search as Q

#: Rules as a site may publish them.
RULES = [("/recipe/", True), ("/recipe/*/?from=", False), ("/", False), ("/recipe/1*$", False)]


def envelope_status(spark: SparkSession, d: str) -> DataFrame:
    return I.envelope_status(table(spark, d, "crawled_recipes").select("envelope_id", "body"))


def ingest_counts(spark: SparkSession, d: str) -> DataFrame:
    return envelope_status(spark, d).groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))


def insert_new(spark: SparkSession, d: str) -> DataFrame:
    """The first envelope of each address that had no recipe before 2025."""
    new = table(spark, d, "crawled_recipes").select("source_url", "envelope_id", "site").where("source_url is not null")
    return I.insert_new(table(spark, d, "recipes").where("created_at < timestamp'2025-01-01'").select("source_url"), new, "source_url", "envelope_id")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return envelope_status(spark, d).join(table(spark, d, "crawled_recipes").select("envelope_id", "source_url"), "envelope_id")


def load_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What a load of all envelopes does to each, over the recipes from before 2025."""
    return I.load_outcomes(_judged(spark, d), table(spark, d, "recipes").where("created_at < timestamp'2025-01-01'").select("source_url"))


def load_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counters and exit code of the load; five unreadable envelopes on end stop it."""
    s = envelope_status(spark, d).select(F.lit("load").alias("stream"), F.col("envelope_id").alias("pos"), (F.col("status") == "invalid").alias("failed"))
    return I.load_summary(load_outcomes(spark, d), s)


def split_seasonings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "crawled_ingredients").select(F.col("source_url").alias("recipe"), "name", "amount", "is_essential", F.struct("pos", "item_id").alias("pos")).distinct()
    out = I.split_seasonings(rows, seasoning_aliases(spark, d))
    return out.select("recipe", "section", "name", "amount", "is_essential", F.col("pos.item_id").alias("item_id"))


def accept_feedback(spark: SparkSession, d: str) -> DataFrame:
    """The feedback created from 2025 on, as requests over the rows from before."""
    f = table(spark, d, "user_feedback")
    new = f.where("created_at >= timestamp'2025-01-01'").select(F.col("id").alias("request_id"), "recipe_id", "client_fingerprint", "action").distinct()
    new = new.where("recipe_id is not null and client_fingerprint is not null")
    return FB.accept_feedback(f.where("created_at < timestamp'2025-01-01'"), new, table(spark, d, "recipes"))


def get_or_create(spark: SparkSession, d: str) -> DataFrame:
    return I.get_or_create(table(spark, d, "ingredients").select("id", "name"), table(spark, d, "crawled_ingredients").select("name"))


def upsert_changes(spark: SparkSession, d: str) -> DataFrame:
    """Titles of recipes against those of the last envelope of the same address."""
    last = table(spark, d, "crawled_recipes").select("source_url", "envelope_id", F.get_json_object("body", "$.recipe.title").alias("title"))
    last = last.where("source_url is not null and title is not null").groupBy("source_url").agg(F.max_by("title", "envelope_id").alias("title"))
    return I.upsert_changes(table(spark, d, "recipes").select("source_url", "title"), last, "source_url", ["title"]).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def merge_amounts(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "ingredients").where("category = '调料'").select("name", F.col("category"))
    rows = table(spark, d, "crawled_ingredients").select(F.col("source_url").alias("recipe"), "name", "amount", "is_essential", F.struct("pos", "item_id").alias("pos")).distinct()
    rows = rows.join(bounded_broadcast(known, 10_000), "name", "left")
    return I.merge_amounts(rows).select("recipe", "name", "amount", "is_essential", "category", F.col("pos.pos").alias("pos"))


def seasoning_aliases(spark: SparkSession, d: str) -> DataFrame:
    """(alias, canonical) of the seasonings in the dictionary."""
    seasoning = table(spark, d, "ingredients").where("category = '调料'")
    each = seasoning.select(F.col("name").alias("canonical"), F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    return each.where("alias <> ''").groupBy("alias").agg(F.min("canonical").alias("canonical"))


def classify_by_alias(spark: SparkSession, d: str) -> DataFrame:
    return I.classify_by_alias(table(spark, d, "crawled_ingredients").select("name"), seasoning_aliases(spark, d)).where("canonical is not null")


def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Rows left of each table when the recipes of one site's addresses are deleted."""
    gone = table(spark, d, "recipes").where(F.col("source_url").startswith("https://m.")).select("id")
    r, b, t, f = I.delete_recipes(gone, *(table(spark, d, n) for n in ("recipes", "recipe_ingredients", "recipe_tags", "user_feedback")))
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n")
    return count(r, "recipes").union(count(b, "recipe_ingredients")).union(count(t, "recipe_tags")).union(count(f.where("recipe_id is not null"), "user_feedback"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    """(id, section, pos, name, amount): the dictionary entries of each recipe, each pair once."""
    named = table(spark, d, "ingredients").select(F.col("id").alias("pos"), "name", F.when(F.col("category") == "调料", "seasonings").otherwise("ingredients").alias("section"))
    used = table(spark, d, "recipe_ingredients").groupBy(F.col("recipe_id").alias("id"), F.col("ingredient_id").alias("pos")).agg(F.min("amount").alias("amount"))
    return used.join(bounded_broadcast(named, 10_000), "pos").select("id", "section", "pos", "name", "amount")


def recipe_units(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "recipes")
    return I.recipe_units(r, _items(spark, d).join(r.select("id"), "id", "left_semi"))


def recipe_documents(spark: SparkSession, d: str) -> DataFrame:
    return I.recipe_documents(recipe_units(spark, d))


def recipe_chunks(spark: SparkSession, d: str) -> DataFrame:
    return I.chunk_units(recipe_units(spark, d), 500)


def latest_failures(spark: SparkSession, d: str) -> DataFrame:
    """The last fault of each address that no valid envelope has made good."""
    s = envelope_status(spark, d).join(table(spark, d, "crawled_recipes").select("envelope_id", F.col("source_url").alias("url")), "envelope_id").where("url is not null")
    s = s.select("url", F.lit("parse").alias("stage"), F.col("envelope_id").alias("pos"), F.col("reason").alias("error"))
    return I.latest_failures(s.where("error is not null"), s.where("error is null")).select("url", "stage", "error", "pos")


def circuit_breaks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("pos"), (F.col("event_type") == "error").alias("failed"))
    return I.circuit_breaks(e, 3)


def url_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "recipes").select("id", X.normal_url("source_url").alias("url"), X.url_host("source_url").alias("host"), X.source_hash("source_url").alias("hash"))


def robots_allowed(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "pattern string, allow boolean")
    return I.allowed_by_rules(table(spark, d, "recipes").select(F.col("source_url").alias("url")).where("url is not null"), rules)


def split_instructions(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "recipes").select("id", F.posexplode("steps").alias("pos", "s"))
    return steps.select("id", "pos", F.posexplode(X.split_instructions(F.col("s.instruction"))).alias("part", "text"))


def feedback_distinct(spark: SparkSession, d: str) -> DataFrame:
    return FB.distinct_feedback(table(spark, d, "user_feedback"))


def feedback_counts(spark: SparkSession, d: str) -> DataFrame:
    return FB.action_counts(feedback_distinct(spark, d))


def feedback_top5(spark: SparkSession, d: str) -> DataFrame:
    """The recipes with most feedback; feedback without a recipe is one group. Of equal ones the first to get any."""
    rows = feedback_distinct(spark, d)
    first = rows.groupBy("recipe_id").agg(F.min("id").alias("first"))
    c = FB.action_counts(rows)
    both = c.join(first, c.recipe_id.eqNullSafe(first.recipe_id)).select(c.recipe_id, "likes", "dislikes", "total", "first")
    return both.orderBy(F.desc("total"), "first").limit(5).drop("first")


def feedback_export(spark: SparkSession, d: str) -> DataFrame:
    return FB.export_lines(feedback_distinct(spark, d), "2026-01-01T00:00:00+00:00")


def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    """The address of each recipe as its page may state it, from the root, and the plain form on the sites of the main domain."""
    r = table(spark, d, "recipes").select("id", "source_url", F.regexp_extract("source_url", r"^[a-z]+://[^/]*(/.*)$", 1).alias("path"))
    return r.select("id", X.absolute_url("path", "source_url").alias("absolute"), X.canonical_url("path", "source_url", ["www.kitchenlake.example", "m.kitchenlake.example"]).alias("canonical"))


def data_blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tags").select("id", X.data_block("id", "name", "kind").alias("block"))


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", X.fingerprint(F.col("user_id").cast("string"), "pepper").alias("fingerprint"))


def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "events").select(F.col("user_id").alias("client"), "ts", F.col("event_id").alias("request_id"))
    out = FB.over_limit(r, 2, 3600)
    return out.where("refused").select("client", "request_id", "window_start", "n")


def latency_p95(spark: SparkSession, d: str) -> DataFrame:
    out = FB.latency_p95(table(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("value").alias("ms")))
    return out.select("kind", "n", "p95", F.round("mean", 6).alias("mean"))


QUERIES = {
    f.__name__: f
    for f in (envelope_status, ingest_counts, insert_new, get_or_create, upsert_changes, merge_amounts, classify_by_alias, delete_cascade, recipe_units, recipe_chunks)
    + (latest_failures, circuit_breaks, url_parts, robots_allowed, split_instructions, feedback_distinct, feedback_counts, feedback_top5, feedback_export)
    + (fingerprints, rate_limit, latency_p95, load_outcomes, load_summary, split_seasonings, accept_feedback, recipe_documents, canonical_urls, data_blocks)
}

_STATUS = """
    parsed AS (SELECT envelope_id, source_url, body, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS v FROM crawled_recipes),
    judged AS (SELECT envelope_id, source_url, CASE WHEN body IS NULL THEN 'null' WHEN v IS NULL THEN 'unreadable' WHEN json_type(v) <> 'OBJECT' THEN 'not an object'
        WHEN coalesce(TRY_CAST(v->>'$.schema_version' AS INT), -1) <> 1 THEN 'version' WHEN coalesce(json_type(v, '$.recipe'), '') <> 'OBJECT' THEN 'no recipe'
        WHEN coalesce(v->>'$.recipe.title', '') = '' THEN 'no title' END AS reason FROM parsed)"""
_DISTINCT = """
    f AS (SELECT id, recipe_id, client_fingerprint, lower(trim(action)) AS action, created_at FROM user_feedback),
    feedback AS (SELECT recipe_id, client_fingerprint, action, min(id) AS id, arg_min(created_at, id) AS created_at FROM f WHERE recipe_id IS NOT NULL AND client_fingerprint IS NOT NULL GROUP BY 1, 2, 3
                 UNION ALL SELECT DISTINCT recipe_id, client_fingerprint, action, id, created_at FROM f WHERE recipe_id IS NULL OR client_fingerprint IS NULL),
    counts AS (SELECT recipe_id, min(id) AS first, count(*) FILTER (WHERE action = 'like') AS likes, count(*) FILTER (WHERE action = 'dislike') AS dislikes, count(*) AS total FROM feedback GROUP BY 1)"""
_ALIASES = """
    aliases AS (SELECT alias, min(canonical) AS canonical FROM (SELECT name AS canonical, unnest(list_concat([name], aliases)) AS alias FROM ingredients WHERE category = '调料') WHERE alias <> '' GROUP BY 1)"""
_N = Q.sql_clean("name")
_OUTCOMES = """
    firsts AS (SELECT source_url, min(envelope_id) AS first FROM judged WHERE reason IS NULL GROUP BY 1),
    outcomes AS (SELECT envelope_id, CASE WHEN reason IS NOT NULL THEN 'invalid'
        WHEN j.source_url IS NOT NULL AND (j.source_url IN (SELECT source_url FROM recipes WHERE created_at < TIMESTAMP '2025-01-01') OR first < envelope_id) THEN 'skipped' ELSE 'saved' END AS outcome
        FROM judged j LEFT JOIN firsts f ON f.source_url = j.source_url)"""
_SPACED = "coalesce(steps[i].instruction, '')"
_NUMBERED = f"([^\\s\\x0B])[\\s\\x0B]+([0-9]+[{X.STEP_MARKS}])"
_UNITS = f"""
    lines AS (SELECT b.recipe_id AS id, '用料：' || string_agg(concat_ws('：', {Q.sql_clean('i.name')}, nullif(regexp_replace(b.amount, '{Q._STRIP}', '', 'g'), '')), '；' ORDER BY CASE WHEN i.category = '调料' THEN 1 ELSE 0 END, i.id) AS text
              FROM (SELECT recipe_id, ingredient_id, min(amount) AS amount FROM recipe_ingredients GROUP BY 1, 2) b JOIN ingredients i ON i.id = b.ingredient_id
              WHERE b.recipe_id IN (SELECT id FROM recipes) GROUP BY 1),
    told AS (SELECT id, i AS step, {Q.sql_clean('steps[i].instruction')} AS t FROM (SELECT id, steps, unnest(range(1, len(steps) + 1)) AS i FROM recipes)),
    units AS (SELECT * FROM (
        SELECT id, 0 AS seq, 'header' AS unit_type, NULL AS step, concat_ws(chr(10) || chr(10), nullif({Q.sql_clean('title')}, ''), nullif({Q.sql_clean('description')}, '')) AS text FROM recipes
        UNION ALL SELECT id, 1, 'ingredients', NULL, text FROM lines
        UNION ALL SELECT id, step + 1, 'steps', step, '步骤' || step || '：' || t FROM told WHERE t <> '') WHERE text <> '')"""
SQL = {
    "envelope_status": f"WITH {_STATUS} SELECT envelope_id, CASE WHEN reason IS NULL THEN 'valid' ELSE 'invalid' END AS status, reason FROM judged",
    "ingest_counts": f"WITH {_STATUS} SELECT CASE WHEN reason IS NULL THEN 'valid' ELSE 'invalid' END AS status, reason, count(*) AS n FROM judged GROUP BY ALL",
    "insert_new": """SELECT source_url, min(envelope_id) AS envelope_id, arg_min(coalesce(site, ''), envelope_id) AS site FROM crawled_recipes
        WHERE source_url IS NOT NULL AND source_url NOT IN (SELECT source_url FROM recipes WHERE source_url IS NOT NULL AND created_at < TIMESTAMP '2025-01-01') GROUP BY 1""",
    "load_outcomes": f"WITH {_STATUS}, {_OUTCOMES} SELECT envelope_id, outcome FROM outcomes",
    "load_summary": f"""WITH {_STATUS}, {_OUTCOMES}, m AS (SELECT envelope_id, reason IS NOT NULL AS failed, sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY envelope_id) AS good FROM judged),
        breaks AS (SELECT count(*) AS n FROM (SELECT good FROM m WHERE failed GROUP BY 1 HAVING count(*) >= 5))
        SELECT count(*) AS seen, count(*) FILTER (WHERE outcome = 'saved') AS saved, count(*) FILTER (WHERE outcome = 'skipped') AS skipped, count(*) FILTER (WHERE outcome = 'invalid') AS invalid,
               0 AS failed, CASE WHEN (SELECT n FROM breaks) > 0 THEN 3 ELSE 0 END AS exit_code FROM outcomes""",
    "split_seasonings": f"""WITH {_ALIASES}, n AS (SELECT DISTINCT name, {_N} AS n FROM crawled_ingredients WHERE {_N} <> ''),
        known AS (SELECT name, arg_max(canonical, (length(alias), alias)) AS canonical FROM n JOIN aliases ON starts_with(n, alias) OR ends_with(n, alias) GROUP BY 1),
        r AS (SELECT DISTINCT source_url, c.name, amount, is_essential, pos, item_id, canonical FROM crawled_ingredients c LEFT JOIN known ON known.name = c.name)
        SELECT source_url AS recipe, 'seasonings' AS section, canonical AS name, nullif(coalesce(string_agg(amount, '、' ORDER BY pos, item_id, amount) FILTER (WHERE amount <> ''), ''), '') AS amount, FALSE AS is_essential,
               arg_min(item_id, (pos, item_id)) AS item_id FROM r WHERE canonical IS NOT NULL GROUP BY 1, 3
        UNION ALL SELECT source_url, 'ingredients', name, amount, is_essential, item_id FROM r WHERE canonical IS NULL""",
    "canonical_urls": r"""WITH u AS (SELECT id, source_url, regexp_extract(source_url, '^[a-z]+://[^/]*(/.*)$', 1) AS path FROM recipes)
        SELECT id, CASE WHEN path <> '' THEN source_url END AS absolute,
               CASE WHEN regexp_extract(source_url, '^[a-z]+://([^/?#:]+)', 1) IN ('www.kitchenlake.example', 'm.kitchenlake.example') THEN regexp_extract(source_url, '^([a-z]+://[^/?#]+[^?#]*)', 1) END AS canonical FROM u""",
    "data_blocks": """SELECT id, '{"id":' || id || ',"name":"' || name || '","kind":"' || kind || '"}' AS block FROM tags""",
    "get_or_create": """WITH names AS (SELECT DISTINCT name FROM crawled_ingredients WHERE name <> '')
        SELECT i.id, i.name FROM ingredients i JOIN names USING (name)
        UNION ALL SELECT (SELECT max(id) FROM ingredients) + row_number() OVER (ORDER BY left(md5(name), 2), name), name FROM names WHERE name NOT IN (SELECT name FROM ingredients)""",
    "upsert_changes": """WITH last AS (SELECT source_url, arg_max(t, envelope_id) AS title FROM (SELECT source_url, envelope_id, CASE WHEN json_valid(body) THEN body->>'$.recipe.title' END AS t FROM crawled_recipes)
          WHERE source_url IS NOT NULL AND t IS NOT NULL GROUP BY 1)
        SELECT CASE WHEN r.source_url IS NULL THEN 'created' WHEN l.source_url IS NULL THEN 'kept' WHEN r.title IS NOT DISTINCT FROM l.title THEN 'unchanged' ELSE 'updated' END AS change, count(*) AS n
        FROM recipes r FULL JOIN last l ON l.source_url = r.source_url GROUP BY 1""",
    "merge_amounts": f"""WITH r AS (SELECT DISTINCT source_url, {_N} AS name, regexp_replace(amount, '{Q._STRIP}', '', 'g') AS amount, is_essential, pos, item_id,
                CASE WHEN name IN (SELECT name FROM ingredients WHERE category = '调料') THEN '调料' END AS category FROM crawled_ingredients)
        SELECT source_url AS recipe, name, max(category) AS category, coalesce(string_agg(amount, '、' ORDER BY pos, item_id, amount) FILTER (WHERE amount <> ''), '') AS amount,
               arg_min_null(is_essential, (pos, item_id)) AS is_essential, min(pos) AS pos FROM r WHERE name <> '' GROUP BY 1, 2""",
    "classify_by_alias": f"""WITH {_ALIASES}, n AS (SELECT DISTINCT name, {_N} AS n FROM crawled_ingredients WHERE {_N} <> '')
        SELECT name, arg_max(canonical, (length(alias), alias)) AS canonical FROM n JOIN aliases ON starts_with(n, alias) OR ends_with(n, alias) GROUP BY 1""",
    "delete_cascade": """WITH gone AS (SELECT id FROM recipes WHERE starts_with(source_url, 'https://m.'))
        SELECT 'recipes' AS table_name, count(*) AS n FROM recipes WHERE id NOT IN (SELECT * FROM gone)
        UNION ALL SELECT 'recipe_ingredients', count(*) FROM recipe_ingredients WHERE recipe_id NOT IN (SELECT * FROM gone)
        UNION ALL SELECT 'recipe_tags', count(*) FROM recipe_tags WHERE recipe_id NOT IN (SELECT * FROM gone)
        UNION ALL SELECT 'user_feedback', count(*) FROM user_feedback WHERE recipe_id NOT IN (SELECT * FROM gone)""",
    "recipe_units": f"WITH {_UNITS} SELECT * FROM units",
    "recipe_chunks": f"""WITH RECURSIVE {_UNITS}, o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS n FROM units),
        f AS (SELECT id, n, 0 AS chunk, unit_type, step AS step_start, step AS step_end, text FROM o WHERE n = 1
              UNION ALL SELECT id, n, chunk + CAST(NOT fits AS INT), unit_type, CASE WHEN fits THEN step_start ELSE step END, CASE WHEN fits THEN coalesce(step, step_end) ELSE step END,
                               CASE WHEN fits THEN before || chr(10) || chr(10) || text ELSE text END
              FROM (SELECT o.*, f.chunk, f.step_start, f.step_end, f.text AS before, o.unit_type = f.unit_type AND length(f.text) + length(o.text) <= 500 AS fits FROM f JOIN o ON o.id = f.id AND o.n = f.n + 1))
        SELECT id, chunk, arg_max(unit_type, n) AS unit_type, arg_max_null(step_start, n) AS step_start, arg_max_null(step_end, n) AS step_end, arg_max(text, n) AS text FROM f GROUP BY 1, 2""",
    "recipe_documents": f"WITH {_UNITS} SELECT id, string_agg(text, chr(10) || chr(10) ORDER BY seq) AS text FROM units GROUP BY 1",
    "split_instructions": f"""WITH s AS (SELECT id, i - 1 AS pos, regexp_replace({_SPACED}, '{Q._STRIP}', '', 'g') AS t FROM (SELECT id, unnest(range(1, len(steps) + 1)) AS i, steps FROM recipes)),
        m AS (SELECT id, pos, regexp_replace(regexp_replace(t, '{_NUMBERED}', '\\1,\\2', 'g'), '{_NUMBERED}', '\\1,\\2', 'g') AS t FROM s),
        p AS (SELECT id, pos, list_filter(list_transform(regexp_split_to_array(t, '[{X.STEP_COMMAS}]'), lambda x: regexp_replace(regexp_replace(x, '^[\\s\\x0B]*[0-9]+[{X.STEP_MARKS}]', ''), '{Q._STRIP}', '', 'g')), lambda x: x <> '') AS ps FROM m)
        SELECT id, pos, j - 1 AS part, ps[j] AS text FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS j FROM p)""",
    "latest_failures": f"""WITH {_STATUS} SELECT source_url AS url, 'parse' AS stage, arg_max(reason, envelope_id) AS error, max(envelope_id) AS pos FROM judged
        WHERE source_url IS NOT NULL AND reason IS NOT NULL AND source_url NOT IN (SELECT source_url FROM judged WHERE reason IS NULL AND source_url IS NOT NULL) GROUP BY 1""",
    "circuit_breaks": """WITH m AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS good FROM events)
        SELECT user_id AS stream, min(event_id) AS start, count(*) AS length FROM m WHERE event_type = 'error' GROUP BY user_id, good HAVING count(*) >= 3""",
    "url_parts": r"""SELECT id, nullif(regexp_extract(source_url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+[^?#]*)', 1), '') AS url,
        nullif(lower(regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host, sha256(coalesce(source_url, '')) AS hash FROM recipes""",
    "robots_allowed": r"""WITH u AS (SELECT DISTINCT source_url AS url, CASE WHEN regexp_extract(source_url, '^[a-zA-Z]+://[^/]*(/.*)?$', 1) = '' THEN '/' ELSE regexp_extract(source_url, '^[a-zA-Z]+://[^/]*(/.*)?$', 1) END AS path
          FROM recipes WHERE source_url IS NOT NULL),
        rules(regex, allow, len) AS (VALUES ('^/recipe/', TRUE, 8), ('^/recipe/.*/\?from=', FALSE, 16), ('^/', FALSE, 1), ('^/recipe/1.*$', FALSE, 11))
        SELECT url, coalesce(arg_max(allow, (len, allow)), TRUE) AS allowed FROM u LEFT JOIN rules ON regexp_matches(path, regex) GROUP BY 1""",
    "feedback_distinct": f"WITH {_DISTINCT} SELECT * FROM feedback",
    "feedback_counts": f"WITH {_DISTINCT} SELECT * EXCLUDE (first) FROM counts",
    "feedback_top5": f"WITH {_DISTINCT} SELECT * EXCLUDE (first) FROM counts ORDER BY total DESC, first LIMIT 5",
    "feedback_export": f"""WITH {_DISTINCT} SELECT 0 AS line_no, '{{"_meta":{{"exported_at":"2026-01-01T00:00:00+00:00","count":' || count(*) || ',"like":' || count(*) FILTER (WHERE action = 'like') || ',"dislike":' || count(*) FILTER (WHERE action = 'dislike')
            || ',"recipes":' || (SELECT count(*) FROM counts) || '}}}}' AS line FROM feedback
        UNION ALL SELECT id, '{{"id":' || id || ',"recipe_id":' || coalesce(CAST(recipe_id AS VARCHAR), 'null') || ',"action":"' || action || '","created_at":' || coalesce(strftime(created_at, '"%Y-%m-%dT%H:%M:%S"'), 'null') || '}}' FROM feedback""",
    "accept_feedback": f"""WITH f AS (SELECT id, recipe_id, client_fingerprint, lower(trim(action)) AS action, created_at FROM user_feedback WHERE recipe_id IS NOT NULL AND client_fingerprint IS NOT NULL),
        old AS (SELECT recipe_id, client_fingerprint, action, min(id) AS old_id FROM f WHERE created_at < TIMESTAMP '2025-01-01' GROUP BY 1, 2, 3),
        new AS (SELECT DISTINCT id, recipe_id, client_fingerprint, action FROM f WHERE created_at >= TIMESTAMP '2025-01-01'),
        j AS (SELECT new.*, old_id, recipe_id IN (SELECT id FROM recipes) AS real, min(id) OVER (PARTITION BY recipe_id, client_fingerprint, action) = id AS first FROM new LEFT JOIN old USING (recipe_id, client_fingerprint, action))
        SELECT id AS request_id, CASE WHEN NOT real THEN 'no recipe' WHEN old_id IS NOT NULL THEN 'known' WHEN first THEN 'new' ELSE 'repeated' END AS status, CASE WHEN real THEN old_id END AS id FROM j""",
    "fingerprints": "SELECT event_id, sha256(CAST(user_id AS VARCHAR) || 'pepper') AS fingerprint FROM events",
    "rate_limit": """SELECT client, request_id, window_start, n FROM (SELECT user_id AS client, event_id AS request_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start,
        row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL 1 HOUR, ts) ORDER BY ts, event_id) AS n FROM events) WHERE n > 2""",
    "latency_p95": """SELECT kind, n, p95, round(mean, 6) AS mean FROM (SELECT event_type AS kind, value AS p95, row_number() OVER (PARTITION BY event_type ORDER BY value) AS place,
        count(*) OVER (PARTITION BY event_type) AS n, avg(value) OVER (PARTITION BY event_type) AS mean FROM events) WHERE place = greatest(1, CAST(floor(n * 0.95) AS INT))""",
}
