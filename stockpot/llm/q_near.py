"""Queries on near copies and on items that appear together."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import inputs_fingerprint
from ..runtime import bounded_broadcast, own_dir, table, written
from .near_copies import group_pairs, near_copy_groups
from .pairs import PairStore, pair_counts, scores, update, updated_counts


def recipe_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text) of the recipes with steps: title, description, instructions, without white space."""
    r = table(spark, sf_dir, "recipes").select("id", "title", "description", "steps").where("size(steps) > 0")
    steps = F.array_join(F.transform("steps", lambda s: F.coalesce(s["instruction"], F.lit(""))), "")
    text = F.concat(F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")), steps)
    return r.select("id", F.regexp_replace(text, r"[\s\p{Z}\x{85}\x{1C}-\x{1F}]+", "").alias("text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_pairs(near_copy_groups(recipe_texts(spark, sf_dir), 0.6, 3, count_links=False)).distinct()


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each recipe with a partner: its group and its number of links."""
    return near_copy_groups(recipe_texts(spark, sf_dir), 0.6, 3)


def _pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores after two updates: what had come by the end of the last year but one, then the changes since.

    The first load has rows of unknown ingredients too; the second withdraws them and adds what came later, and only what
    this changes is counted anew. The store and the counts stay below the shared folder, so that a further query on the
    same tables starts from them.
    """
    known = table(spark, sf_dir, "ingredients").select(F.col("id").alias("item"))
    raw = table(spark, sf_dir, "recipe_ingredients").select(F.col("recipe_id").alias("basket"), F.col("ingredient_id").alias("item"), "ingested_at")
    mark = hashlib.md5(f"{sf_dir} {inputs_fingerprint(raw, known)}".encode()).hexdigest()
    store = PairStore(spark, f"{own_dir(spark)}/pair-store-{mark}", (dict(raw.dtypes)["basket"], dict(raw.dtypes)["item"]))
    kept = f"{store.path}/counts"
    try:
        return scores(spark.read.parquet(kept), store)
    except AnalysisException:
        pass
    last = raw.agg(F.trunc(F.max("ingested_at"), "year").alias("cut")).first().cut
    late = F.coalesce(F.col("ingested_at") >= F.lit(last), F.lit(False))
    update(store, raw.where(~late))
    first = written(pair_counts(store), "first-counts")
    known = bounded_broadcast(known, 10_000)
    changes = update(store, raw.where(late).join(known, "item", "left_semi"), raw.join(known, "item", "left_anti"))
    updated_counts(first, store, changes).write.mode("overwrite").parquet(kept)
    return scores(spark.read.parquet(kept), store)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _pair_scores(spark, sf_dir)
    often = s.where("n_ab >= 4 and n_ab * 100 >= n and n_ab * n >= 4 * n_a * n_b")
    return often.select(F.col("a").alias("ingredient_a"), F.col("b").alias("ingredient_b")).distinct()


def p4_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair with its counts and lift."""
    s = _pair_scores(spark, sf_dir)
    return s.select(F.col("a").alias("ingredient_a"), F.col("b").alias("ingredient_b"), "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"))


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups, "p4_found": p4_found, "p4_scores": p4_scores}
_COUNTS = """
    WITH used AS (SELECT DISTINCT recipe_id, ingredient_id FROM recipe_ingredients
                  WHERE recipe_id IS NOT NULL AND ingredient_id IN (SELECT id FROM ingredients)),
    item AS (SELECT ingredient_id, count(*) AS c FROM used GROUP BY 1),
    pair AS (SELECT x.ingredient_id AS ingredient_a, y.ingredient_id AS ingredient_b, count(*) AS n_ab
             FROM used x JOIN used y ON x.recipe_id = y.recipe_id AND x.ingredient_id < y.ingredient_id GROUP BY 1, 2),
    counted AS (SELECT ingredient_a, ingredient_b, n_ab, a.c AS n_a, b.c AS n_b, (SELECT count(DISTINCT recipe_id) FROM used) AS n
                FROM pair JOIN item a ON a.ingredient_id = ingredient_a JOIN item b ON b.ingredient_id = ingredient_b)"""
_WHITE = r"[\s\x0B\p{Z}\x{85}\x{1C}-\x{1F}]+"
_GROUPS = f"""
    texts AS (SELECT id, regexp_replace(concat(title, description, array_to_string(list_transform(steps, lambda s: coalesce(s.instruction, '')), '')), '{_WHITE}', '', 'g') AS t
              FROM recipes WHERE len(steps) > 0),
    classes AS (SELECT t, min(id) AS rep, count(*) AS copies FROM texts WHERE t <> '' GROUP BY 1),
    grams AS (SELECT DISTINCT rep, unnest(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3))) AS g FROM classes),
    sizes AS (SELECT rep, count(*) AS n FROM grams GROUP BY 1),
    shared AS (SELECT x.rep AS a, y.rep AS b, count(*) AS s FROM grams x JOIN grams y ON x.g = y.g AND x.rep < y.rep GROUP BY 1, 2),
    links AS (SELECT a, b FROM shared JOIN sizes x ON x.rep = a JOIN sizes y ON y.rep = b WHERE s * 10 >= 6 * greatest(x.n, y.n)),
    ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT a, b FROM ends UNION SELECT r.a, e.b FROM reach r JOIN ends e ON e.a = r.b),
    comps AS (SELECT a AS rep, least(a, min(b)) AS component FROM reach GROUP BY 1),
    degrees AS (SELECT a AS rep, count(*) AS links FROM ends GROUP BY 1),
    groups AS (SELECT id, coalesce(component, c.rep) AS component, coalesce(links, 0) AS links
               FROM texts JOIN classes c USING (t) LEFT JOIN comps ON comps.rep = c.rep LEFT JOIN degrees ON degrees.rep = c.rep WHERE component IS NOT NULL OR copies > 1)"""
SQL: dict[str, str] = {
    "p1_found": f"WITH RECURSIVE {_GROUPS} SELECT x.id AS id_a, y.id AS id_b FROM groups x JOIN groups y ON x.component = y.component AND x.id < y.id",
    "p1_groups": f"WITH RECURSIVE {_GROUPS} SELECT * FROM groups",
    "p4_found": _COUNTS + " SELECT ingredient_a, ingredient_b FROM counted WHERE n_ab >= 4 AND n_ab * 100 >= n AND n_ab * n >= 4 * n_a * n_b",
    "p4_scores": _COUNTS + " SELECT *, round(CAST(n_ab * n AS DOUBLE) / (n_a * n_b), 6) AS lift FROM counted",
}
