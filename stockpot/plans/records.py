"""Queries on nested, referencing and measured records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.flatten import Child, emit_tagged, read_tagged, write_tagged
from ..operators.quantities import measures, read_quantities
from ..operators.references import Reference, orphan_cascade, parent_states
from ..operators.unit_states import decode_units
from ..runtime import table, written

ENVELOPE_LISTS = (
    Child("ingredients", "name", (Child("items", "name"),)),
    Child("seasonings", "name", (Child("items", "name"),)),
    Child("steps", "instruction", (Child("substeps", "instruction"),)),
    Child("tags", "name", (Child("items", "name"),)),
)


def _tagged_envelopes(spark: SparkSession, sf_dir: str) -> str:
    bodies = table(spark, sf_dir, "crawled_recipes").select("envelope_id", "body")
    return write_tagged(emit_tagged(bodies, "envelope_id", "body", "recipe", ENVELOPE_LISTS), "envelopes")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_tagged(spark, _tagged_envelopes(spark, sf_dir))
    # white space in the Unicode sense only is blank
    text = rows.where(r"text is not null and not text rlike '^[\\s\\p{Z}\\x{85}\\x{1C}-\\x{1F}]*$'")
    nested = F.instr("tag", ".") > 0
    return text.select(
        F.col("doc_key").alias("envelope_id"),
        F.substring_index("tag", ".", 1).alias("section"),
        F.when(nested, F.col("parent_pos")).otherwise(F.col("pos")).alias("pos"),
        F.when(nested, F.col("pos")).otherwise(F.lit(0).cast("long")).alias("sub_pos"),
        F.col("text").alias("item_text"),
    ).distinct()


def _references(spark: SparkSession, sf_dir: str) -> tuple[Reference, Reference]:
    """Feedback to recipes and the bridge to the dictionary; a pair loaded twice counts from its first load."""
    feedback = table(spark, sf_dir, "user_feedback").select(F.col("id").alias("row_id"), F.col("recipe_id").alias("ref_id"), F.col("created_at").alias("ref_time"))
    used = (
        table(spark, sf_dir, "recipe_ingredients")
        .groupBy(F.col("recipe_id").alias("row_id"), F.col("ingredient_id").alias("ref_id"))
        .agg(F.min("ingested_at").alias("ref_time"))
    )
    recipes = parent_states(table(spark, sf_dir, "recipes"), "id", "created_at", table(spark, sf_dir, "recipe_deletions"), "recipe_id")
    ingredients = parent_states(table(spark, sf_dir, "ingredients"), "id", "created_at")
    return Reference("user_feedback", feedback, "recipes", recipes), Reference("recipe_ingredients", used, "ingredients", ingredients)


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orphans of the graph of the given tables: the bridge refers to the dictionary; a recipe is whole only with its
    bridge rows; feedback and documents refer to recipes. So a missing entry makes a recipe and what is said of it orphans.
    """
    feedback, used = _references(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.col("recipe_id").alias("ref_id"), F.col("crawled_at").alias("ref_time"))
    whole = table(spark, sf_dir, "recipes").select(F.col("id").alias("row_id"), F.col("id").alias("ref_id"), F.col("created_at").alias("ref_time"))
    return orphan_cascade([feedback, used, Reference("documents", docs, "recipes", feedback.states), Reference("recipes", whole, "recipe_ingredients", None)])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    faults = _orphans(spark, sf_dir).where("cause = 'direct' AND source_table IN ('user_feedback', 'recipe_ingredients')")
    return faults.select("source_table", "row_id", "ref_id", F.date_format("ref_time", "yyyy-MM").alias("ref_month"), "reason").distinct()


def p7_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct and inherited orphans with the round that found them."""
    return _orphans(spark, sf_dir).where("reason <> 'late'").select("source_table", "row_id", "ref_id", "cause", "depth").distinct()


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orphans each table has by month, reason and depth."""
    out = _orphans(spark, sf_dir).groupBy("source_table", F.date_format("ref_time", "yyyy-MM").alias("ref_month"), "reason", "depth").agg(F.count(F.lit(1)).alias("n"))
    return out.select("source_table", "ref_month", "reason", "depth", "n")


def _amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridge pairs and crawled items with what their amounts state."""
    units = measures(spark, table(spark, sf_dir, "measure_units"))
    used = table(spark, sf_dir, "recipe_ingredients").select(
        F.lit("recipe_ingredients").alias("source_table"), F.col("recipe_id").alias("row_id"), F.col("ingredient_id").alias("ref_id"), "amount"
    )
    crawled = table(spark, sf_dir, "crawled_ingredients").select(
        F.lit("crawled_ingredients").alias("source_table"), F.col("item_id").alias("row_id"), F.lit(0).cast("long").alias("ref_id"), "amount", "name"
    )
    rows = used.withColumn("name", F.lit(None).cast("string")).unionByName(crawled).where("amount is not null and amount <> ''")
    return read_quantities(rows, "amount", units, "name")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = _amounts(spark, sf_dir).where("base_unit is not null")
    return stated.select("source_table", "row_id", "ref_id", "base_unit", "quantity_milli").distinct()


def _readings(spark: SparkSession, sf_dir: str, units: list) -> DataFrame:
    """(device, period, seq, value, unit): the amounts of both tables that are a quantity or a bare number.

    A device is what is measured: a crawled name, or an entry of the dictionary. A reading that states a quantity enters
    with its own unit, in that unit.
    """
    crawled = table(spark, sf_dir, "crawled_ingredients").where("name <> ''").select(
        F.lower("name").alias("device"), F.col("crawled_at").alias("at"), F.lit("crawled_ingredients").alias("source_table"), F.col("item_id").alias("row_id"), F.lit(0).cast("long").alias("ref_id"), "amount", "name"
    )
    used = table(spark, sf_dir, "recipe_ingredients").where("ingredient_id is not null").groupBy("recipe_id", "ingredient_id", "amount").agg(F.min("ingested_at").alias("at"))
    used = used.select(
        F.concat(F.lit("#"), F.col("ingredient_id").cast("string")).alias("device"), "at", F.lit("recipe_ingredients").alias("source_table"), F.col("recipe_id").alias("row_id"), F.col("ingredient_id").alias("ref_id"), "amount", F.lit(None).cast("string").alias("name")
    )
    rows = crawled.unionByName(used).where("amount <> ''").distinct()
    read = read_quantities(rows, "amount", units, "name", coded=True).where("base_unit is not null or bare is not null")
    milli = F.create_map(*[F.lit(x) for code, _, factor, _ in units for x in (code, float(factor))])
    return read.select(
        "device",
        (F.year("at") * 12 + F.month("at")).alias("period"),
        F.struct("at", "source_table", "row_id", "ref_id", "amount").alias("seq"),
        F.when(F.col("unit_code").isNull(), F.col("bare")).otherwise(F.col("quantity_milli") / milli[F.col("unit_code")]).alias("value"),
        F.col("unit_code").alias("unit"),
    )


def _decoded(readings: DataFrame, units: list) -> DataFrame:
    return decode_units(readings, {code: factor / 1000 for code, _, factor, _ in units}, bases={code: base for code, base, _, _ in units})


def p5_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare numbers of both tables with the unit that is likeliest for them; every unit of the table of measures is a state."""
    units = measures(spark, table(spark, sf_dir, "measure_units"))
    out = _decoded(_readings(spark, sf_dir, units), units).where("unit is null and decoded is not null")
    return out.select("seq.source_table", "seq.row_id", "seq.ref_id", "device", "value", "decoded")


def p5_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the model finds a unit that was stated and hidden from it, one in five by a hash of the reading.

    For each table: the readings hidden, those of which the unit came out, and those of which the base unit did.
    """
    units = measures(spark, table(spark, sf_dir, "measure_units"))
    told = _readings(spark, sf_dir, units)
    hide = F.pmod(F.xxhash64("seq.source_table", "seq.row_id", "seq.ref_id", "seq.amount"), F.lit(5)) == 0
    told = written(told.withColumn("truth", F.when(hide, F.col("unit"))), "readings")
    out = _decoded(told.select("device", "period", "seq", "value", F.when(F.col("truth").isNull(), F.col("unit")).alias("unit")), units)
    base = F.create_map(*[F.lit(x) for code, unit, _, _ in units for x in (code, unit)])
    both = told.where("truth is not null").select("device", "period", "seq", "truth").join(out.select("device", "period", "seq", "decoded"), ["device", "period", "seq"])
    return both.groupBy(F.col("seq.source_table").alias("source_table")).agg(
        F.count(F.lit(1)).alias("hidden"), F.count_if(F.col("decoded") == F.col("truth")).alias("same_unit"), F.count_if(base[F.col("decoded")] == base[F.col("truth")]).alias("same_base")
    )


QUERIES = {"p5_found": p5_found, "p5_units": p5_units, "p5_accuracy": p5_accuracy, "p6_found": p6_found, "p7_found": p7_found, "p7_cascade": p7_cascade, "p7_report": p7_report}
def _text_sql(x: str, label: str) -> str:
    inner = f"CASE WHEN json_type({x}, '$.{label}') = 'VARCHAR' THEN json_extract_string({x}, '$.{label}') END"
    return f"CASE json_type({x}) WHEN 'VARCHAR' THEN json_extract_string({x}, '$') WHEN 'OBJECT' THEN {inner} END"


def _section_sql(section: str, label: str, below: str) -> tuple[str, str]:
    """(CTE of the entries of a section, rows of the entries' own texts and of the parts below them)."""
    many = lambda x: f"CASE WHEN json_type({x}) = 'ARRAY' THEN CAST({x} AS JSON[]) ELSE [{x}] END"
    there = lambda x, name: f"coalesce(json_type({x}, '$.{name}'), 'NULL') <> 'NULL'"
    listed = many(f"json_extract(r, '$.{section}')")
    entries = f"{section}_e AS (SELECT envelope_id, unnest(xs) AS x, unnest(range(1, len(xs) + 1)) AS pos FROM (SELECT envelope_id, {listed} AS xs FROM whole WHERE {there('r', section)}))"
    parts = many(f"json_extract(x, '$.{below}')")
    rows = f"""SELECT envelope_id, '{section}' AS section, pos, 0 AS sub_pos, {_text_sql('x', label)} AS item_text FROM {section}_e
      UNION ALL SELECT envelope_id, '{section}', pos, sub_pos, {_text_sql('y', label)} FROM (
        SELECT envelope_id, pos, unnest(ys) AS y, unnest(range(1, len(ys) + 1)) AS sub_pos FROM (
          SELECT envelope_id, pos, {parts} AS ys FROM {section}_e WHERE json_type(x) = 'OBJECT' AND {there('x', below)}))"""
    return entries, rows


_SECTIONS = [_section_sql(*s) for s in (("ingredients", "name", "items"), ("seasonings", "name", "items"), ("steps", "instruction", "substeps"), ("tags", "name", "items"))]
_FLAT = f"""
    bodies AS (SELECT envelope_id, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS v FROM crawled_recipes),
    inner_ AS (SELECT envelope_id, CASE json_type(v, '$.recipe') WHEN 'OBJECT' THEN json_extract(v, '$.recipe')
               WHEN 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string(v, '$.recipe')) THEN CAST(json_extract_string(v, '$.recipe') AS JSON) END END AS r FROM bodies WHERE json_type(v) = 'OBJECT'),
    whole AS (SELECT * FROM inner_ WHERE json_type(r) = 'OBJECT'),
    {", ".join(e for e, _ in _SECTIONS)},
    flat AS ({" UNION ALL ".join(r for _, r in _SECTIONS)})"""
_CASCADE = """
    refs AS (
      SELECT 'user_feedback' AS source_table, id AS row_id, recipe_id AS ref_id, created_at AS t, 'recipes' AS parent FROM user_feedback
      UNION SELECT 'documents', doc_id, recipe_id, crawled_at, 'recipes' FROM documents
      UNION SELECT 'recipe_ingredients', recipe_id, ingredient_id, min(ingested_at), 'ingredients' FROM recipe_ingredients GROUP BY ALL),
    known AS (SELECT 'recipes' AS parent, id AS ref_id, created_at AS since FROM recipes UNION ALL SELECT 'ingredients', id, created_at FROM ingredients),
    direct AS (
      SELECT r.source_table, r.row_id, r.ref_id, t, CASE WHEN k.ref_id IS NULL AND r.parent = 'recipes' AND r.ref_id IN (SELECT recipe_id FROM recipe_deletions) THEN 'deleted'
             WHEN k.ref_id IS NULL THEN 'missing' WHEN since > t THEN 'late' END AS reason
      FROM refs r LEFT JOIN known k ON k.parent = r.parent AND k.ref_id = r.ref_id WHERE r.ref_id IS NOT NULL),
    gone AS (SELECT * FROM direct WHERE reason IN ('deleted', 'missing')),
    broken AS (SELECT id, created_at FROM recipes WHERE id IN (SELECT row_id FROM gone WHERE source_table = 'recipe_ingredients')),
    orphans AS (
      SELECT source_table, row_id, ref_id, t, reason, 'direct' AS cause, 0 AS depth FROM direct WHERE reason IS NOT NULL
      UNION ALL SELECT 'recipes', id, id, created_at, 'inherited', 'inherited', 1 FROM broken
      UNION ALL SELECT DISTINCT source_table, row_id, ref_id, t, 'inherited', 'inherited', 2 FROM refs r WHERE parent = 'recipes' AND ref_id IN (SELECT id FROM broken)
        AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.source_table = r.source_table AND g.row_id = r.row_id))"""
SQL: dict[str, str] = {
    "p6_found": f"""WITH {_FLAT} SELECT DISTINCT envelope_id, section, pos, sub_pos, item_text FROM flat
        WHERE item_text IS NOT NULL AND NOT regexp_full_match(item_text, '[\\s\\x0B\\p{{Z}}\\x{{85}}\\x{{1C}}-\\x{{1F}}]*')""",
    "p7_found": """
        WITH refs AS (
          SELECT DISTINCT 'user_feedback' AS source_table, f.id AS row_id, f.recipe_id AS ref_id, f.created_at AS t,
                 r.created_at AS since, r.id IS NOT NULL AS present, d.recipe_id IS NOT NULL AS deleted
          FROM user_feedback f LEFT JOIN recipes r ON r.id = f.recipe_id
               LEFT JOIN (SELECT DISTINCT recipe_id FROM recipe_deletions) d ON d.recipe_id = f.recipe_id
          WHERE f.recipe_id IS NOT NULL
          UNION ALL
          SELECT 'recipe_ingredients', b.recipe_id, b.ingredient_id, b.t, i.created_at, i.id IS NOT NULL, FALSE
          FROM (SELECT recipe_id, ingredient_id, min(ingested_at) AS t FROM recipe_ingredients
                WHERE ingredient_id IS NOT NULL GROUP BY ALL) b LEFT JOIN ingredients i ON i.id = b.ingredient_id),
        judged AS (
          SELECT *, CASE WHEN NOT present AND deleted THEN 'deleted' WHEN NOT present THEN 'missing'
                         WHEN since > t THEN 'late' END AS reason FROM refs)
        SELECT DISTINCT source_table, row_id, ref_id, strftime(t, '%Y-%m') AS ref_month, reason
        FROM judged WHERE reason IS NOT NULL""",
    "p7_cascade": f"WITH {_CASCADE} SELECT * EXCLUDE (t, reason) FROM orphans WHERE reason <> 'late'",
    "p7_report": f"WITH {_CASCADE} SELECT source_table, strftime(t, '%Y-%m') AS ref_month, reason, depth, count(*) AS n FROM orphans GROUP BY ALL",
}
