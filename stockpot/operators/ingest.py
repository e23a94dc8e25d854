"""From envelopes and pages to tables: validation, idempotent loads, merges, chunks, upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, strip
from ..runtime import bounded_broadcast, small_enough, written

SENTENCE = r"(?<=[。！？!?；;\n])"


def envelope_status(bodies: DataFrame) -> DataFrame:
    """(envelope_id, status, reason) of JSON envelopes: an object of version 1 with a recipe object that has a title.

    ``reason`` names the first fault; a null body has none to parse.
    """
    v = F.try_parse_json("body")
    kind = lambda c: F.coalesce(F.schema_of_variant(c), F.lit("VOID"))
    parsed = bodies.select("envelope_id", "body", v.alias("v"))
    recipe = F.try_variant_get("v", "$.recipe", "variant")
    checked = parsed.withColumn("kind", kind(F.col("v"))).withColumn("recipe_kind", kind(recipe))
    reason = (
        F.when(F.col("body").isNull(), "null")
        .when(F.col("v").isNull(), "unreadable")
        .when(~F.col("kind").startswith("OBJECT"), "not an object")
        .when(F.coalesce(F.try_variant_get("v", "$.schema_version", "int"), F.lit(-1)) != 1, "version")
        .when(~F.col("recipe_kind").startswith("OBJECT"), "no recipe")
        .when(F.coalesce(F.try_variant_get("v", "$.recipe.title", "string"), F.lit("")) == "", "no title")
    )
    return checked.select("envelope_id", F.when(reason.isNull(), "valid").otherwise("invalid").alias("status"), reason.alias("reason"))


def insert_new(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of ``incoming`` whose ``key`` isn't there yet, the first of each key."""
    first = Window.partitionBy(key).orderBy(order)
    fresh = incoming.join(existing.select(key).distinct(), key, "left_anti")
    return fresh.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def get_or_create(dimension: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name) of all distinct ``names``: known ones keep their id, new ones follow the greatest.

    New names are numbered in order of the first two digits of their md5 and the name: each of the 256 parts is
    numbered by itself from where the part before ends, so no task sorts all names.
    """
    new = names.select("name").where("name <> ''").distinct().join(dimension.select("name"), "name", "left_anti")
    new = new.withColumn("part", F.left(F.md5("name"), F.lit(2)))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # at most 256 rows
    starts = new.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    top_id = dimension.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    numbered = new.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("name"))).join(F.broadcast(starts), "part").crossJoin(F.broadcast(top_id))
    known = dimension.select("id", "name").join(names.select("name").distinct(), "name", "left_semi")
    return known.select("id", "name").unionByName(numbered.select((F.col("top") + F.col("start") + F.col("n")).cast("long").alias("id"), "name"))


def upsert_changes(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change) with created, updated, unchanged or kept, by comparing ``columns`` null-safely."""
    o = old.select(F.col(key), F.struct(*columns).alias("__o"))
    n = new.select(F.col(key), F.struct(*columns).alias("__n"))
    both = o.join(n, key, "full_outer")
    change = F.when(F.col("__o").isNull(), "created").when(F.col("__n").isNull(), "kept").when(F.col("__o").eqNullSafe(F.col("__n")), "unchanged").otherwise("updated")
    return both.select(key, change.alias("change"))


def merge_amounts(rows: DataFrame) -> DataFrame:
    """One row for each (recipe, name) of (recipe, name, amount, is_essential, category, pos): amounts joined in order, the
    first flag kept, a category from any of the rows; blank names are left out."""
    tidy = rows.withColumn("name", clean_text("name")).where("name <> ''")
    amounts = F.filter(F.transform(F.sort_array(F.collect_list(F.struct("pos", "amount"))), lambda x: strip(x["amount"])), lambda a: a.isNotNull() & (a != ""))
    return tidy.groupBy("recipe", "name").agg(
        F.array_join(amounts, "、").alias("amount"), F.min_by("is_essential", "pos").alias("is_essential"), F.max("category").alias("category"), F.min("pos").alias("pos")
    )


def split_seasonings(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """(recipe, section, name, amount, is_essential, pos) of (recipe, name, amount, is_essential, pos).

    Names that mean a seasoning (see :func:`classify_by_alias`) become one row for each recipe and canonical name, amounts
    joined in order, not essential, at the place of the first; all others stay as they are, as ingredients.
    """
    known = written(classify_by_alias(rows.select("name"), aliases).where("canonical is not null"), "seasonings")
    marked = rows.join(bounded_broadcast(known), "name", "left")
    amounts = F.filter(F.transform(F.sort_array(F.collect_list(F.struct("pos", "amount"))), lambda x: x["amount"]), lambda a: a.isNotNull() & (a != ""))
    merged = marked.where("canonical is not null").groupBy("recipe", F.col("canonical").alias("name")).agg(F.nullif(F.array_join(amounts, "、"), F.lit("")).alias("amount"), F.min("pos").alias("pos"))
    seasonings = merged.select("recipe", F.lit("seasonings").alias("section"), "name", "amount", F.lit(False).alias("is_essential"), "pos")
    return seasonings.unionByName(marked.where("canonical is null").select("recipe", F.lit("ingredients").alias("section"), "name", "amount", "is_essential", "pos"))


def load_outcomes(statuses: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """(envelope_id, outcome) of judged envelopes (envelope_id, source_url, status): saved, skipped or invalid.

    Valid ones whose address is stored (source_url of ``existing``) or was saved by a lesser envelope_id are skipped; with
    ``force`` stored addresses are saved anew. An envelope without an address can't be told from others and is saved.
    """
    first = statuses.where("status = 'valid'").groupBy("source_url").agg(F.min("envelope_id").alias("first"))
    there = existing.select("source_url").distinct().withColumn("__there", F.lit(not force))
    joined = statuses.join(first, "source_url", "left").join(there, "source_url", "left")
    again = F.col("source_url").isNotNull() & (F.coalesce("__there", F.lit(False)) | (F.col("first") < F.col("envelope_id")))
    return joined.select("envelope_id", F.when(F.col("status") != "valid", "invalid").when(again, "skipped").otherwise("saved").alias("outcome"))


def load_summary(outcomes: DataFrame, statuses: DataFrame | None = None, limit: int = 5) -> DataFrame:
    """(seen, saved, skipped, invalid, failed, exit_code) of (outcome): 3 after ``limit`` failures on end (``statuses``, see
    :func:`circuit_breaks`), else 1 if any failed, else 0."""
    of = lambda x: F.count_if(F.col("outcome") == x).alias(x)
    counts = outcomes.agg(F.count(F.lit(1)).alias("seen"), of("saved"), of("skipped"), of("invalid"), of("failed"))
    broken = F.lit(0).cast("long").alias("breaks")
    counts = counts.select("*", broken) if statuses is None else counts.crossJoin(circuit_breaks(statuses, limit).agg(F.count(F.lit(1)).alias("breaks")))
    return counts.select("seen", "saved", "skipped", "invalid", "failed", F.when(F.col("breaks") > 0, 3).when(F.col("failed") > 0, 1).otherwise(0).alias("exit_code"))


def classify_by_alias(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, canonical) by ``aliases`` (alias, canonical): the equal alias, else the longest that begins or ends the name."""
    tidy = names.select("name", clean_text("name").alias("n")).where("n <> ''").distinct()
    # the beginnings and endings of a name that are no longer than the longest alias meet the aliases by equality
    longest = F.broadcast(aliases.agg(F.coalesce(F.max(F.length("alias")), F.lit(0)).alias("longest")))
    sizes = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length("n"), F.col("longest"))))
    ends = F.array_distinct(F.concat(F.transform(sizes, lambda i: F.left("n", i)), F.transform(sizes, lambda i: F.right("n", i))))
    hit = tidy.crossJoin(longest).select("name", F.explode(ends).alias("alias")).join(bounded_broadcast(aliases), "alias")
    best = hit.groupBy("name").agg(F.max_by("canonical", F.struct(F.length("alias"), "alias")).alias("canonical"))
    return tidy.select("name").join(best, "name", "left")


def delete_recipes(ids: DataFrame, recipes: DataFrame, bridge: DataFrame, recipe_tags: DataFrame, feedback: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four tables after the recipes in ``ids`` (id) are gone: bridges lose their rows, feedback only its reference."""
    gone = ids.select(F.col("id").alias("recipe_id")).distinct()
    marked = feedback.join(gone.withColumn("__gone", F.lit(True)), "recipe_id", "left")
    kept = marked.withColumn("recipe_id", F.when(F.col("__gone").isNull(), F.col("recipe_id"))).select(feedback.columns)
    return (
        recipes.join(ids.select("id").distinct(), "id", "left_anti"),
        bridge.join(gone, "recipe_id", "left_anti"),
        recipe_tags.join(gone, "recipe_id", "left_anti"),
        kept,
    )


def item_lines(items: DataFrame) -> DataFrame:
    """(id, line): the items (id, section, pos, name, amount) of each recipe in one line, ingredients before seasonings.

    Blank names are left out; a blank amount leaves the name alone.
    """
    tidy = items.select("id", "section", "pos", clean_text("name").alias("name"), strip("amount").alias("amount")).where("name <> ''")
    text = F.concat_ws("：", "name", F.nullif(F.col("amount"), F.lit("")))
    # the sections' names are in the order wanted
    lines = tidy.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section", "pos", text.alias("t")))), lambda x: x["t"]), "；").alias("t"))
    return lines.select("id", F.concat(F.lit("用料："), "t").alias("line"))


def recipe_units(recipes: DataFrame, items: DataFrame) -> DataFrame:
    """(id, seq, unit_type, step, text): header, line of items (see :func:`item_lines`), and each step that has text.

    Step numbers count steps without text as well. Recipes without any text have no unit.
    """
    head = F.concat_ws("\n\n", F.nullif(clean_text("title"), F.lit("")), F.nullif(clean_text("description"), F.lit("")))
    none = F.lit(None).cast("int").alias("step")
    headers = recipes.select("id", F.lit(0).alias("seq"), F.lit("header").alias("unit_type"), none, head.alias("text"))
    used = item_lines(items).select("id", F.lit(1).alias("seq"), F.lit("ingredients").alias("unit_type"), none, F.col("line").alias("text"))
    steps = recipes.select("id", F.posexplode("steps").alias("p", "s")).select("id", (F.col("p") + 1).alias("step"), clean_text("s.instruction").alias("t")).where("t <> ''")
    told = F.concat(F.lit("步骤"), F.col("step").cast("string"), F.lit("："), "t")
    steps = steps.select("id", (F.col("step") + 1).alias("seq"), F.lit("steps").alias("unit_type"), "step", told.alias("text"))
    return headers.unionByName(used).unionByName(steps).where("text <> ''")


def recipe_documents(units: DataFrame) -> DataFrame:
    """(id, text): the units of each recipe in order, with an empty line between them."""
    lists = units.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("us"))
    return lists.select("id", F.array_join(F.transform("us", lambda u: u["text"]), "\n\n").alias("text"))


def split_unit(text: Column, size: int) -> Column:
    """Parts of a long unit: whole sentences packed up to ``size`` characters, longer ones cut hard."""
    parts = F.filter(F.transform(F.split(text, SENTENCE), strip), lambda p: p != "")
    hard = F.flatten(
        F.transform(
            parts,
            lambda p: F.when(F.length(p) <= size, F.array(F.struct(p.alias("t"), F.lit(False).alias("cut")))).otherwise(
                F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / size).cast("int")), lambda i: F.struct(F.substring(p, i * size + 1, F.lit(size)).alias("t"), F.lit(True).alias("cut")))
            ),
        )
    )
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def add(acc: Column, p: Column) -> Column:
        flushed = F.when(acc["buf"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["buf"])))
        fits = F.length(acc["buf"]) + F.length(p["t"]) <= size
        out = F.when(p["cut"], F.concat(flushed, F.array(p["t"]))).when(fits, acc["out"]).otherwise(flushed)
        buf = F.when(p["cut"], F.lit("")).when(fits, F.concat(acc["buf"], p["t"])).otherwise(p["t"])
        return F.struct(out.alias("out"), buf.alias("buf"))

    return F.aggregate(hard, empty, add, lambda acc: F.when(acc["buf"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["buf"]))))


def chunk_units(units: DataFrame, size: int = 500) -> DataFrame:
    """(id, chunk, unit_type, step_start, step_end, text): neighbouring units of one type joined up to ``size`` characters.

    The two line ends between them aren't counted, so a chunk may be a little longer. Units longer than ``size`` are
    split first. The fold runs over the units of one recipe, which are few.
    """
    piece = F.when(F.length("text") <= size, F.array("text")).otherwise(split_unit(F.col("text"), size))
    pieces = units.select("id", "seq", "unit_type", "step", F.posexplode(piece).alias("sub", "text"))
    lists = pieces.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("seq", "sub", "unit_type", "step", "text"))).alias("us"))
    one = "struct<unit_type:string,step_start:int,step_end:int,text:string>"
    start = F.array().cast(f"array<{one}>")

    def fold(acc: Column, u: Column) -> Column:
        last = F.element_at(acc, -1)
        new = F.struct(u["unit_type"].alias("unit_type"), u["step"].cast("int").alias("step_start"), u["step"].cast("int").alias("step_end"), u["text"].alias("text")).cast(one)
        joined = F.struct(last["unit_type"].alias("unit_type"), last["step_start"].alias("step_start"), F.coalesce(u["step"].cast("int"), last["step_end"]).alias("step_end"), F.concat(last["text"], F.lit("\n\n"), u["text"]).alias("text")).cast(one)
        fits = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["unit_type"] == u["unit_type"]) & (F.length(F.try_element_at(acc, F.lit(-1))["text"]) + F.length(u["text"]) <= size)
        return F.when(fits, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(new)))

    return lists.select("id", F.posexplode(F.aggregate("us", start, fold)).alias("chunk", "c")).select("id", "chunk", "c.*")


def latest_failures(failures: DataFrame, resolved: DataFrame) -> DataFrame:
    """The last record of each (url, stage) of (url, stage, pos, error) that isn't in ``resolved`` (url, stage)."""
    last = failures.groupBy("url", "stage").agg(F.max_by("error", "pos").alias("error"), F.max("pos").alias("pos"))
    return last.join(resolved.select("url", "stage").distinct(), ["url", "stage"], "left_anti")


def circuit_breaks(statuses: DataFrame, limit: int = 5) -> DataFrame:
    """(stream, start, length): runs of at least ``limit`` failures on end of (stream, pos, failed).

    Rows are sorted by ranges of stream and place, so that a stream with much of the rows is spread over tasks.
    """
    ranges = statuses.select("stream", "pos", "failed").repartitionByRange("stream", "pos").withColumn("part", F.spark_partition_id())
    ranges = written(ranges, "status-ranges")
    good = F.sum(F.when(F.col("failed"), 0).otherwise(1))
    # a row for each stream and range: how many successes come before the range
    earlier = Window.partitionBy("stream").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.groupBy("stream", "part").agg(good.alias("n")).select("stream", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    marked = ranges.withColumn("good", good.over(Window.partitionBy("stream", "part").orderBy("pos"))).where("failed")
    # failures between the same two successes are one run, over the ends of ranges as well
    partly = marked.groupBy("stream", "part", "good").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("length"))
    runs = partly.join(before, ["stream", "part"]).groupBy("stream", (F.col("before") + F.col("good")).alias("good")).agg(F.min("start").alias("start"), F.sum("length").alias("length"))
    return runs.where(F.col("length") >= limit).select("stream", "start", "length")


def allowed_by_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, allowed) by robots rules (pattern, allow): the longest matching pattern counts, allow before disallow."""
    regex = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace("pattern", r"([.+?^{}()|\[\]\\])", r"\\$1"), r"\*", ".*"), r"\$(?!$)", r"\\$"))
    if not small_enough(rules, 10_000):
        raise ValueError("the rules of a site are at most 10,000")
    ruled = F.broadcast(rules.select(regex.alias("regex"), "allow", F.length("pattern").alias("len")))
    path = F.regexp_extract("url", r"^[a-zA-Z]+://[^/]*(/.*)?$", 1)
    asked = urls.select("url", F.when(path == "", "/").otherwise(path).alias("path")).distinct()
    hit = asked.join(ruled, F.expr("path rlike regex"), "left")
    return hit.groupBy("url").agg(F.coalesce(F.max_by("allow", F.struct("len", "allow")), F.lit(True)).alias("allowed"))
