"""Missing items, coverage, exclusion, ranking, and linking of free text to a dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CONTROLS, clean_text, csv_values, strip
from ..runtime import bounded_broadcast, written
from .search import nearest_entry

SEASONING = "调料"


def dictionary_terms(dictionary: DataFrame) -> DataFrame:
    """(term, id, tier): tier 1 for names and 2 for aliases; of equal terms of a tier the least id counts."""
    names = dictionary.where("name <> ''").select(F.col("name").alias("term"), "id", F.lit(1).alias("tier"))
    aliases = dictionary.select(F.explode("aliases").alias("term"), "id", F.lit(2).alias("tier")).where("term <> ''")
    return names.unionByName(aliases).groupBy("term", "tier").agg(F.min("id").alias("id"))


def resolve_names(available: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(query_id, raw, id) of (query_id, raw): the entry whose name, else one of whose aliases, equals the cleaned text."""
    terms = dictionary_terms(dictionary).groupBy("term").agg(F.min_by("id", "tier").alias("id"))
    cleaned = available.select("query_id", "raw", clean_text("raw").alias("term")).where("term <> ''")
    return cleaned.join(bounded_broadcast(terms), "term", "left").select("query_id", "raw", "id")


def essential_items(bridge: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(recipe_id, ingredient_id, name) of essential ingredients that are no seasoning, each once."""
    named = dictionary.where(~F.col("category").eqNullSafe(SEASONING)).select(F.col("id").alias("ingredient_id"), "name")
    once = bridge.groupBy("recipe_id", "ingredient_id").agg(F.max("is_essential").alias("is_essential")).where("is_essential")
    return once.join(bounded_broadcast(named, 10_000), "ingredient_id").select("recipe_id", "ingredient_id", "name")


def missing_items(candidates: DataFrame, items: DataFrame, available: DataFrame) -> DataFrame:
    """(query_id, recipe_id, essential_total, missing) of ``candidates`` (query_id, recipe_id).

    ``items``: see :func:`essential_items`; ``available``: (query_id, id). Names come in order of their ingredient's
    id; a recipe without essential items misses nothing.
    """
    have = available.where("id is not null").select("query_id", F.col("id").alias("ingredient_id")).distinct().withColumn("have", F.lit(True))
    each = candidates.select("query_id", "recipe_id").distinct().join(items, "recipe_id", "left").join(have, ["query_id", "ingredient_id"], "left")
    lack = F.when(F.col("ingredient_id").isNotNull() & F.col("have").isNull(), F.struct("ingredient_id", "name"))
    out = each.groupBy("query_id", "recipe_id").agg(F.count("ingredient_id").alias("essential_total"), F.sort_array(F.collect_list(lack)).alias("m"))
    return out.select("query_id", "recipe_id", "essential_total", F.transform("m", lambda x: x["name"]).alias("missing"))


def exclude_tagged(candidates: DataFrame, recipe_tags: DataFrame, tags: DataFrame, excluded: DataFrame) -> DataFrame:
    """``candidates`` (query_id, recipe_id) without those that have a tag named in ``excluded`` (query_id, tag)."""
    named = excluded.join(bounded_broadcast(tags.select(F.col("id").alias("tag_id"), F.col("name").alias("tag")), 10_000), "tag").select("query_id", "tag_id")
    # from the candidates on: what each query excludes, over all recipes, would be queries x recipes
    worn = candidates.select("query_id", "recipe_id").distinct().join(recipe_tags.select("recipe_id", "tag_id"), "recipe_id")
    hit = worn.join(named, ["query_id", "tag_id"], "left_semi").select("query_id", "recipe_id").distinct()
    return candidates.join(hit, ["query_id", "recipe_id"], "left_anti")


def blended_score(norm: Column, missing: Column, total: Column, difficulty: Column, minutes: Column) -> Column:
    """0.4 retrieval + 0.5 coverage + 0.05 ease + 0.05 speed, each between 0 and 1."""
    coverage = F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (total - missing) / total))).otherwise(1.0)
    ease = F.when(difficulty == 1, 1.0).when(difficulty == 2, 0.5).otherwise(0.0)
    speed = F.when(minutes <= 30, 1.0).when(minutes <= 60, 0.5).otherwise(0.0)
    return 0.4 * F.greatest(F.lit(0.0), norm) + 0.5 * coverage + 0.05 * ease + 0.05 * speed


def rank_candidates(candidates: DataFrame, missing: DataFrame, recipes: DataFrame, k: int) -> DataFrame:
    """(query_id, recipe_id, rank, n_missing, score): fewest missing first, then the blended score, then the id.

    ``candidates`` (query_id, recipe_id, match); the match is taken relative to the best of its query.
    """
    best = F.max("match").over(Window.partitionBy("query_id"))
    norm = candidates.withColumn("norm", F.when(best > 0, F.col("match") / best).otherwise(0.0))
    facts = recipes.select(F.col("id").alias("recipe_id"), "difficulty", "cook_time_minutes")
    full = norm.join(missing, ["query_id", "recipe_id"]).join(facts, "recipe_id")
    n = F.size("missing")
    scored = full.select("query_id", "recipe_id", n.alias("n_missing"), blended_score(F.col("norm"), n, F.col("essential_total"), F.col("difficulty"), F.col("cook_time_minutes")).alias("score"))
    order = Window.partitionBy("query_id").orderBy("n_missing", F.round("score", 9).desc(), "recipe_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _grams(text: Column) -> Column:
    """The distinct runs of one and of two characters in a text."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    return F.array_distinct(F.concat(F.transform(at, lambda i: F.substring(text, i, F.lit(1))), F.transform(at, lambda i: F.substring(text, i, F.lit(2)))))


def containing(short: DataFrame, long: DataFrame) -> DataFrame:
    """Rows of ``short`` (part and others) with those of ``long`` (whole and others) whose text holds theirs.

    They meet by the first two characters of the part among all runs of two in the whole, so that no table is compared
    with the whole of the other. Empty and null texts meet nothing.
    """
    keyed = long.where("whole <> ''").withColumn("__gram", F.explode(_grams(F.col("whole"))))
    asked = short.where("part <> ''").withColumn("__gram", F.left("part", F.lit(2)))
    return asked.join(keyed, "__gram").where(F.contains("whole", "part")).drop("__gram")


def link_items(items: DataFrame, dictionary: DataFrame, vectors: tuple[DataFrame, DataFrame] | None = None, least: float = 0.85) -> DataFrame:
    """(item, id, tier) of distinct ``items`` (item): exact name, alias, containment, vector; tier null if unknown.

    Containment holds either way; the longest name wins, then the least id. ``vectors``: (item, vec) and (id, vec).
    """
    asked = items.select("item", clean_text("item").alias("term")).where("term <> ''").distinct()
    terms = bounded_broadcast(dictionary_terms(dictionary))
    direct = asked.join(terms, "term").groupBy("item").agg(F.min_by(F.struct("id", "tier"), F.struct("tier", "id")).alias("hit"))
    loose = written(asked.join(direct, "item", "left_anti"), "loose-items")
    names = bounded_broadcast(dictionary.select("id", F.col("name").alias("raw_name"), clean_text("name").alias("name")).where("name <> ''"), 10_000)
    within = containing(names.withColumnRenamed("name", "part"), loose.withColumnRenamed("term", "whole")).select("item", "id", "raw_name")
    around = containing(loose.withColumnRenamed("term", "part"), names.withColumnRenamed("name", "whole")).select("item", "id", "raw_name")
    best = within.unionByName(around).groupBy("item").agg(F.max_by("id", F.struct(F.length("raw_name"), -F.col("id"))).alias("id"))
    linked = direct.select("item", "hit.id", "hit.tier").unionByName(best.withColumn("tier", F.lit(3)))
    if vectors is not None:
        left, right = vectors
        near = nearest_entry(left.join(linked, "item", "left_anti"), right)
        linked = linked.unionByName(near.where(1 - F.col("distance") >= least).select("item", "id", F.lit(4).alias("tier")))
    return items.select("item").distinct().join(linked, "item", "left")


def autocomplete(prefixes: DataFrame, dictionary: DataFrame, limit: int) -> DataFrame:
    """(q, id, name, pos): entries whose name or an alias contains ``q``, in order of name and id."""
    texts = dictionary.select("id", "name", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("whole"))
    found = containing(prefixes.select("q", F.col("q").alias("part")).distinct(), bounded_broadcast(texts, 50_000)).select("q", "id", "name").distinct()
    order = Window.partitionBy("q").orderBy("name", "id")
    return found.select("q", "id", "name", F.row_number().over(order).alias("pos")).where(F.col("pos") <= limit)


def autocomplete_topup(found: DataFrame, near: DataFrame, limit: int) -> DataFrame:
    """``found`` (q, id, pos) filled up to ``limit`` with neighbours (q, id, pos) that it lacks."""
    more = near.join(found.select("q", "id"), ["q", "id"], "left_anti")
    both = found.select("q", "id", F.lit(0).alias("tier"), "pos").unionByName(more.select("q", "id", F.lit(1).alias("tier"), "pos"))
    order = Window.partitionBy("q").orderBy("tier", "pos", "id")
    return both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("q", "id", "tier", "place")


def build_query(parsed: DataFrame, most: int = 30, longest: int = 50) -> DataFrame:
    """(query_id, query): the first ``most`` items (pos, name) of each, blank and overlong ones left out, each name once."""
    first = Window.partitionBy("query_id").orderBy("pos", "name")
    kept = parsed.select("query_id", "pos", "name", F.row_number().over(first).alias("__n")).where(F.col("__n") <= most)
    items = kept.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("__n", "name"))).alias("xs"))
    names = F.filter(F.transform("xs", lambda x: clean_text(x["name"])), lambda n: (n != "") & (F.length(n) <= longest))
    return items.select("query_id", F.array_join(F.array_distinct(names), " ").alias("query"))


def request_faults(requests: DataFrame) -> DataFrame:
    """(request_id, valid, reason) of search requests (request_id, q, ingredients, exclude_tags, limit_n); the first fault.

    The text has 1 to 200 characters and the limit is 1 to 50; at most 30 ingredients and 20 tags, each of at most 50
    characters; no control characters. A null list is empty; a null text or limit is a fault.
    """
    q = strip(F.coalesce("q", F.lit("")))
    control = lambda c: c.rlike(CONTROLS)
    reason = F.when(q == "", "empty text").when(F.length(q) > 200, "long text").when(control(q), "control character")
    reason = reason.when(~F.coalesce(F.col("limit_n").between(1, 50), F.lit(False)), "limit")
    for name, most in (("ingredients", 30), ("exclude_tags", 20)):
        values = csv_values(name)
        reason = reason.when(F.size(values) > most, f"many {name}").when(F.exists(values, lambda v: F.length(v) > 50), f"long {name}").when(F.exists(values, control), f"control character in {name}")
    return requests.select("request_id", reason.isNull().alias("valid"), reason.alias("reason"))


def valid_choices(chosen: DataFrame, candidates: DataFrame, recipes: DataFrame) -> DataFrame:
    """(query_id, recipe_id, place, title, difficulty, cook_time_minutes, n_steps, steps_from, degraded): generated choices
    (query_id, recipe_id, pos, steps) that are candidates (query_id, recipe_id, rank), each once, in the candidates' order.

    The facts are those of ``recipes``; of a recipe chosen twice the first counts; steps that are null or empty are
    filled from the recipe (steps_from). A query none of whose choices is valid gets all its candidates (degraded).
    """
    first = chosen.groupBy("query_id", "recipe_id").agg(F.min_by("steps", "pos").alias("own"))
    joined = candidates.join(first.withColumn("__chosen", F.lit(True)), ["query_id", "recipe_id"], "left")
    some = first.join(candidates, ["query_id", "recipe_id"], "left_semi").select("query_id").distinct().withColumn("__some", F.lit(True))
    kept = joined.join(some, "query_id", "left").where(F.col("__chosen") | F.col("__some").isNull())
    facts = recipes.select(F.col("id").alias("recipe_id"), "title", "difficulty", "cook_time_minutes", F.col("steps.instruction").alias("stored"))
    own = F.size(F.coalesce("own", F.array().cast("array<string>"))) > 0
    full = kept.join(facts, "recipe_id").withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "recipe_id")))
    return full.select(
        "query_id", "recipe_id", "place", "title", "difficulty", "cook_time_minutes",
        F.size(F.when(own, F.col("own")).otherwise(F.coalesce("stored", F.array().cast("array<string>")))).alias("n_steps"),
        F.when(own, "choice").otherwise("recipe").alias("steps_from"), F.col("__some").isNull().alias("degraded"),
    )


def recipe_facts(wanted: DataFrame, recipes: DataFrame, bridge: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(query_id, recipe_id, title, difficulty, cook_time_minutes, n_steps, seasonings) of ``wanted`` (query_id, recipe_id),
    from storage; ids that have vanished give no row. Seasonings come with their amounts, in order of id."""
    keys = wanted.select("query_id", "recipe_id").distinct()
    rows = recipes.select(F.col("id").alias("recipe_id"), "title", "difficulty", "cook_time_minutes", F.coalesce(F.size("steps"), F.lit(0)).alias("n_steps"))
    named = bounded_broadcast(dictionary.where(F.col("category") == SEASONING).select(F.col("id").alias("ingredient_id"), "name"), 10_000)
    used = bridge.join(keys.select("recipe_id").distinct(), "recipe_id", "left_semi").groupBy("recipe_id", "ingredient_id").agg(F.min("amount").alias("amount")).join(named, "ingredient_id")
    line = F.concat_ws("：", "name", F.nullif(F.col("amount"), F.lit("")))
    lists = used.groupBy("recipe_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ingredient_id", line.alias("t")))), lambda x: x["t"]), "；").alias("seasonings"))
    return keys.join(rows, "recipe_id").join(lists, "recipe_id", "left").select("query_id", "recipe_id", "title", "difficulty", "cook_time_minutes", "n_steps", F.coalesce("seasonings", F.lit("")).alias("seasonings"))


#: Kinds of tags in the order they are shown (fixed values).
TAG_KINDS = ("allergen", "avoid", "cuisine", "taste")


def grouped_tags(tags: DataFrame) -> DataFrame:
    """(kind, place, names): the tags (name, kind) of each kind of ``TAG_KINDS``; kinds without tags and other kinds give no row."""
    place = F.array_position(F.array(*[F.lit(k) for k in TAG_KINDS]), F.col("kind")).cast("int")
    return tags.where(F.col("kind").isin(*TAG_KINDS)).groupBy("kind", place.alias("place")).agg(F.array_join(F.sort_array(F.collect_list("name")), "、").alias("names"))


def detail_lists(bridge: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(recipe_id, ingredients, seasonings): names in order of id, joined by a comma, apart by category."""
    named = bounded_broadcast(dictionary.select(F.col("id").alias("ingredient_id"), "name", F.col("category").eqNullSafe(SEASONING).alias("s")), 10_000)
    once = bridge.select("recipe_id", "ingredient_id").distinct().join(named, "ingredient_id")
    pick = lambda s: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("s") == s, F.struct("ingredient_id", "name")))), lambda x: x["name"]), "、")
    return once.groupBy("recipe_id").agg(pick(False).alias("ingredients"), pick(True).alias("seasonings"))
