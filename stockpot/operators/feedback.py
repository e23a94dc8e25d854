"""Feedback: duplicates, counts, export, limits per window; and offline evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..runtime import written


def normal_action(column: str = "action"):
    return F.lower(strip(F.col(column)))


def distinct_feedback(feedback: DataFrame) -> DataFrame:
    """(recipe_id, client_fingerprint, action, id, created_at): the least id of each triple; spelling of actions unified.

    Rows without a recipe or a fingerprint are duplicates of nothing but their own id.
    """
    rows = feedback.select("id", "recipe_id", "client_fingerprint", normal_action().alias("action"), "created_at")
    first = (F.min("id").alias("id"), F.min_by("created_at", "id").alias("created_at"))
    keyed = rows.where("recipe_id is not null and client_fingerprint is not null").groupBy("recipe_id", "client_fingerprint", "action").agg(*first)
    loose = rows.where("recipe_id is null or client_fingerprint is null").groupBy("id").agg(*[F.first(c).alias(c) for c in ("recipe_id", "client_fingerprint", "action", "created_at")])
    return keyed.unionByName(loose.select(keyed.columns))


def accept_feedback(existing: DataFrame, incoming: DataFrame, recipes: DataFrame) -> DataFrame:
    """(request_id, status, id) of ``incoming`` (request_id, recipe_id, client_fingerprint, action) feedback.

    ``no recipe`` where the recipe (id of ``recipes``) does not exist; ``known`` with the id of the existing row where
    the triple is there already; else ``new``, and ``repeated`` for all but the first request of a new triple.
    """
    rows = incoming.select("request_id", "recipe_id", "client_fingerprint", normal_action().alias("action"))
    key = ["recipe_id", "client_fingerprint", "action"]
    ids = distinct_feedback(existing).where("recipe_id is not null and client_fingerprint is not null").select(*key, "id")
    real = recipes.select(F.col("id").alias("recipe_id"), F.lit(True).alias("__real")).distinct()
    joined = rows.join(real, "recipe_id", "left").join(ids, key, "left")
    firsts = rows.groupBy(*key).agg(F.min("request_id").alias("request_id")).select("request_id", F.lit(True).alias("__first"))
    joined = joined.join(firsts, "request_id", "left")
    status = F.when(F.col("__real").isNull(), "no recipe").when(F.col("id").isNotNull(), "known").when(F.col("__first"), "new").otherwise("repeated")
    return joined.withColumn("status", status).select("request_id", "status", F.when(F.col("status") == "known", F.col("id")).alias("id"))


def action_counts(feedback: DataFrame) -> DataFrame:
    """(recipe_id, likes, dislikes, total); rows without a recipe are a group of their own."""
    of = lambda a: F.count_if(F.col("action") == a)
    return feedback.groupBy("recipe_id").agg(of("like").alias("likes"), of("dislike").alias("dislikes"), F.count(F.lit(1)).alias("total"))


def export_lines(feedback: DataFrame, exported_at: str) -> DataFrame:
    """(line_no, line) of a JSON Lines export: a row of totals, then each feedback (id, recipe_id, action, created_at) by id.

    The totals hold the time of the export, the rows, those of either action, and the recipes, where feedback without a
    recipe counts as of one. Nulls are written out. An empty table gives the totals only.
    """
    keep = {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss"}
    of = lambda a: F.count_if(F.col("action") == a).alias(a)
    recipes = F.count_distinct("recipe_id") + F.coalesce(F.max(F.col("recipe_id").isNull().cast("int")), F.lit(0))
    meta = feedback.agg(F.lit(exported_at).alias("exported_at"), F.count(F.lit(1)).alias("count"), of("like"), of("dislike"), recipes.alias("recipes"))
    head = meta.select(F.lit(0).cast("long").alias("line_no"), F.to_json(F.struct(F.struct(*meta.columns).alias("_meta"))).alias("line"))
    rows = feedback.select(F.col("id").alias("line_no"), F.to_json(F.struct("id", "recipe_id", "action", "created_at"), keep).alias("line"))
    return head.unionByName(rows)


def over_limit(requests: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """``requests`` (client, ts, request_id) with ``window_start``, ``n`` and ``refused``: those beyond ``limit`` in a fixed window."""
    start = F.timestamp_seconds(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / seconds) * seconds).cast("timestamp_ntz")
    w = Window.partitionBy("client", "window_start").orderBy("ts", "request_id")
    return requests.withColumn("window_start", start).withColumn("n", F.row_number().over(w)).withColumn("refused", F.col("n") > limit)


def recall_at_k(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(queries, recall, coverage) over queries with a relevant document: mean share found, share with any found."""
    rel = relevant.select("query_id", "doc_id").distinct()
    got = ranked.where(F.col("rank") <= k).select("query_id", "doc_id").distinct().withColumn("hit", F.lit(1))
    each = rel.join(got, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("found"))
    return each.agg(F.count(F.lit(1)).alias("queries"), F.avg(F.col("found") / F.col("n")).alias("recall"), F.avg((F.col("found") > 0).cast("int")).alias("coverage"))


def linking_accuracy(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(hits, total, accuracy) by items: of ``expected`` (case_id, item_no, alternatives) those of which any alternative is
    among the names ``found`` (case_id, name) for the case. Without anything expected the accuracy is 1."""
    names = expected.select("case_id", "item_no", F.explode_outer("alternatives").alias("name"))
    got = found.select("case_id", "name").distinct().withColumn("hit", F.lit(True))
    items = names.join(got, ["case_id", "name"], "left").groupBy("case_id", "item_no").agg(F.coalesce(F.max("hit"), F.lit(False)).alias("hit"))
    totals = items.agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("total"))
    return totals.select("hits", "total", F.when(F.col("total") > 0, F.col("hits") / F.col("total")).otherwise(1.0).alias("accuracy"))


def latency_p95(samples: DataFrame) -> DataFrame:
    """(kind, n, p95, mean) of (kind, ms): the value at place int(0.95 n) - 1 from 0, at least the first.

    Samples are sorted by ranges; counts of each range tell in which the place falls, and only that range is numbered.
    """
    sorted_ = written(samples.where("ms is not null").repartitionByRange("kind", "ms").withColumn("part", F.spark_partition_id()), "sorted")
    counts = sorted_.groupBy("kind", "part").agg(F.count(F.lit(1)).alias("c"), F.sum("ms").alias("s"))
    by_kind = Window.partitionBy("kind")
    # a row for each kind and range
    placed = counts.select("kind", "part", "c", F.sum("c").over(by_kind).alias("n"), (F.sum("s").over(by_kind) / F.sum("c").over(by_kind)).alias("mean"), (F.sum("c").over(by_kind.orderBy("part")) - F.col("c")).alias("before"))
    want = F.greatest(F.lit(1), F.floor(F.col("n") * 0.95).cast("long"))
    there = placed.withColumn("want", want).where((F.col("before") < F.col("want")) & (F.col("want") <= F.col("before") + F.col("c")))
    inside = sorted_.join(F.broadcast(there), ["kind", "part"]).withColumn("at", F.row_number().over(Window.partitionBy("kind", "part").orderBy("ms")) + F.col("before"))
    return inside.where(F.col("at") == F.col("want")).select("kind", "n", F.col("ms").alias("p95"), "mean")
