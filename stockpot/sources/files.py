"""Envelope files, JSON Lines lists, exports and checkpoint state as Spark sources and sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = T.StructType([T.StructField("name", T.StringType()), T.StructField("amount", T.StringType()), T.StructField("is_essential", T.BooleanType())])
STEP = T.StructType([T.StructField("instruction", T.StringType()), T.StructField("minutes", T.IntegerType())])
RECIPE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("title", "source_url", "description")]
    + [T.StructField(n, T.IntegerType()) for n in ("difficulty", "cook_time_minutes", "servings")]
    + [T.StructField("steps", T.ArrayType(STEP)), T.StructField("ingredients", T.ArrayType(ENTRY)), T.StructField("seasonings", T.ArrayType(ENTRY)), T.StructField("tags", T.ArrayType(T.StringType()))]
)
ENVELOPE = T.StructType(
    [T.StructField("schema_version", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("site", "crawled_at", "discovered_from")]
    + [T.StructField("recipe", RECIPE), T.StructField("_corrupt_record", T.StringType())]
)


def read_envelopes(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """Envelopes of all files named by a digest, with their path; unreadable ones have only ``_corrupt_record``.

    With ``limit`` the first so many in order of their path.
    """
    files = spark.read.schema(ENVELOPE).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    named = files.withColumn("path", F.input_file_name()).where(F.col("path").rlike(r"/[0-9a-f]{64}\.json$"))
    return named if limit is None else named.orderBy("path").limit(limit)


def write_envelopes(rows: DataFrame, folder: str) -> None:
    """Append (site, crawled_at, discovered_from, recipe) as JSON Lines of envelopes; the committer makes it atomic."""
    envelope = F.struct(F.lit(1).alias("schema_version"), "site", "crawled_at", "discovered_from", "recipe")
    rows.select(F.to_json(envelope).alias("value")).write.mode("append").text(folder)


def append_lines(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").json(folder)


def read_lines(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON Lines by ``schema``; lines that don't parse are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder)


def write_export(lines: DataFrame, folder: str) -> None:
    """(line_no, line) as text in order, over as many files as the data needs: names of files follow the order."""
    lines.repartitionByRange("line_no").sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(folder)


def save_state(spark: SparkSession, folder: str, state: dict[str, str]) -> None:
    spark.createDataFrame(sorted(state.items()), "key string, value string").coalesce(1).write.mode("overwrite").json(folder)


def load_state(spark: SparkSession, folder: str, most: int = 10_000) -> dict[str, str]:
    """The saved state; empty where there is none, and lines that don't parse are skipped. More than ``most`` keys fail."""
    try:
        rows = spark.read.schema("key string, value string").json(folder).limit(most + 1).collect()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return {}
        raise
    if len(rows) > most:
        raise ValueError(f"a state has at most {most} keys; keep larger ones in a table")
    return {r.key: r.value for r in rows if r.key is not None}


def synthetic_recipes(spark: SparkSession, n: int, words: dict[str, list[str]]) -> DataFrame:
    """(i, title) of ``n`` recipes put together from lists of words by the digits of their number, always alike."""
    rest, parts = F.col("i"), []
    for name in words:
        values = words[name]
        parts.append(F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(rest, F.lit(len(values))) + 1).cast("int")))
        rest = F.floor(rest / len(values))
    return spark.range(n).withColumnRenamed("id", "i").select("i", F.concat(*parts).alias("title"))
