"""Queries on texts measured in tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import table, written
from .encode import VOCABULARY, encode, token_bytes, token_counts
from .pack import fill_containers
from .split import split_long

#: Capacity of a container, and limit and overlap of pieces, in tokens.
CAPACITY, LIMIT, OVERLAP = 4096, 1024, 64


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary=VOCABULARY)


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, and every part of one that is larger than a container, with its container."""
    sizes = token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary=VOCABULARY)
    return fill_containers(sizes.withColumnRenamed("doc_id", "item"), CAPACITY).withColumnRenamed("item", "doc_id")


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document of more than LIMIT tokens."""
    return split_long(table(spark, sf_dir, "documents").select("doc_id", "text"), LIMIT, OVERLAP, vocabulary=VOCABULARY)


def p8_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents have ids, how many have none, and of how many the ids, put together, are not as many bytes as the text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes"))
    sizes = token_bytes(p8_ids(spark, sf_dir), VOCABULARY)
    both = docs.join(sizes, "doc_id")
    return both.agg(F.count_if(F.col("bytes") > 0).alias("with_ids"), F.count_if(F.col("n_bytes") == 0).alias("without"), F.count_if(F.col("bytes") != F.col("n_bytes")).alias("wrong"))


def p9_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed, containers above the capacity, and documents that were split although they fit one."""
    packed = written(p9_containers(spark, sf_dir), "packed")
    loads = packed.groupBy("container").agg(F.sum("n_tokens").alias("load")).agg(F.count_if(F.col("load") > CAPACITY).alias("overfull"))
    docs = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("n_tokens").alias("n"))
    return docs.agg(F.count(F.lit(1)).alias("docs"), F.count_if((F.col("parts") > 1) & (F.col("n") <= CAPACITY)).alias("split")).crossJoin(F.broadcast(loads))


def p10_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces above the limit, bodies that don't follow one another, and texts whose pieces don't end where they do."""
    pieces = written(p10_pieces(spark, sf_dir).select("doc_id", "piece", "from_char", "to_char", "body_from", "n_tokens"), "pieces")
    last = F.lag("to_char", 1, 0).over(Window.partitionBy("doc_id").orderBy("piece"))
    judged = pieces.withColumn("gap", (F.col("body_from") != last) | (F.col("from_char") > F.col("body_from")))
    ends = pieces.groupBy("doc_id").agg(F.max("to_char").alias("end"))
    texts = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    short = ends.join(texts, "doc_id").agg(F.count_if(F.col("end") != F.col("n")).alias("unfinished"))
    return judged.agg(F.count_if(F.col("n_tokens") > LIMIT).alias("over_limit"), F.count_if("gap").alias("gaps")).crossJoin(F.broadcast(short))


QUERIES = {"p8_ids": p8_ids, "p8_lengths": p8_lengths, "p9_containers": p9_containers, "p9_audit": p9_audit, "p10_pieces": p10_pieces, "p10_audit": p10_audit}
#: SQL can't count tokens, so it states what must hold of the results.
SQL: dict[str, str] = {
    "p8_lengths": "SELECT count(*) FILTER (WHERE text <> '') AS with_ids, count(*) FILTER (WHERE coalesce(text, '') = '') AS without, 0 AS wrong FROM documents",
    "p9_audit": "SELECT count(*) AS docs, 0 AS split, 0 AS overfull FROM documents",
    "p10_audit": "SELECT 0 AS over_limit, 0 AS gaps, 0 AS unfinished",
}
