"""Queries on free-entered values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import bounded_broadcast, table
from .canonical import map_to_entries


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "ingredients")
    items = table(spark, sf_dir, "crawled_ingredients").select("item_id", "name")
    # items whose name is exactly that of an entry need no mapping
    loose = items.join(bounded_broadcast(entries.select("name").distinct()), "name", "left_anti")
    out = map_to_entries(loose, "item_id", "name", entries, "id", "name", "aliases")
    return out.select(F.col("item").alias("item_id"), F.col("entry").alias("ingredient_id"))


QUERIES = {"p3_found": p3_found}
SQL: dict[str, str] = {}
