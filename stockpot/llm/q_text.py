"""Queries on look-alike texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from .plain import changed_forms, word_scripts


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    recipes = changed_forms(table(spark, sf_dir, "recipes"), "recipes", "id", "title")
    return recipes.unionByName(changed_forms(table(spark, sf_dir, "crawled_ingredients"), "crawled_ingredients", "item_id", "name"))


def p2_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed-script and whole-script confusable words of the recipe titles and the crawled names."""

    def words(source: str, key: str, text: str) -> DataFrame:
        out = word_scripts(table(spark, sf_dir, source), key, text)
        return out.select(F.lit(source).alias("source_table"), F.col(key).alias("row_id"), "word", "scripts", "resolved", "kind")

    return words("recipes", "id", "title").unionByName(words("crawled_ingredients", "item_id", "name")).distinct()


QUERIES = {"p2_found": p2_found, "p2_words": p2_words}
SQL: dict[str, str] = {}
