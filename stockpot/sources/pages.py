"""Addresses and recipes in crawled pages and site maps."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_instructions, strip, url_host

#: Paths of log-in and challenge pages (fixed values).
BLOCKED = r"/auth/|[Cc][Aa][Pp][Tt][Cc][Hh][Aa]"


def read_sitemaps(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, xml) of the site maps in a folder, each whole; Spark unpacks those whose name ends in .gz."""
    files = spark.read.option("wholetext", True).text(folder)
    return files.select(F.input_file_name().alias("page_id"), F.col("value").alias("xml"))


def sitemap_urls(pages: DataFrame) -> DataFrame:
    """(page_id, pos, url) of the ``loc`` elements of (page_id, xml), whatever their namespace."""
    found = F.regexp_extract_all("xml", F.lit(r"<(?:\w+:)?loc\b[^>]*>\s*([^<]*?)\s*</(?:\w+:)?loc>"), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("pos", "url")).where("url <> ''")


#: The path of a recipe's page (fixed value).
RECIPE_PATH = r"/recipe/\d+/?"


def recipe_links(html: Column) -> Column:
    """Distinct links to recipes in order of first appearance."""
    links = F.regexp_extract_all(html, F.lit(r"""href\s*=\s*["']([^"']*)["']"""), F.lit(1))
    return F.array_distinct(F.filter(links, lambda x: x.rlike(rf"^(?:https?://[^/]+)?{RECIPE_PATH}$")))


def has_next(html: Column) -> Column:
    return html.rlike(r"""(?i)<a\b[^>]*(?:rel\s*=\s*["']next["']|class\s*=\s*["'][^"']*\bnext\b)""")


def is_blocked(url: Column) -> Column:
    """Whether a page was answered by a log-in or a challenge."""
    return url.rlike(BLOCKED)


def on_sites(url: Column, hosts: list[str]) -> Column:
    return F.coalesce(url_host(url).isin(*hosts), F.lit(False))


def linked_data_recipe(html: Column) -> Column:
    """The first object of type Recipe among the page's JSON-LD blocks, as a variant; broken blocks are skipped."""
    blocks = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    each = F.flatten(
        F.transform(
            F.filter(F.transform(blocks, F.try_parse_json), lambda v: v.isNotNull()),
            lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v)),
        )
    )
    return F.get(F.filter(each, lambda v: F.coalesce(F.try_variant_get(v, "$['@type']", "string") == "Recipe", F.lit(False))), F.lit(0))


class _Fields(HTMLParser):
    """Collects the text of elements by class name, tolerant of unclosed tags."""

    VOID = {"br", "img", "hr", "input", "meta", "link"}

    def __init__(self, wanted: dict[str, str]):
        super().__init__()
        self.wanted, self.open, self.found, self.skip = wanted, [], {k: [] for k in wanted.values()}, 0

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        self.skip += tag in ("script", "style", "noscript", "svg")
        classes = (dict(attrs).get("class") or "").split()
        hit = [self.wanted[c] for c in classes if c in self.wanted]
        for h in hit:
            self.found[h].append("")
        self.open.append((tag, hit))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self.open:
                t, _ = self.open.pop()
                self.skip -= t in ("script", "style", "noscript", "svg")
                if t == tag:
                    break

    def handle_data(self, data):
        if not self.skip:
            for _, hit in self.open:
                for h in hit:
                    self.found[h][-1] += data


def fields_by_class(pages: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """(page_id, field, pos, text) of (page_id, html): the text of each element of a class in ``wanted`` (class -> field)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for pid, html in zip(pdf["page_id"], pdf["html"]):
                p = _Fields(wanted)
                p.feed(html or "")
                rows += [(pid, f, i, " ".join(t.split())) for f, ts in p.found.items() for i, t in enumerate(ts) if t.strip()]
            yield pd.DataFrame(rows, columns=["page_id", "field", "pos", "text"])

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "html").mapInPandas(run, f"page_id {kind}, field string, pos int, text string")


def linked_fields(pages: DataFrame) -> DataFrame:
    """(page_id, field, pos, text) of (page_id, html) from the page's linked data: title, description, ingredients, steps."""
    data = pages.select("page_id", linked_data_recipe(F.col("html")).alias("v")).where("v is not null")
    one = lambda path: F.array(F.try_variant_get("v", path, "string"))
    many = lambda path: F.coalesce(F.try_variant_get("v", path, "array<string>"), one(path))
    steps = F.flatten(F.transform(many("$.recipeInstructions"), split_instructions))
    parts = {"title": one("$.name"), "description": one("$.description"), "ingredient": many("$.recipeIngredient"), "step": steps}
    each = data.select("page_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), v.alias("texts")) for f, v in parts.items()))).alias("x"))
    rows = each.select("page_id", "x.field", F.posexplode("x.texts").alias("pos", "text"))
    return rows.select("page_id", "field", "pos", F.regexp_replace(strip("text"), r"[\s\p{Z}]+", " ").alias("text")).where("text <> ''")


def page_fields(pages: DataFrame, layouts: list[dict[str, str]]) -> DataFrame:
    """(page_id, field, pos, text) of (page_id, html): each field by the first layout (class -> field) that finds it on the
    page, else from linked data. Null pages and pages without any field give no row."""
    found = [fields_by_class(pages, layout).withColumn("way", F.lit(i)) for i, layout in enumerate(layouts)]
    rows = linked_fields(pages).withColumn("way", F.lit(len(layouts)))
    for f in found:
        rows = rows.unionByName(f)
    best = rows.groupBy("page_id", "field").agg(F.min("way").alias("way"))
    return rows.join(best, ["page_id", "field", "way"]).select("page_id", "field", "pos", "text")
