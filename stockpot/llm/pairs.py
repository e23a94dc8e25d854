"""Items that appear together: counts of pairs kept up to date by changes, and how far they exceed chance.

The counts lie in tables of hash buckets below a named folder. A batch of new or withdrawn rows touches some baskets; for
those alone the pairs they had and the pairs they have now are compared, and the differences, signed, are merged into the
buckets they fall into: only these are read and overwritten. Scores are recomputed for the pairs whose counts, or whose
items' counts, changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import bounded_broadcast, written

BUCKETS = 64


def _bucket(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(BUCKETS)).cast("int")


def basket_pairs(rows: DataFrame, block: int = 256) -> DataFrame:
    """(a, b, fresh) for every two items a < b of each basket of the distinct ``rows`` (basket, item, fresh).

    ``fresh`` is whether either of the two is. A basket of more than ``block`` items is cut into
    blocks of items that meet two by two in different tasks, so none is ever collected whole.
    """
    size = rows.groupBy("basket").agg(F.count(F.lit(1)).alias("n"))
    parted = rows.join(size, "basket").select("basket", "item", "fresh", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    small = parted.where("parts = 1").groupBy("basket").agg(F.sort_array(F.collect_list(F.struct("item", "fresh"))).alias("xs"))
    firsts = small.select("xs", F.posexplode("xs").alias("p", "x"))
    near = firsts.select("x", F.explode(F.expr("slice(xs, p + 2, size(xs))")).alias("y"))
    big = parted.where("parts > 1").select("basket", F.struct("item", "fresh").alias("x"), F.pmod(F.xxhash64("item"), F.col("parts")).cast("int").alias("k"), "parts")
    left = big.select("basket", "x", F.col("k").alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"))
    right = big.select("basket", F.col("x").alias("y"), F.col("k").alias("j"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"))
    far = left.join(right, ["basket", "i", "j"]).select("x", "y").where("x.item < y.item")
    return near.unionByName(far).select(F.col("x.item").alias("a"), F.col("y.item").alias("b"), (F.col("x.fresh") | F.col("y.fresh")).alias("fresh"))


@dataclass(frozen=True)
class Changes:
    """What an update changed: the pairs (a, b) and the items (item) whose counts are others now."""

    pairs: DataFrame
    items: DataFrame


class PairStore:
    """Rows (basket, item, live) by bucket of the basket, pairs (a, b, n_ab) and items (item, n_item) by their own, below
    ``path``; and the number of baskets.

    A table's bucket is replaced as a whole by the committer, so a lost executor leaves either the old or the new one.
    Withdrawn rows and counts that fell to 0 stay as such in their bucket. One update runs at a time.
    """

    def __init__(self, spark: SparkSession, path: str, kinds: tuple[str, str] = ("long", "long")):
        self.spark, self.path = spark, path
        basket, item = kinds
        self.schemas = {
            "rows": f"basket {basket}, item {item}, live boolean, bucket int",
            "pairs": f"a {item}, b {item}, n_ab long, bucket int",
            "items": f"item {item}, n_item long, bucket int",
            "baskets": "n long, bucket int",
        }

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or only some of its buckets; empty where nothing has been written."""
        try:
            df = self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            df = self.spark.createDataFrame([], self.schemas[name])
        return df if buckets is None else df.where(F.col("bucket").isin(buckets))

    def replace(self, name: str, df: DataFrame) -> None:
        """Overwrite the buckets that ``df`` has rows of; the others stay untouched."""
        cols = [c.split()[0] for c in self.schemas[name].split(", ")]
        whole = df.select(*cols).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        whole.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/{name}")

    @staticmethod
    def touched(df: DataFrame) -> list[int]:
        """The buckets of ``df``, at most BUCKETS."""
        return sorted(r[0] for r in df.select("bucket").distinct().collect())

    @property
    def total(self) -> DataFrame:
        return self.read("baskets").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def _merged(store: PairStore, name: str, deltas: DataFrame, keys: list[str], count: str) -> None:
    """Add ``deltas`` (keys, d; one row each) to the counts in the buckets they fall into."""
    deltas = deltas.withColumn("bucket", _bucket(*keys))
    buckets = store.touched(deltas)
    if buckets:
        old = store.read(name, buckets).select(*keys, F.col(count).alias("d"), "bucket")
        store.replace(name, old.unionByName(deltas.select(old.columns)).groupBy(*keys, "bucket").agg(F.sum("d").alias(count)))


def update(store: PairStore, added: DataFrame | None = None, removed: DataFrame | None = None) -> Changes:
    """Add rows (basket, item) to the store and withdraw others; gives what changed.

    Adding a row that is there and withdrawing one that isn't change nothing; a row both added and withdrawn stays. Rows
    with a null basket or item are left out. Reads the baskets' rows in the touched buckets, and of the counts only the
    buckets that a difference falls into.
    """
    none = store.spark.createDataFrame([], store.schemas["rows"]).select("basket", "item")
    clean = lambda df: none if df is None else df.select("basket", "item").where("basket is not null and item is not null").distinct()
    asked = clean(added).withColumn("up", F.lit(True))
    if removed is not None:
        asked = asked.unionByName(clean(removed).withColumn("up", F.lit(False))).groupBy("basket", "item").agg(F.max("up").alias("up"))
    asked = written(asked.withColumn("bucket", _bucket("basket")), "asked")
    buckets = store.touched(asked)
    known = store.read("rows", buckets)
    state = asked.join(known.select("basket", "item", "live"), ["basket", "item"], "left")
    moved = state.where("up <> coalesce(live, false)").select("basket", "item", "bucket", F.when(F.col("up"), 1).otherwise(-1).alias("sign"), F.col("live").isNotNull().alias("known"))
    moved = written(moved, "moved")
    # the touched baskets as they are without the moved rows, with these marked: only pairs that need one of them change
    touched = moved.select("basket").distinct()
    rest = known.where("live").join(touched, "basket", "left_semi").join(moved.select("basket", "item"), ["basket", "item"], "left_anti")
    rest = written(rest.select("basket", "item", F.lit(False).alias("fresh")), "kept-rows")
    pairs, begun = [], []
    for sign in (1,) if removed is None else (1, -1):
        own = moved.where(F.col("sign") == sign).select("basket", "item", F.lit(True).alias("fresh"))
        whole = rest.join(own.select("basket").distinct(), "basket", "left_semi").unionByName(own)
        pairs.append(basket_pairs(whole).where("fresh").groupBy("a", "b").agg((F.count(F.lit(1)) * sign).alias("d")))
        # a basket begins with its first row and ends with its last; one that does both is there before and after
        only = own.select("basket").distinct().join(rest.select("basket").distinct(), "basket", "left_anti")
        begun.append(only.agg((F.count(F.lit(1)) * sign).alias("n")))
    pair_delta = pairs[0] if removed is None else pairs[0].unionByName(pairs[1]).groupBy("a", "b").agg(F.sum("d").alias("d")).where("d <> 0")
    pair_delta = written(pair_delta, "changed-pairs")
    item_delta = written(moved.groupBy("item").agg(F.sum("sign").alias("d")).where("d <> 0"), "changed-items")
    _merged(store, "pairs", pair_delta, ["a", "b"], "n_ab")
    _merged(store, "items", item_delta, ["item"], "n_item")
    n = begun[0] if removed is None else begun[0].unionByName(begun[1])
    total = written(store.total.unionByName(n).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")), "total")
    back = store.touched(moved.where("known"))
    if back:
        marks = moved.select("basket", "item", (F.col("sign") > 0).alias("now"))
        old = store.read("rows", back).join(marks, ["basket", "item"], "left")
        store.replace("rows", written(old.select("basket", "item", F.coalesce("now", "live").alias("live"), "bucket"), "rows"))
    fresh = moved.where("not known").select("basket", "item", F.lit(True).alias("live"), "bucket")
    fresh.repartition("bucket").write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(f"{store.path}/rows")
    store.replace("baskets", total.withColumn("bucket", F.lit(0)))
    return Changes(pair_delta.select("a", "b"), item_delta.select("item"))


def pair_counts(store: PairStore, changes: Changes | None = None) -> DataFrame:
    """(a, b, n_ab, n_a, n_b) of all pairs, or of those that ``changes`` affect by themselves or by one of their items."""
    pairs = store.read("pairs").where("n_ab > 0").select("a", "b", "n_ab")
    if changes is not None:
        pairs = pairs.join(affected(pairs, changes), ["a", "b"], "left_semi")
    items = bounded_broadcast(store.read("items").where("n_item > 0").select("item", "n_item"))
    a, b = items.withColumnsRenamed({"item": "a", "n_item": "n_a"}), items.withColumnsRenamed({"item": "b", "n_item": "n_b"})
    return pairs.join(a, "a").join(b, "b").select("a", "b", "n_ab", "n_a", "n_b")


def affected(pairs: DataFrame, changes: Changes) -> DataFrame:
    """The pairs (a, b) of ``pairs`` whose score is another after ``changes``, and those that are no more."""
    items = bounded_broadcast(changes.items)
    of = lambda end: pairs.select("a", "b").join(items.withColumnRenamed("item", end), end, "left_semi")
    return changes.pairs.unionByName(of("a")).unionByName(of("b").select("a", "b")).distinct()


def updated_counts(scored: DataFrame, store: PairStore, changes: Changes) -> DataFrame:
    """``scored`` (see :func:`pair_counts`) with the pairs that ``changes`` affect counted anew."""
    return scored.join(affected(scored, changes), ["a", "b"], "left_anti").unionByName(pair_counts(store, changes))


def scores(counts: DataFrame, store: PairStore) -> DataFrame:
    """``counts`` with n, lift and pmi; the number of baskets, which any change moves, comes in last as one row."""
    full = counts.crossJoin(F.broadcast(store.total))
    lift = F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))
    return full.select("a", "b", "n_ab", "n_a", "n_b", "n", lift.alias("lift"), F.log2(lift).alias("pmi"))
