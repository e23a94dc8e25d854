"""Documents packed into containers of a fixed capacity by a grouping genetic algorithm on islands.

Items are dealt to blocks of bounded size by a hash. For each block several islands, each a group of its own, keep a
small population of packings. A crossover injects whole well-filled containers of one packing into another, removes the
containers that hold an item twice, and puts the displaced items back by best fit. After each epoch the best packings
of an island migrate to the next island of the block. A block rests as soon as it needs no more containers than its
total size demands. What the badly filled containers of all blocks hold is dealt anew and packed once more, so that
blocks don't each waste the end of a container.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import written

STATE = "block int, island int, rank int, bins array<int>, used int, need int"


def best_fit(sizes: np.ndarray, order: np.ndarray, capacity: int, bins: np.ndarray, room: list[int]) -> np.ndarray:
    """Put the items in ``order`` into the fullest container that has room, opening new ones; extends ``bins``, ``room``."""
    from bisect import bisect_left, insort

    free = sorted((r, i) for i, r in enumerate(room))
    for item in order:
        s = int(sizes[item])
        at = bisect_left(free, (s, -1))
        if at < len(free):
            r, i = free.pop(at)
        else:
            i, r = len(room), capacity
            room.append(capacity)
        room[i] = r - s
        bins[item] = i
        insort(free, (r - s, i))
    return bins


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> float:
    """Mean square of how full the containers are: high when few are full and the rest empty."""
    load = np.bincount(bins, weights=sizes)
    load = load[np.bincount(bins) > 0]
    return float(np.mean((load / capacity) ** 2))


def crossover(sizes: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """The packing ``a`` with some of the best filled containers of ``b`` injected whole."""
    load = np.bincount(b, weights=sizes)
    best = np.argsort(-load)[: max(1, len(load) // 2)]
    taken = rng.choice(best, size=max(1, len(best) // 4), replace=False)
    moved = np.isin(b, taken)
    hit = np.unique(a[moved])
    loose = np.isin(a, hit) & ~moved
    child = np.full(len(a), -1, np.int64)
    child[moved] = np.unique(b[moved], return_inverse=True)[1]
    k = len(np.unique(b[moved]))
    rest = ~moved & ~loose
    child[rest] = np.unique(a[rest], return_inverse=True)[1] + k
    count = child.max() + 1
    room = (capacity - np.bincount(child[child >= 0], weights=sizes[child >= 0], minlength=count)).astype(int).tolist()
    again = np.flatnonzero(loose)
    return best_fit(sizes, again[np.argsort(-sizes[again], kind="stable")], capacity, child, room)


def evolve(sizes: np.ndarray, capacity: int, start: list[np.ndarray], generations: int, population: int, seed: int) -> list[np.ndarray]:
    """The population after ``generations``, best first; stops at the fewest containers the total size allows."""
    rng = np.random.default_rng(seed)
    need = max(1, -(-int(sizes.sum()) // capacity))
    people = list(start)
    down = np.argsort(-sizes, kind="stable")
    while len(people) < population:
        # largest first, with some neighbours swapped in all packings but the first
        order = down if not people else down[np.argsort(np.arange(len(down)) + rng.uniform(0, len(down) / 8, len(down)))]
        people.append(best_fit(sizes, order, capacity, np.full(len(sizes), -1, np.int64), []))
        if len(np.unique(people[-1])) <= need:
            return people[-1:]
    rank = lambda p: (len(np.unique(p)), -fitness(sizes, p, capacity))
    people.sort(key=rank)
    for _ in range(generations):
        if len(np.unique(people[0])) <= need:
            break
        a, b = rng.choice(len(people), 2, replace=False)
        child = crossover(sizes, people[a], people[b], capacity, rng)
        if rank(child) < rank(people[-1]):
            people[-1] = child
            people.sort(key=rank)
    return people


def _island_epoch(capacity: int, generations: int, population: int, elites: int, seed: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block, island = key
        first = pdf.iloc[0]
        sizes = np.asarray(first["sizes"], np.int64)
        start = [np.asarray(p, np.int64) for p in first["elite"]] if first["elite"] is not None else []
        people = evolve(sizes, capacity, start, generations, population, seed * 1_000_003 + int(block) * 101 + int(island))[:elites]
        need = max(1, -(-int(sizes.sum()) // capacity))
        return pd.DataFrame({"block": block, "island": island, "rank": range(len(people)), "bins": [np.unique(p, return_inverse=True)[1].astype(np.int32) for p in people], "used": [len(np.unique(p)) for p in people], "need": need})

    return run


def _pack_blocks(items: DataFrame, capacity: int, blocks: int, islands: int, epochs: int, generations: int, population: int, elites: int, salt: int) -> DataFrame:
    """(item, part, n_tokens, block, bin) for all of ``items`` (item, part, n_tokens)."""
    block = F.pmod(F.xxhash64("item", "part", F.lit(salt)), F.lit(blocks)).cast("int")
    dealt = items.withColumn("block", block)
    # blocks hold a bounded number of items on average, dealt by a hash of their unique keys
    lists = written(dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("item", "part", "n_tokens"))).alias("xs")), "blocks")
    sizes = lists.select("block", F.transform("xs", lambda x: x["n_tokens"]).alias("sizes"))
    done: DataFrame | None = None
    elite = None
    for epoch in range(epochs):
        each = sizes.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
        if elite is None:
            each = each.withColumn("elite", F.lit(None).cast("array<array<int>>"))
        else:
            each = each.join(elite, ["block", "island"])
        run = _island_epoch(capacity, generations, population, elites, salt * 31 + epoch)
        state = written(each.repartition("block", "island").groupBy("block", "island").applyInPandas(run, STATE), "islands")
        best = state.groupBy("block").agg(F.min_by("bins", F.struct("used", "island", "rank")).alias("bins"), F.min("used").alias("used"), F.first("need").alias("need"))
        best = written(best if done is None else best.unionByName(done), "best-packings")
        done = best
        open_ = best.where("used > need").select("block")
        if epoch + 1 == epochs or open_.limit(1).count() == 0:
            break
        done = best.where("used <= need")
        sizes = sizes.join(open_, "block", "left_semi")
        moved = state.join(open_, "block", "left_semi").withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)))
        # each island keeps its own best and takes in its neighbour's
        kept = state.join(open_, "block", "left_semi").where("rank = 0").unionByName(moved)
        elite = kept.groupBy("block", "island").agg(F.collect_list("bins").alias("elite"))
    assert done is not None
    packed = lists.join(done.select("block", "bins"), "block").select("block", F.explode(F.arrays_zip("xs", "bins")).alias("z"))
    return packed.select("z.xs.item", "z.xs.part", "z.xs.n_tokens", "block", F.col("z.bins").alias("bin"))


def fill_containers(
    sizes: DataFrame,
    capacity: int,
    block_items: int = 1_000,
    islands: int = 2,
    epochs: int = 3,
    generations: int = 40,
    population: int = 6,
    elites: int = 2,
    full: float = 0.97,
    rounds: int = 3,
) -> DataFrame:
    """(item, part, n_tokens, container): ``sizes`` (item, n_tokens) in containers of at most ``capacity``.

    An item larger than a container fills whole ones with its first parts, and its last part is packed like an item;
    all others are part 0 and stay whole. Null and zero sizes are items of size 0 and have their container too;
    repeated items count as one, with the largest size. Containers filled less than ``full`` are emptied and their
    items packed anew over larger parts of the collection, up to ``rounds`` times. An empty table gives no row.
    """
    each = sizes.groupBy("item").agg(F.coalesce(F.max("n_tokens"), F.lit(0)).cast("int").alias("n"))
    over = F.greatest(F.lit(0), F.ceil(F.col("n") / capacity) - 1).cast("int")
    # written once, so that what the sizes are counted from is read once
    parts = written(each.select("item", "n", over.alias("whole")), "sizes")
    whole = parts.where("whole > 0").select("item", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("part"), F.lit(capacity).alias("n_tokens"))
    full_bins = whole.withColumn("container", F.concat_ws("-", F.lit("w"), F.col("item").cast("string"), F.col("part").cast("string")))
    pool = written(parts.select("item", F.col("whole").alias("part"), (F.col("n") - F.col("whole") * capacity).alias("n_tokens")), "items")
    out = full_bins.select("item", "part", "n_tokens", "container")
    for turn in range(rounds):
        count = pool.count()
        if count == 0:
            break
        blocks = max(1, -(-count // block_items))
        packed = written(_pack_blocks(pool, capacity, blocks, islands, epochs, generations, population, elites, turn + 1), "packed")
        named = packed.withColumn("container", F.concat_ws("-", F.lit(f"b{turn}"), F.col("block").cast("string"), F.col("bin").cast("string")))
        load = named.groupBy("container").agg(F.sum("n_tokens").alias("load"))
        last = turn + 1 == rounds or blocks == 1
        ready = load if last else load.where(F.col("load") >= full * capacity)
        out = out.unionByName(named.join(ready.select("container"), "container", "left_semi").select("item", "part", "n_tokens", "container"))
        if last:
            break
        pool = written(named.join(load.where(F.col("load") < full * capacity).select("container"), "container", "left_semi").select("item", "part", "n_tokens"), "items")
    return out
