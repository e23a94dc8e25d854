"""Which unit a reading without one was recorded in: a hidden Markov model for each device.

The unit is the hidden state. Readings with a stated unit fix the state; between them Viterbi's algorithm weighs
staying in a unit against a switch, and how far the converted value jumps from the device's smooth level, both on a
logarithmic scale. Units of different bases (mass and volume) have a level each, and a switch leads to a base in
proportion to how often the device states it.

Since a stated unit fixes the state, the chain falls apart there: only the runs of unstated readings between two stated
ones are decoded, over the ends of periods as well. A run in several blocks is decoded exactly: each block gives the
best score between every state at its start and every state at its end, the blocks of a run are joined by these, and a
second pass decodes each block between the two states found.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import written


def _fits(values: np.ndarray, level: float | np.ndarray, factors: np.ndarray, sigma: float) -> np.ndarray:
    return -0.5 * ((np.log10(np.maximum(values, 1e-9))[:, None] + np.log10(factors)[None, :] - level) / sigma) ** 2


def _steps(k: int, stay: float, prior: np.ndarray | None) -> np.ndarray:
    """Logarithmic chances of going from a state to a state; a switch is shared out by ``prior``."""
    prior = np.full(k, 1 / k) if prior is None else prior
    step = np.log(1 - stay) + np.log(prior)[None, :] - np.log(np.maximum(1 - prior, 1e-12))[:, None]
    np.fill_diagonal(step, np.log(stay))
    return step


def viterbi(
    values: np.ndarray,
    level: float | np.ndarray,
    factors: np.ndarray,
    first: int,
    last: int,
    stay: float,
    sigma: float,
    prior: np.ndarray | None = None,
    own: tuple[int, int] | None = None,
) -> np.ndarray:
    """The likeliest state of each value; ``first`` and ``last`` are the states before and after, or -1.

    ``level`` is one for all states or one each. ``prior``: chances of the states at the start and, relative to each
    other, after a switch; equal if None. ``own`` fixes the states of the first and last value themselves.
    """
    n, k = len(values), len(factors)
    fit = _fits(values, level, factors, sigma)
    if own is not None:
        for t, state in ((0, own[0]), (n - 1, own[1])):
            fit[t, np.arange(k) != state] = -np.inf
    step = _steps(k, stay, prior)
    score = fit[0] + (step[first] if first >= 0 else 0 if prior is None else np.log(prior))
    back = np.zeros((n, k), np.int64)
    for t in range(1, n):
        ways = score[:, None] + step
        back[t] = ways.argmax(axis=0)
        score = ways.max(axis=0) + fit[t]
    if last >= 0:
        score = score + step[:, last]
    path = np.empty(n, np.int64)
    path[-1] = score.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def passage(values: np.ndarray, level: float | np.ndarray, factors: np.ndarray, stay: float, sigma: float, prior: np.ndarray | None = None) -> np.ndarray:
    """The best score of ``values`` for each state of the first one (rows) and of the last one (columns)."""
    fit, step = _fits(values, level, factors, sigma), _steps(len(factors), stay, prior)
    best = np.full((len(factors), len(factors)), -np.inf)
    np.fill_diagonal(best, fit[0])
    for t in range(1, len(values)):
        best = (best[:, :, None] + step[None]).max(axis=1) + fit[t]
    return best


def block_ends(passages: list[np.ndarray], first: int, last: int, stay: float, prior: np.ndarray | None = None) -> list[tuple[int, int]]:
    """The states of the first and last value of each block on the likeliest path through all blocks of a run."""
    k = len(passages[0])
    step = _steps(k, stay, prior)
    enter, score = [], step[first] if first >= 0 else np.zeros(k) if prior is None else np.log(prior)
    for p in passages:
        enter.append(score)
        leave = (score[:, None] + p).max(axis=0)
        score = (leave[:, None] + step).max(axis=0)
    ends, after = [], step[:, last] if last >= 0 else np.zeros(k)
    for p, score in zip(reversed(passages), reversed(enter)):
        ways = score[:, None] + p
        out = int((ways.max(axis=0) + after).argmax())
        into = int(ways[:, out].argmax())
        ends.append((into, out))
        after = step[:, into]
    return ends[::-1]


def decode_units(
    readings: DataFrame,
    units: dict[str, float],
    stay: float = 0.9,
    sigma: float = 0.5,
    block: int = 512,
    context: int = 32,
    bases: dict[str, str] | None = None,
) -> DataFrame:
    """(device, period, seq, value, unit, decoded): ``readings`` (device, period, seq, value, unit) with a unit each.

    ``units``: name -> size in its base unit; ``bases``: name -> base unit, one for all if None. ``seq`` follows
    ``period``. ``decoded`` is ``unit`` where stated. The level of a base is the mean logarithm of the device's stated
    readings of that base in the period and its neighbours, else of the device, else of all devices. Readings are cut
    by period and then into blocks of ``block``, so that a device with much of the rows is spread over tasks; of a run
    only the scores between block ends come together. Blocks are joined exactly, so ``context`` has no effect.
    Readings that aren't positive or have no device are left undecoded (null); ties go to the unit that comes first in
    ``units``.
    """
    names = list(units)
    factors = np.array([units[u] for u in names])
    groups = sorted({bases[u] for u in names}) if bases else [""]
    group = np.array([groups.index(bases[u]) if bases else 0 for u in names])
    mates = np.bincount(group, minlength=len(groups))[group]
    place = F.create_map(*[F.lit(x) for i, u in enumerate(names) for x in (u, i)])
    size = F.create_map(*[F.lit(x) for u in names for x in (u, float(np.log10(units[u])))])
    base = F.create_map(*[F.lit(x) for u, g in zip(names, group) for x in (u, int(g))])
    good = readings.where("device is not null and value > 0").withColumn("state", place[F.col("unit")])
    x, of = F.log10("value") + size[F.col("unit")], base[F.col("unit")]
    # a row for each device and period: as many as periods, whatever the number of readings
    months = good.groupBy("device", "period").agg(
        *(F.sum(F.when(of == g, x)).alias(f"s{g}") for g in range(len(groups))),
        *(F.count(F.when(of == g, x)).alias(f"n{g}") for g in range(len(groups))),
        F.count("state").alias("stated"),
        F.expr("min_by(state, seq) FILTER (WHERE state IS NOT NULL)").alias("head"),
        F.expr("max_by(state, seq) FILTER (WHERE state IS NOT NULL)").alias("tail"),
    )
    months = written(months, "unit-periods")
    total = lambda c, w=None: F.sum(c).over(w) if w is not None else F.sum(c)
    over_all = months.agg(
        *((total(f"s{g}") / F.nullif(total(f"n{g}"), F.lit(0))).alias(f"all{g}") for g in range(len(groups))),
        (total(sum(F.coalesce(f"s{g}", F.lit(0.0)) for g in range(len(groups)))) / F.nullif(total("stated"), F.lit(0))).alias("any"),
    )
    device = Window.partitionBy("device")
    near = device.orderBy("period").rangeBetween(-1, 1)
    earlier = device.orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    later = device.orderBy(F.col("period").desc()).rowsBetween(Window.unboundedPreceding, -1)
    mean = lambda g, w: total(f"s{g}", w) / F.nullif(total(f"n{g}", w), F.lit(0))
    levels = [F.coalesce(mean(g, near), mean(g, device), F.col(f"all{g}"), "any", F.lit(0.0)) for g in range(len(groups))]
    shares = [(total(f"n{g}", device) + 1) / (total("stated", device) + len(groups)) for g in range(len(groups))]
    carried = months.crossJoin(F.broadcast(over_all)).select(
        "device",
        "period",
        F.array(*levels).alias("level"),
        F.array(*shares).alias("share"),
        F.coalesce(total("stated", earlier), F.lit(0)).alias("offset"),
        F.last("tail", ignorenulls=True).over(earlier).alias("from"),
        F.last("head", ignorenulls=True).over(later).alias("to"),
        (F.row_number().over(device.orderBy("period")) == 1).alias("earliest"),
        (F.row_number().over(device.orderBy(F.col("period").desc())) == 1).alias("latest"),
    )
    part = Window.partitionBy("device", "period")
    runs = (
        good.withColumn("run", F.count("state").over(part.orderBy("seq")))
        .withColumn("before", F.last("state", ignorenulls=True).over(part.orderBy("seq")))
        .withColumn("after", F.last("state", ignorenulls=True).over(part.orderBy(F.col("seq").desc())))
    )
    within = Window.partitionBy("device", "period", "run")
    open_ = runs.where("state is null").withColumn("at", F.row_number().over(within.orderBy("seq")) - 1)
    cut = (
        open_.groupBy("device", "period", "run", F.floor(F.col("at") / block).alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("seq", "value"))).alias("items"), F.first("before").alias("before"), F.first("after").alias("after"))
        .join(carried, ["device", "period"])
    )
    # a block that another of its run may come before or after
    joint = (F.col("block") > 0) | (F.size("items") == block) | (F.col("before").isNull() & ~F.col("earliest")) | (F.col("after").isNull() & ~F.col("latest"))
    cut = cut.select(
        "device", "period", (F.col("offset") + F.col("run")).alias("run"), "block", "items", "level", "share",
        F.coalesce("before", "from").alias("before"), F.coalesce("after", "to").alias("after"), joint.alias("joint"),
    )
    cut = written(cut, "unit-blocks")

    def state(x: float) -> int:
        return int(x) if pd.notna(x) else -1

    def prior(share: np.ndarray) -> np.ndarray:
        return np.asarray(share, float)[group] / mates

    @F.pandas_udf("array<double>")
    def scores(values: pd.Series, level: pd.Series, share: pd.Series) -> pd.Series:
        return pd.Series([passage(np.asarray(v, float), np.asarray(x, float)[group], factors, stay, sigma, prior(s)).ravel() for v, x, s in zip(values, level, share)])

    @F.pandas_udf("array<array<int>>")
    def joined(passages: pd.Series, before: pd.Series, after: pd.Series, share: pd.Series) -> pd.Series:
        k = len(names)
        return pd.Series([
            [list(e) for e in block_ends([np.asarray(p, float).reshape(k, k) for p in ps], state(b), state(a), stay, prior(s))]
            for ps, b, a, s in zip(passages, before, after, share)
        ])

    @F.pandas_udf("array<int>")
    def path(values: pd.Series, level: pd.Series, share: pd.Series, before: pd.Series, after: pd.Series, into: pd.Series, out: pd.Series) -> pd.Series:
        return pd.Series([
            viterbi(np.asarray(v, float), np.asarray(x, float)[group], factors, state(b), state(a), stay, sigma, prior(s), (int(i), int(o)) if pd.notna(i) else None)
            for v, x, s, b, a, i, o in zip(values, level, share, before, after, into, out)
        ])

    values = F.transform("items", lambda i: i["value"])
    before, after = F.col("before").cast("double"), F.col("after").cast("double")
    passed = cut.where("joint").select("device", "run", "period", "block", "before", "after", "share", scores(values, "level", "share").alias("passage"))
    chains = passed.groupBy("device", "run").agg(
        F.sort_array(F.collect_list(F.struct("period", "block", "passage"))).alias("parts"), F.first("before").alias("before"), F.first("after").alias("after"), F.first("share").alias("share")
    )
    chains = chains.where(F.size("parts") > 1).withColumn("ends", joined(F.col("parts.passage"), before, after, F.col("share")))
    each = chains.select("device", "run", F.explode(F.arrays_zip("parts", "ends")).alias("z"))
    ends = each.select("device", "run", F.col("z.parts.period").alias("period"), F.col("z.parts.block").alias("block"), F.col("z.ends")[0].alias("into"), F.col("z.ends")[1].alias("out"))
    done = cut.join(ends, ["device", "run", "period", "block"], "left")
    done = done.withColumn("path", path(values, F.col("level"), F.col("share"), before, after, F.col("into").cast("double"), F.col("out").cast("double")))
    each = done.select("device", "period", F.explode(F.arrays_zip("items", "path")).alias("z"))
    at = F.element_at(F.array(*[F.lit(u) for u in names]), F.col("z.path") + 1)
    decoded = each.select("device", "period", F.col("z.items.seq").alias("seq"), at.alias("guess"))
    return (
        readings.join(decoded, ["device", "period", "seq"], "left")
        .withColumn("decoded", F.when(F.col("unit").isin(names), F.col("unit")).otherwise(F.col("guess")))
        .select("device", "period", "seq", "value", "unit", "decoded")
    )
