"""References to records that do not exist: direct orphans by reason and period, and those that follow from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import skew_left_join, written


@dataclass(frozen=True)
class Reference:
    """``rows`` (row_id, ref_id, ref_time) of table ``child`` refer to table ``parent``, whose ids ``states`` tells.

    ``states`` may be None where the parent's rows are known only as the ``row_id`` of other references.
    """

    child: str
    rows: DataFrame
    parent: str
    states: DataFrame | None


def parent_states(parent: DataFrame, key: str, created: str, deletions: DataFrame | None = None, deleted_key: str = "") -> DataFrame:
    """(ref_id, since, present, deleted): one row for each id known to the parent table or its log of deletions."""
    known = parent.select(F.col(key).alias("ref_id"), F.col(created).alias("since"), F.lit(True).alias("p"), F.lit(False).alias("d"))
    if deletions is not None:
        gone = deletions.select(F.col(deleted_key).alias("ref_id"), F.lit(None).cast(dict(known.dtypes)["since"]).alias("since"), F.lit(False).alias("p"), F.lit(True).alias("d"))
        known = known.unionByName(gone)
    return known.where("ref_id is not null").groupBy("ref_id").agg(F.min("since").alias("since"), F.max("p").alias("present"), F.max("d").alias("deleted"))


def reference_faults(refs: DataFrame, states: DataFrame) -> DataFrame:
    """Rows of ``refs`` (ref_id, ref_time and others) whose reference fails, with ``reason``.

    ``deleted``: only in the log of deletions; ``missing``: nowhere; ``late``: the parent was created after the
    reference. Null references are none and give no row; without a reference time nothing is late. A parent that
    holds much of the references is joined apart (see :func:`skew_left_join`).
    """
    joined = skew_left_join(refs.where("ref_id is not null"), states, "ref_id")
    present, deleted = F.coalesce("present", F.lit(False)), F.coalesce("deleted", F.lit(False))
    reason = F.when(~present & deleted, "deleted").when(~present, "missing").when(F.col("since") > F.col("ref_time"), "late")
    return joined.withColumn("reason", reason).where("reason is not null").drop("since", "present", "deleted")


def orphan_cascade(references: list[Reference], max_rounds: int = 100) -> DataFrame:
    """(source_table, row_id, ref_id, ref_time, reason, cause, depth) of all failing references of a foreign-key graph.

    ``direct`` ones fail by themselves (see :func:`reference_faults`). References to a row that is itself an orphan
    (deleted or missing, not merely late) are ``inherited``: semi-joins go down the graph until a round finds no
    further row, so cycles end as well. A row of a table is reported as inherited only if no earlier round has it.
    Null references are none; repeated rows count once. Each round appends what it found to the shared folder. A graph
    deeper than ``max_rounds`` fails the job rather than giving a part of the orphans.
    """

    def rows(r: Reference) -> DataFrame:
        return r.rows.select(F.lit(r.child).alias("source_table"), "row_id", "ref_id", "ref_time").where("ref_id is not null").distinct()

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    direct = [reference_faults(rows(r), r.states) for r in references if r.states is not None]
    found = [written(union(direct).distinct().select("*", F.lit("direct").alias("cause"), F.lit(0).alias("depth")), "orphans")]
    children = {r.parent for r in references} & {r.child for r in references}
    new, depth = found[0].where("reason <> 'late'"), 0
    while children:
        depth += 1
        if depth > max_rounds:
            raise RuntimeError(f"inherited orphans are still found after {max_rounds} rounds")
        nexts = []
        for r in (r for r in references if r.parent in children):
            gone = new.where(F.col("source_table") == r.parent).select(F.col("row_id").alias("ref_id")).distinct()
            nexts.append(rows(r).join(gone, "ref_id", "left_semi"))
        known = union(found).where("reason <> 'late'").select("source_table", "row_id").distinct()
        fresh = union(nexts).distinct().join(known, ["source_table", "row_id"], "left_anti")
        fresh = fresh.select("*", F.lit("inherited").alias("reason"), F.lit("inherited").alias("cause"), F.lit(depth).alias("depth"))
        new = written(fresh.select(*found[0].columns), "orphans")
        if new.limit(1).count() == 0:
            break
        found.append(new)
    return union(found)
