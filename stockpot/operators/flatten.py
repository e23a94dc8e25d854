"""Deeply nested records as flat tables with parent-child links.

One pass over the records: a depth-first visitor emits a row for every entry of every declared list, tagged with its
table, its own key, its parent's key and its place. The rows are written once, partitioned by tag, and each table is
read back from its own partition with its own schema.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import new_path

#: The tag of rows that report a body nested too deeply to be read.
TOO_DEEP = "_too_deep"
EMITTED = "doc_key long, pk string, parent string, parent_pos long, pos long, text string, payload string, tag string"


@dataclass(frozen=True)
class Child:
    """A nested list: its field, the field of an entry that holds its text, and the lists within its entries."""

    name: str
    label: str
    lists: tuple["Child", ...] = field(default=())


def _object(body: str | None) -> dict | None:
    if body is None:
        return None
    try:
        value = json.loads(body)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def _visit(entries, child: Child, tag: str, parent: str, parent_pos: int, out: list) -> None:
    """Rows of ``entries`` and, right after each, of the lists below it. A single value stands for a list of one."""
    for pos, entry in enumerate(entries if isinstance(entries, list) else [entries], 1):
        if entry is None:
            continue
        pk = f"{parent}/{child.name}:{pos}"
        text, payload = (entry, None) if isinstance(entry, str) else (None, None)
        if isinstance(entry, dict):
            named = entry.get(child.label)
            text = named if isinstance(named, str) else None
            below = {c.name for c in child.lists}
            payload = json.dumps({k: v for k, v in entry.items() if k not in below}, ensure_ascii=False)
        out.append((pk, parent, parent_pos, pos, text, payload, tag))
        if isinstance(entry, dict):
            for c in child.lists:
                if entry.get(c.name) is not None:
                    _visit(entry[c.name], c, f"{tag}.{c.name}", pk, pos, out)


def emit_tagged(records: DataFrame, key: str, body: str, root: str, lists: tuple[Child, ...]) -> DataFrame:
    """All entries of all ``lists`` of the object ``root`` in the JSON text ``body``, in one pass (see EMITTED).

    The object may itself be given as JSON text. Bodies that are null, no complete JSON object, or without the object
    give nothing; null entries give no row but keep their place; a single value in place of a list is at place 1.
    A body nested too deeply for the reader gives one row of the tag ``TOO_DEEP``, so that it is not lost unseen.
    ``text`` is the entry where it is plain text, else its label where that is text. Further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in EMITTED.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for b in batches:
            keys, rows, size = b.column("k").to_pylist(), [], 0
            for k, text in zip(keys, b.column("b")):
                got: list = []
                try:
                    whole = _object(text.as_py())
                    inner = whole.get(root) if whole else None
                    inner = _object(inner) if isinstance(inner, str) else inner
                    for c in lists if isinstance(inner, dict) else ():
                        if inner.get(c.name) is not None:
                            _visit(inner[c.name], c, c.name, "", 0, got)
                except RecursionError:
                    got = [("", "", 0, 0, None, None, TOO_DEEP)]
                rows += [(k, *r) for r in got]
                if len(rows) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return records.select(F.col(key).cast("long").alias("k"), F.col(body).alias("b")).where("b is not null").mapInArrow(run, EMITTED)


def write_tagged(emitted: DataFrame, name: str = "tagged") -> str:
    """Write the emitted rows once, a folder for each tag; returns the path."""
    path = new_path(emitted.sparkSession, name)
    emitted.write.partitionBy("tag").option("compression", "zstd").parquet(path)
    return path


def read_tagged(spark: SparkSession, path: str, *tags: str) -> DataFrame:
    """The emitted rows of ``tags``: only their folders are read."""
    rows = spark.read.schema(T._parse_datatype_string(EMITTED)).parquet(path)
    return rows.where(F.col("tag").isin(*tags)) if tags else rows


def read_table(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """One flat table: its keys and place, and the payload by ``schema`` (fields it lacks are null)."""
    rows = read_tagged(spark, path, tag)
    return rows.select("doc_key", "pk", "parent", "pos", "text", F.from_json("payload", schema).alias("p")).select("doc_key", "pk", "parent", "pos", "text", "p.*")
