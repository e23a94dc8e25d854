"""What the operators need of the cluster: a shared folder, written tables, joins that stand skew.

Tables that cut lineage are written below the folder that ``spark.checkpoint.dir`` names, which all executors share, so
that the loss of an executor costs a re-read and nothing else. Only where the setting is absent and Spark runs in one
process (tests, a local run) is a temporary folder made; on a cluster the setting must be there.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only if it has at most so many rows and so many bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20

_local: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in a local run where nothing is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    key = id(sc)
    if key not in _local:
        _local[key] = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, _local[key], True)
        sc.setCheckpointDir(f"file://{_local[key]}/checkpoints")
    return f"file://{_local[key]}"


def own_dir(spark: SparkSession) -> str:
    """The folder of this application's tables below the shared folder."""
    return f"{shared_dir(spark)}/stockpot/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_written(spark: SparkSession) -> None:
    """Delete the tables that this application has written, once no result that reads them is needed any more."""
    drop_path(spark, own_dir(spark))


def drop_path(spark: SparkSession, name: str) -> None:
    """Delete a table that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def _set(spark: SparkSession, key: str, value: str, default: str) -> Iterator[None]:
    was = spark.conf.get(key, default)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, was)


def shuffles_dropped(spark: SparkSession) -> AbstractContextManager[None]:
    """Within it a job's shuffle files are deleted as soon as it ends, not when the driver happens to collect its garbage."""
    return _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true", "false")


def short_batches(spark: SparkSession) -> AbstractContextManager[None]:
    """Within it jobs hand rows to Python in batches of at most 8 MB, for rows that are long."""
    return _set(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20), str(64 << 20))


def written(df: DataFrame, name: str, partition_by: list[str] | None = None, made: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps start from files, not from its lineage.

    The path is added to ``made``, for tables that are dropped before the application ends.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    if made is not None:
        made.append(path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _width(df: DataFrame) -> Column:
    """Bytes of a row, about: 8 for a value, the length of a text, and so for the items of an array."""
    width = F.lit(8 * len(df.columns))
    for c in df.schema:
        if isinstance(c.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(c.name), F.lit(0))
        elif isinstance(c.dataType, (T.ArrayType, T.MapType, T.StructType)):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(c.name))), F.lit(0))
    return width


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows of ``most`` bytes together; reads no further than one row beyond."""
    got = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(_width(df)), F.lit(0)).alias("b")).first()
    return got.n <= rows and got.b <= most


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its size allows it, else as it is: Spark then shuffles both sides.

    The size is counted, so ``df`` is best a table read from files; what is costly to derive is written first.
    """
    return F.broadcast(df) if small_enough(df, rows) else df


def hot_keys(df: DataFrame, key: str, share: float = 0.005, least: int = 100_000) -> DataFrame:
    """Keys with more than ``share`` of the rows (and ``least`` rows). There are at most 1/share of them."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = df.agg(F.count(F.lit(1)).alias("__all"))
    return (
        counts.crossJoin(F.broadcast(total))
        .where((F.col("__n") >= least) & (F.col("__n") > F.col("__all") * share))
        .select(key)
    )


def skew_left_join(left: DataFrame, right: DataFrame, key: str, share: float = 0.005, least: int = 100_000) -> DataFrame:
    """Left join on ``key`` where ``right`` has one row per key and some keys of ``left`` may hold much of its rows.

    Hot keys are found by a pre-aggregated count; at most 1/share keys can be hot, so their rows of ``right`` have a
    proven bound and are broadcast. All other rows are joined by a shuffle.
    """
    hot = hot_keys(left, key, share, least).withColumn("__hot", F.lit(True))
    hot = written(hot, "hot-keys")
    if hot.limit(1).count() == 0:
        return left.join(right, key, "left")
    marked = left.join(F.broadcast(hot), key, "left")
    cold = marked.where(F.col("__hot").isNull()).drop("__hot").join(right, key, "left")
    warm = right.join(F.broadcast(hot.select(key)), key, "left_semi")
    return cold.unionByName(marked.where("__hot").drop("__hot").join(F.broadcast(warm), key, "left"))


def spread(df: DataFrame) -> DataFrame:
    """A table read from files over at least as many partitions as there are cores, for work that is heavy for its bytes.

    Tables of many files have more and are left as they are; only small ones are dealt out anew.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
