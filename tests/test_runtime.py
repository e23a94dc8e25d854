"""Broadcast bounds and the tables of an application."""

import os

import pytest
from pyspark.sql import functions as F

from stockpot import runtime as R


def test_bounds_of_a_broadcast(spark):
    df = spark.range(50).select("id", F.repeat(F.lit("x"), 1000).alias("t"), F.array("id", "id").alias("a"))
    assert R.small_enough(df, 50) and not R.small_enough(df, 49)
    assert not R.small_enough(df, 50, most=40_000) and R.small_enough(df.select("id"), 50, most=40_000)
    assert R.small_enough(df.where("false"), 0)
    nulls = spark.createDataFrame([(None, None)], "t string, a array<int>")
    assert R.small_enough(nulls, 1, most=100)


def test_tables_to_drop_are_noted(spark):
    made = []
    R.written(spark.range(3), "some", made=made)
    assert len(made) == 1 and os.path.isdir(made[0].removeprefix("file://"))
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with pytest.raises(ZeroDivisionError), R.shuffles_dropped(spark):
        assert spark.conf.get(key) == "true"
        1 / 0
    assert spark.conf.get(key) == "false"


def test_written_tables_are_dropped(spark):
    df = R.written(spark.range(5), "some")
    assert df.count() == 5
    folder = R.own_dir(spark).removeprefix("file://")
    assert os.listdir(folder)
    R.drop_written(spark)
    assert not os.path.exists(folder)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master, _jsc = "spark://host:7077", spark.sparkContext._jsc

    class Session:
        conf, sparkContext = spark.conf, Context()

    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        assert R.shared_dir(Session())
    else:
        with pytest.raises(ValueError):
            R.shared_dir(Session())
