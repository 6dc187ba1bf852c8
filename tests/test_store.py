"""Stored tables: runs, pointer, repeated and failed publications, pushdown."""

import tempfile

import pytest
from pyspark.sql import functions as F

from shelfcast.sources.store import TableStore, fingerprint


@pytest.fixture()
def store(spark):
    return TableStore(spark, tempfile.mkdtemp(prefix="shelfcast-test-"))


def _table(spark, n, shift=0):
    return spark.range(n).select("id", (F.col("id") + shift).alias("v"), (F.col("id") % 3 + 202001).cast("int").alias("month"))


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_readers_follow_the_newest_complete_run(spark, store):
    with pytest.raises(LookupError):
        store.read("recs")
    store.publish(_table(spark, 9), "recs", "a", ("month",))
    store.publish(_table(spark, 9, 100), "recs", "b", ("month",))
    assert _rows(store.read("recs")) == _rows(_table(spark, 9, 100)) and _rows(store.read("recs", "a")) == _rows(_table(spark, 9))
    with pytest.raises(Exception):
        store.publish(_table(spark, 9).withColumn("v", F.raise_error(F.lit("broken"))), "recs", "c", ("month",))
    assert _rows(store.read("recs")) == _rows(_table(spark, 9, 100)) and not store.has("recs", "c")


def test_repeated_and_empty_runs(spark, store):
    store.publish(_table(spark, 6), "recs", "a", ("month",))
    store.publish(_table(spark, 6, 7), "recs", "a", ("month",))
    assert _rows(store.read("recs", "a")) == _rows(_table(spark, 6, 7))
    store.publish(_table(spark, 0), "recs", "none", ("month",))
    assert store.read("recs").count() == 0 and store.read("recs").columns == ["id", "v", "month"]
    built = []
    get = lambda: store.stored("recs", "d", lambda: built.append(1) or _table(spark, 2), ("month",))
    assert get().count() == get().count() == 2 and built == [1]


def test_filters_reach_files_and_partitions(spark, store):
    store.publish(_table(spark, 30), "recs", "a", ("month",))
    plan = store.read("recs").where("month = 202002 AND id > 3")._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("PartitionFilters"):]
    assert "month" in scan.split("]")[0] + scan.split("]")[1] and "GreaterThan(id,3)" in plan


def test_old_runs_can_go(spark, store):
    for r in "abc":
        store.publish(_table(spark, 3), "recs", r, ("month",))
    assert store.keep_newest("recs", 2) == 1
    assert store.read("recs", "a").count() == 0 and store.read("recs", "b").count() == 3


def test_fingerprint_follows_the_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    first = fingerprint({"t": spark.read.parquet(path)}, "x")
    assert first == fingerprint({"t": spark.read.parquet(path)}, "x") != fingerprint({"t": spark.read.parquet(path)}, "y")
    spark.range(5).write.mode("append").parquet(path)
    assert fingerprint({"t": spark.read.parquet(path)}, "x") != first
