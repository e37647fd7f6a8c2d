"""Sinks: partitions replaced alone, bucketed results joined without an exchange, row parity inside the writing job."""

import os

import pytest
from pyspark.sql import functions as F

from trialstats.operators.joins import left_join
from trialstats.operators.reshape import with_order
from trialstats.sources.sinks import write_bucketed, write_summary, write_with_parity


def test_rerun_replaces_its_partitions_only(spark, tmp_path):
    path = str(tmp_path / "s")
    write_summary(spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, block string, x double"), path, partition_by=["block"])
    for _ in range(2):  # twice: the same table
        write_summary(spark.createDataFrame([(3, "b", 9.0)], "id int, block string, x double"), path, partition_by=["block"])
        got = sorted((r["id"], r["block"], r["x"]) for r in spark.read.parquet(path).collect())
        assert got == [(1, "a", 1.0), (3, "b", 9.0)]


def test_join_by_id_needs_no_exchange(spark, tmp_path):
    df = spark.range(1000).selectExpr("id % 50 AS id", "id AS x")
    one = write_bucketed(df, "sink_one", str(tmp_path / "one"), ["id"], 4)
    two = write_bucketed(df.groupBy("id").agg(F.sum("x").alias("s")), "sink_two", str(tmp_path / "two"), ["id"], 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = one.join(two, "id").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("s").alias("s"))
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        assert {r["n"] for r in out.collect()} == {20}
        again = write_bucketed(df.where("id < 10"), "sink_one", str(tmp_path / "one"), ["id"], 4)
        assert again.count() == 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_parity_fails_the_write(spark, tmp_path):
    a, b = spark.range(30).withColumn("x", F.lit(1)), spark.range(30).withColumn("y", F.lit(2))
    path = str(tmp_path / "out")
    spark.sparkContext.setJobGroup("parity", "parity")
    try:
        assert write_with_parity([a, b], lambda l, r: left_join(l, r, "id"), path) == 30
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("parity"))
        spark.sparkContext.setJobGroup("plain", "plain")
        left_join(a, b, "id").write.parquet(str(tmp_path / "plain"))
        assert jobs == len(spark.sparkContext.statusTracker().getJobIdsForGroup("plain"))  # no job of its own for the counts
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    with pytest.raises(AssertionError, match="30, 29"):
        write_with_parity([a, b.where("id > 0")], lambda l, r: left_join(l, r, "id"), path)
    assert spark.read.parquet(path).count() == 30 and os.listdir(tmp_path) == sorted(os.listdir(tmp_path)) and not any(n.startswith("_staged") for n in os.listdir(tmp_path))


def test_category_order_without_levels(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "c"), (5, "b"), (6, "")], "i int, c string")
    assert [r["c_order"] for r in with_order(df, "c").orderBy("i").collect()] == [3, 2, None, 4, 3, 1]
    assert [r["c_order"] for r in with_order(df, "c", reverse=True).orderBy("i").collect()] == [2, 3, None, 1, 2, 4]
    assert [r["c_order"] for r in with_order(df, "c", ["b", "a"]).orderBy("i").collect()] == [1, 2, None, 0, 1, 0]
    assert with_order(df.limit(0), "c").collect() == []
