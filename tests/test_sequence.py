"""Ordered scans: equal to plain windows for every scan kind, and truly cut whatever the order column holds."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trialstats.operators.sequence import RANGES_CONF, RANGE_BYTES_CONF, first_per, ordered_scan, range_count, ranged


def _data(spark, n=600, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = rnd.choice([1, 1, 1, 2, 3, None])           # one hot group, a null group
        v = rnd.choice(["a", "b", None])
        x = rnd.choice([0.0, 1.0, None])
        rows.append((g, i * 7 % 1000 + i / 10000.0, i, v, x))
    return spark.createDataFrame(rows, "g int, t double, eid long, v string, x double")


@pytest.fixture(params=["2", "40", "300"])
def ranges(spark, request):
    spark.conf.set(RANGES_CONF, request.param)
    yield int(request.param)
    spark.conf.unset(RANGES_CONF)


def _plain(df, desc=False):
    w = Window.partitionBy("g").orderBy(*[F.col(c).desc() if desc else F.col(c) for c in ("t", "eid")])
    if desc:
        return df.withColumn("rn", F.row_number().over(w))
    return df.withColumns({"prev": F.lag("v").over(w), "rn": F.row_number().over(w),
                           "cs": F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
                           "bf": F.first("v", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))})


def _scan(df, segment=None):
    return ordered_scan(df, ["g"], ["t", "eid"], lag={"prev": "v"}, row_number="rn",
                        running_sum={"cs": "x"}, fill_up={"bf": "v"}, segment=segment)


def _rows(df):
    return sorted(tuple(r) for r in df.select("eid", *[c for c in ("prev", "rn", "cs", "bf") if c in df.columns]).collect())


def test_scan_equals_plain_window(spark, ranges):
    df = _data(spark)
    assert _rows(_scan(df)) == _rows(_plain(df))


def test_given_segment(spark):
    df = _data(spark)
    for width in (1.0, 250.0, 5000.0):
        assert _rows(_scan(df, F.floor(F.col("t") / width))) == _rows(_plain(df))


def test_descending(spark, ranges):
    df = _data(spark, seed=2)
    assert _rows(ordered_scan(df, ["g"], ["t", "eid"], row_number="rn", descending=True)) == _rows(_plain(df, desc=True))
    with pytest.raises(ValueError):
        ordered_scan(df, ["g"], ["t"], lag={"p": "v"}, descending=True)


def test_types_and_empty_table(spark):
    df = _scan(_data(spark).limit(0))
    assert dict(df.dtypes)["rn"] == "bigint" and df.collect() == []


def test_hot_groups_are_cut(spark):
    """A burst, a tie and one hot group among groups of one row: no range holds many rows, and the ranges
    add at most one summary row for each cut."""
    burst = [(1, 1000.0 if i % 100 else float(i), i) for i in range(6000)]       # 99 % of the rows on one time
    tie = [(2, 5.0, 10_000 + i) for i in range(3000)]
    cold = [(100 + i, float(i), 20_000 + i) for i in range(3000)]
    df = spark.createDataFrame(burst + tie + cold, "g int, t double, eid long")
    spark.conf.set(RANGES_CONF, "101")
    try:
        cut = ranged(df, ["g"], ["t", "eid"], "s")
        parts = cut.groupBy("g", "s").count().collect()
        got = ordered_scan(df, ["g"], ["t", "eid"], row_number="rn")
    finally:
        spark.conf.unset(RANGES_CONF)
    assert max(r["count"] for r in parts) < 12_000 * 8 / 101
    assert len(parts) <= 3002 + 100
    w = Window.partitionBy("g").orderBy("t", "eid")
    assert sorted(map(tuple, got.select("eid", "rn").collect())) == sorted(map(tuple, df.select("eid", F.row_number().over(w)).collect()))


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange " in line]


def test_rows_are_exchanged_once(spark):
    """After the range exchange that writes the table, only summaries move: neither the windows nor a second scan move the rows."""
    df = ranged(_data(spark).withColumn("wide", F.lit("w")), ["g"], ["t", "eid"], "seg")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        once = ordered_scan(df, ["g"], ["t", "eid"], lag={"p": "v"}, segment=F.col("seg"))
        twice = ordered_scan(once, ["g"], ["t", "eid"], running_sum={"s": "x"}, segment=F.col("seg"))
        for scan in (once, twice):
            scan._jdf.queryExecution().assertAnalyzed()
            assert not any("wide" in line for line in _exchanges(scan))
            assert "hashpartitioning(_ts_seg" in "".join(_exchanges(scan))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ranges_follow_the_input(spark, tmp_path):
    """Ten times the rows of one hot user are cut into about ten times as many ranges."""
    parts = []
    for n in (20_000, 200_000):
        path = str(tmp_path / str(n))
        spark.range(n).selectExpr("7L AS g", "id AS t", "id AS eid", "hash(id) AS x").write.parquet(path)
        df = spark.read.parquet(path)
        spark.conf.set(RANGE_BYTES_CONF, "16384")
        try:
            ranges = range_count(df)
            sizes = [r["count"] for r in ranged(df, ["g"], ["t", "eid"], "s").groupBy("s").count().collect()]
        finally:
            spark.conf.unset(RANGE_BYTES_CONF)
        parts.append((ranges, max(sizes)))
    assert parts[1][0] > 6 * parts[0][0] and parts[1][1] < 2 * parts[0][1]
    assert range_count(_data(spark)) == spark.sparkContext.defaultParallelism  # unknown size


def test_first_per_is_deterministic(spark):
    df = _data(spark, seed=4)
    got = {r["g"]: r["eid"] for r in first_per(df, ["g"], ["t", "eid"]).collect()}
    pdf = df.toPandas().sort_values(["t", "eid"])
    want = {None if g != g else int(g): int(e) for g, e in pdf.groupby("g", dropna=False)["eid"].first().items()}
    assert {k if k is None else int(k): v for k, v in got.items()} == want


def test_rows_stay_where_they_are_with_few_ranges(spark):
    """Fewer ranges than shuffle partitions, and nothing small enough to be broadcast by size: the rows still do not move."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set(RANGES_CONF, "3")
    try:
        df = ranged(_data(spark).withColumn("wide", F.lit("w")), ["g"], ["t", "eid"], "seg")
        scan = ordered_scan(df, ["g"], ["t", "eid"], lag={"p": "v"}, segment=F.col("seg"))
        plan = scan._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    finally:
        spark.conf.unset(RANGES_CONF)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
