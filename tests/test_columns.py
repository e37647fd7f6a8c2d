"""Projection, reshape and category operators."""

from pyspark.sql import functions as F

from trialstats.operators import columns as P
from trialstats.operators import reshape as R


def _df(spark):
    return spark.createDataFrame([(1, "A", 2.5, "x", 7)], "a int, b string, c double, d string, e int")


def test_ranges_drop_relocate(spark):
    df = _df(spark)
    assert P.select_range(df, ("b", "d"), "a").columns == ["b", "c", "d", "a"]
    assert P.select_range(df, ("d", "b")).columns == ["d", "c", "b"]
    assert P.drop_columns(df, ("b", "c"), "e").columns == ["a", "d"]
    assert P.relocate(df, ["e"], before="b").columns == ["a", "e", "b", "c", "d"]
    assert P.relocate(df, ["a"], after="d").columns == ["b", "c", "d", "a", "e"]


def test_transform_where_by_type(spark):
    df = _df(spark)
    out = P.transform_where(df, F.lower, P.is_string).first()
    assert (out.b, out.d, out.a) == ("a", "x", 1)
    out = P.transform_where(df, lambda c: c * 2, P.is_numeric).first()
    assert (out.a, out.c, out.e) == (2, 5.0, 14)


def test_keep_unused(spark):
    df = _df(spark)
    out = P.mutate_keep_unused(df, "ae", F.col("a") + F.col("e"), ["a", "e"])
    assert out.columns == ["b", "c", "d", "ae"] and out.first().ae == 8


def test_category_order_and_labels(spark):
    df = spark.createDataFrame([("switch_loc",), ("stay_loc",), ("other",)], "t string")
    got = {r.t: r.t_order for r in R.with_order(df, "t", ["stay_loc", "switch_loc"]).collect()}
    assert got == {"stay_loc": 1, "switch_loc": 2, "other": 0}
    alpha = {r.t: r.t_order for r in R.with_order(df, "t").collect()}
    assert alpha == {"other": 1, "stay_loc": 2, "switch_loc": 3}
    lab = [r.l for r in df.select(R.relabel("t", {"stay_loc": "Easy repetition"}).alias("l")).collect()]
    assert lab == [None, "Easy repetition", None]


def test_complete_by_round_trip(spark):
    df = spark.createDataFrame([(1, "a", 3), (2, "b", 4)], "id int, k string, n long")
    out = sorted(map(tuple, R.complete_by_round_trip(df, ["id"], "k", "n", ["a", "b"]).collect()))
    assert out == [(1, "a", 3), (1, "b", 0), (2, "a", 0), (2, "b", 4)]
