"""One test per R rule of SURVEY §1.5 that differs from a Spark default."""

import pytest
from pyspark.sql import functions as F

from trialstats.functions import scalars as X
from trialstats.operators import columns as P
from trialstats.operators import joins as J
from trialstats.operators import missing as N
from trialstats.operators import reshape as R
from trialstats.operators import stats as S


def test_rule1_mean_without_na_rm_propagates(spark):
    df = spark.createDataFrame([(1, 0.5), (1, None), (2, 0.2), (2, 0.4)], "id int, v double")
    out = {r.id: r.m for r in J.with_group_mean(df, ["id"], {"m": "v"}).collect()}
    assert out[1] is None and out[2] == pytest.approx(0.3)


def test_rule2_row_sum(spark):
    df = spark.createDataFrame([(1, None), (2, 3)], "a int, b int")
    r = df.select(X.row_sum(["a", "b"]).alias("s"), X.row_sum(["a", "b"], na_rm=True).alias("t")).collect()
    assert [(x.s, x.t) for x in r] == [(None, 1), (5, 5)]


def test_rule3_zero_over_zero_is_missing(spark):
    r = spark.range(1).select(X.safe_divide(F.lit(0), F.lit(0)).alias("x"), X.safe_divide(F.lit(1), F.lit(0)).alias("y")).first()
    assert r.x is None and r.y is None


def test_rule4_round_half_even(spark):
    r = spark.range(1).select(X.round_half_even(F.lit(0.0625), 3).alias("a"), X.round_half_even(F.lit(2.5)).alias("b")).first()
    assert r.a == 0.062 and r.b == 2.0


def test_rule5_join_matches_null_keys(spark):
    l = spark.createDataFrame([(1, None, "x"), (2, 5, "y")], "id int, b int, lv string")
    r = spark.createDataFrame([(1, None, "R1"), (2, 5, "R2")], "id int, b int, rv string")
    got = sorted((x.id, x.rv) for x in J.left_join_common(l, r).collect())
    assert got == [(1, "R1"), (2, "R2")]


def test_rule6_integer_casts(spark):
    df = spark.createDataFrame([("",), ("1.0",), ("2.7",), ("x",), (None,)], "s string")
    assert [r.i for r in df.select(X.to_int("s").alias("i")).collect()] == [None, 1, 2, None, None]


def test_rule7_8_filters_drop_missing(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "s string")
    assert df.where(F.col("s") != "a").count() == 1
    assert df.where(X.not_in("s", ["a"])).count() == 1


def test_rule9_case_insensitive_matching(spark):
    df = spark.createDataFrame([(1, 2, 3)], "timeBreak1 int, TIMEBREAK2 int, other int")
    assert P.matching(df, "timebreak") == ["timeBreak1", "TIMEBREAK2"]


def test_rule10_modulo_of_negatives(spark):
    r = spark.range(1).select(X.rmod(F.lit(-3), 4).alias("m")).first()
    assert r.m == 1


def test_rule11_unite_all_missing_is_empty(spark):
    df = spark.createDataFrame([(None, None), ("a", None), ("a", "b")], "x string, y string")
    assert [r.u for r in df.select(X.unite(["x", "y"]).alias("u")).collect()] == ["", "a", "ab"]


def test_rule12_sd_of_one_value_is_missing(spark):
    df = spark.createDataFrame([("g", 1.0)], "k string, v double")
    r = S.summary_stats(df, ["k"], ["v"]).first()
    assert r.n == 1 and r.sd is None and r.se is None and r.ci is None


def test_rule13_quantiles_type7(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 10]], "v double")
    r = S.summary_stats(df, [], ["v"], kind="full").first()
    assert (r.q1, r.median, r.q3, r.iqr) == (2.0, 3.0, 4.0, 2.0)


def test_rule14_dotted_names_are_cleaned(spark):
    df = spark.createDataFrame([(1,)], "`both_loc_cb1_mix.keys` int")
    assert P.clean_names(df).columns == ["both_loc_cb1_mix_keys"]


def test_rule15_pivot_renames_by_level(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 0, 7)], "id int, sw int, n long")
    w = R.pivot_wider(df, ["id"], "sw", "n", [0, 1], names={0: "stay", 1: "switch"}).first()
    assert (w.stay, w.switch) == (7, 5)


def test_zero_fill_turns_nan_to_zero(spark):
    df = spark.createDataFrame([(float("nan"), None)], "a double, b long")
    r = N.zero_fill(df).first()
    assert r.a == 0.0 and r.b == 0
