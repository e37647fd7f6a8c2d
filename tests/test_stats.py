"""Summary statistics, frequency tables, histogram, density, outliers, Mahalanobis — against NumPy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialstats.functions.distributions import chi2_quantile, t975, t_quantile
from trialstats.operators import outliers as O
from trialstats.operators import stats as S


def test_t_and_chi2_quantiles():
    assert t_quantile(0.975, 1) == pytest.approx(12.706204736, abs=1e-8)
    assert t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert chi2_quantile(0.999, 3) == pytest.approx(16.266236196, abs=1e-7)


def test_t975_column_branches(spark):
    df = spark.createDataFrame([(0,), (1,), (30,), (100,), (101,), (5000,)], "nu int")
    got = [r.t for r in df.select(t975(F.col("nu")).alias("t")).collect()]
    assert got[0] is None
    for nu, t in zip([1, 30, 100, 101, 5000], got[1:]):
        assert t == pytest.approx(t_quantile(0.975, nu), abs=1e-8)


def test_summary_full_matches_numpy(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 400), "x": rng.normal(1, 2, 400)})
    pdf.loc[::17, "x"] = np.nan
    st = {r.g: r for r in S.summary_stats(spark.createDataFrame(pdf), ["g"], ["x"], kind="full").collect()}
    for g, part in pdf.groupby("g"):
        x = part["x"].dropna().to_numpy()
        n = len(x)
        med = np.median(x)
        sd = x.std(ddof=1)
        r = st[g]
        assert r.n == n and r.variable == "x"
        assert r.median == pytest.approx(round(med, 3), abs=1e-3)
        assert r.q1 == pytest.approx(np.quantile(x, 0.25), abs=1e-3)
        assert r.mad == pytest.approx(1.4826 * np.median(np.abs(x - med)), abs=1e-3)
        assert r.sd == pytest.approx(sd, abs=1e-3)
        assert r.ci == pytest.approx(t_quantile(0.975, n - 1) * sd / math.sqrt(n), abs=1e-3)


def test_freq_table_nested_percent(spark):
    df = spark.createDataFrame([("m", "a")] * 3 + [("m", "b")] + [("f", "a")] * 2 + [("f", None)], "k string, t string")
    got = {(r.k, r.t): (r.n, r.prop) for r in S.freq_table(df, ["k", "t"]).collect()}
    assert got == {("m", "a"): (3, 75.0), ("m", "b"): (1, 25.0), ("f", "a"): (2, 100.0)}


def test_histogram_centres_on_multiples(spark):
    df = spark.createDataFrame([(0.04,), (0.06,), (0.14,), (0.26,)], "x double")
    got = sorted((r.bin, r["count"]) for r in S.histogram(df, "x", binwidth=0.1).collect())
    assert got == [(0, 1), (1, 2), (3, 1)]


def test_density_close_to_exact_kde(spark):
    rng = np.random.default_rng(7)
    x = rng.gamma(3, 0.2, 2000)
    out = S.density(spark.createDataFrame(pd.DataFrame({"x": x})), "x").toPandas().sort_values("point")
    q1, q3 = np.quantile(x, [0.25, 0.75])
    bw = 0.9 * min(x.std(ddof=1), (q3 - q1) / 1.34) * len(x) ** -0.2
    g = out["x"].to_numpy()
    exact = np.exp(-0.5 * ((g[:, None] - x[None, :]) / bw) ** 2).sum(1) / (len(x) * bw * math.sqrt(2 * math.pi))
    assert len(out) == 512
    assert np.max(np.abs(out["density"].to_numpy() - exact)) < 2e-3
    assert np.trapezoid(out["density"], g) == pytest.approx(1.0, abs=1e-2)


def test_identify_outliers(spark):
    vals = [1.0, 2.0, 2.0, 3.0, 3.0, 4.0, 30.0, 9.0]
    df = spark.createDataFrame([("g", v) for v in vals] + [("h", 1.0)], "k string, x double")
    got = {r.x: (r.is_outlier, r.is_extreme) for r in O.identify_outliers(df, ["k"], "x").collect()}
    q1, q3 = np.quantile(vals, [0.25, 0.75])
    iqr = q3 - q1
    want = {v: (True, bool(v > q3 + 3 * iqr or v < q1 - 3 * iqr)) for v in vals if v > q3 + 1.5 * iqr or v < q1 - 1.5 * iqr}
    assert got == want


def test_mahalanobis_matches_numpy(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame(rng.normal(size=(300, 3)) @ np.array([[1, 0.3, 0], [0, 1, 0.5], [0, 0, 1]]),
                       columns=["a", "b", "c"])
    pdf["k"] = np.arange(300) % 2
    got = O.mahalanobis(spark.createDataFrame(pdf), ["a", "b", "c"], ["k"], digits=9).toPandas()
    for k, part in pdf.groupby("k"):
        x = part[["a", "b", "c"]].to_numpy()
        d = x - x.mean(0)
        want = np.einsum("ij,jk,ik->i", d, np.linalg.inv(np.cov(x, rowvar=False)), d)
        mine = got[got.k == k].sort_values("a")["mahal_dist"].to_numpy()
        order = np.argsort(part["a"].to_numpy())
        assert np.allclose(mine, want[order], atol=1e-6)


def _sums(pdf):
    return pd.DataFrame({"g": [pdf["g"].iloc[0]], "n": [len(pdf)], "s": [float(pdf["x"].sum())]})


def test_apply_per_group_split_equals_whole(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.choice([1, 2, 3], 2000, p=[0.8, 0.1, 0.1]), "x": rng.normal(size=2000),
                        "i": np.arange(2000)})
    df = spark.createDataFrame(pdf)
    whole = {r.g: (r.n, round(r.s, 9)) for r in O.apply_per_group(df, ["g"], _sums, "g long, n long, s double").collect()}
    split = O.apply_per_group(df, ["g"], _sums, "g long, n long, s double", split=F.floor(F.col("i") / 100),
                              combine={"n": F.sum("n"), "s": F.sum("s")})
    assert {r.g: (r.n, round(r.s, 9)) for r in split.collect()} == whole


def test_order_statistics_of_a_hot_group(spark):
    """Ties, a group that holds most rows, a null group, NaN-free doubles of all signs: equal to NumPy, whatever the number of ranges."""
    from trialstats.operators.selection import order_statistics
    from trialstats.operators.sequence import RANGES_CONF
    rng = np.random.default_rng(2)
    hot = np.concatenate([rng.normal(size=3000), np.full(2000, 0.25), rng.integers(-3, 4, 1000) * 1e9])
    data = {"hot": hot, None: rng.normal(size=7), "one": np.array([4.0]), "two": np.array([-1.0, 2.0])}
    rows = [(g, float(v)) for g, x in data.items() for v in x] + [("none", None), ("hot", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.77, "e": 1.0}
    for ranges in ("1", "30"):
        spark.conf.set(RANGES_CONF, ranges)
        try:
            got = {r["g"]: r for r in order_statistics(df, ["g"], F.col("x"), probs, {"n": F.count("_qs_value")}, mad="mad").collect()}
        finally:
            spark.conf.unset(RANGES_CONF)
        assert set(got) == set(data)
        for g, x in data.items():
            assert got[g]["n"] == len(x)
            assert [got[g][k] for k in probs] == pytest.approx(np.quantile(x, list(probs.values())).tolist(), abs=1e-6)
            assert got[g]["mad"] == pytest.approx(np.median(np.abs(x - np.median(x))), abs=1e-9)
    assert order_statistics(df.limit(0), ["g"], F.col("x"), probs, mad="mad").collect() == []


def test_summary_reads_its_table_once(spark, tmp_path, monkeypatch):
    """The full summary, median deviation included, scans its input for the counts only."""
    from trialstats.operators import sequence
    path = str(tmp_path / "t")
    spark.range(500).selectExpr("id % 3 AS g", "cast(id % 101 AS double) AS x").write.parquet(path)
    written = []
    kept = sequence.bucketed
    monkeypatch.setattr(sequence, "bucketed", lambda df, *a: written.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df, *a))
    out = S.summary_stats(spark.read.parquet(path), ["g"], ["x"], kind="full")
    assert [p.count("Relation [g") for p in written] == [1, 0]
    assert "percentile" not in "".join(written) + out._jdf.queryExecution().optimizedPlan().toString()
    assert len(out.collect()) == 3


def test_density_counts_every_value(spark):
    """Values hundreds of bandwidths apart, ties, and one far outlier: equal to the sum of all kernels."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=400), np.full(300, 2.5), rng.normal(50, 0.1, 200), [400.0]])
    out = S.density(spark.createDataFrame(pd.DataFrame({"x": x})), "x").toPandas().sort_values("point")
    q1, q3 = np.quantile(x, [0.25, 0.75])
    bw = 0.9 * min(x.std(ddof=1), (q3 - q1) / 1.34) * len(x) ** -0.2
    exact = np.exp(-0.5 * ((out["x"].to_numpy()[:, None] - x[None, :]) / bw) ** 2).sum(1) / (len(x) * bw * math.sqrt(2 * math.pi))
    assert np.max(np.abs(out["density"].to_numpy() - exact)) < 1e-6


def test_mahalanobis_without_keys_moves_no_row(spark):
    """Statistics of all rows are a scalar: no join, so no task gets all rows and no row is dealt by a salt."""
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(size=(200, 2)) @ np.array([[1, 0.4], [0, 1]]), columns=["a", "b"])
    found = O.mahalanobis(spark.createDataFrame(pdf), ["a", "b"], digits=9)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    x = pdf.to_numpy()
    d = x - x.mean(0)
    want = np.einsum("ij,jk,ik->i", d, np.linalg.inv(np.cov(x, rowvar=False)), d)
    got = found.toPandas().sort_values("a")["mahal_dist"].to_numpy()
    assert np.allclose(got, want[np.argsort(pdf["a"].to_numpy())], atol=1e-6)
    assert O.mahalanobis(spark.createDataFrame(pdf).limit(0), ["a", "b"]).count() == 0


def test_group_statistics_never_make_the_rows_the_broadcast_side(spark):
    rows = spark.createDataFrame([(k, float(i)) for k in (1, None) for i in range(20)], "k int, a double")
    found = O.identify_outliers(rows, ["k"], "a")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in found


def test_statistics_of_many_groups_stay_off_the_driver(spark):
    """Written statistics look small to the planner; repeated for each salt, a broadcast of them filled the driver."""
    from trialstats.operators.joins import join_group_stats
    from trialstats.session import materialize
    group = lambda g: F.struct(F.when(g > 0, g).alias("g")).alias("k")  # noqa: E731  a null group too
    stats = materialize(spark.range(100_000).select(group(F.col("id")), F.col("id").cast("double").alias("m")), "stats")
    rows = spark.range(200_001).select(group(F.col("id") % 100_000), "id")
    for some, broadcast in ((stats, False), (stats.where("m < 50"), True)):  # few are broadcast, once each
        joined = join_group_stats(rows, some, "k")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan, "Generate" in plan) == (broadcast, not broadcast)
        assert joined.columns == ["k", "id", "m"] and joined.count() == 200_001
        assert joined.where("NOT m <=> if(m IS NULL, null, cast(id % 100000 AS double))").count() == 0
        assert joined.where("m IS NOT NULL").count() == (101 if broadcast else 200_001)


def test_quantiles_and_median_deviation_are_joined_off_the_driver(spark):
    """Both sides have a row for each group, so neither is broadcast by the planner's guess."""
    from trialstats.operators.selection import order_statistics
    data = {g: [float(g or 0), float(-(g or 0)), 0.5 * i] for i, g in enumerate([None, *range(1, 40)])}
    df = spark.createDataFrame([(g, v) for g, x in data.items() for v in x], "g int, x double")
    found = order_statistics(df, ["g"], F.col("x"), {"q2": 0.5}, {"n": F.count("_qs_value")}, mad="mad")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "_qs_group" in x]
    got = {r["g"]: (r["n"], r["q2"], r["mad"]) for r in found.collect()}
    assert got == {g: (3, np.median(x), np.median(np.abs(np.array(x) - np.median(x)))) for g, x in data.items()}
