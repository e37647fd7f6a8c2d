"""Aggregations (A1-A16): counts, frequency tables, summary statistics, histogram, density.

All of them are ``groupBy`` aggregates with map-side partial aggregation, so a
group that holds a third of all rows is reduced inside each map task before
anything is shuffled. A grand total over an aggregated table is a scalar
subquery (no join, no single-partition window), and so are the one-row statistics
that parameterise a second pass (histogram width, density bandwidth). Quantiles come
from ``selection``, which writes the counts of the distinct values once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialstats.functions.distributions import t975
from trialstats.operators.selection import order_statistics
from trialstats.session import materialize

FULL = ("n", "min", "max", "median", "q1", "q3", "iqr", "mad", "mean", "sd", "se", "ci")
COMMON = ("n", "min", "max", "median", "iqr", "mean", "sd", "se", "ci")
MAD_SCALE = 1.4826  # constant of R's mad(): consistency factor for the normal distribution
DENSITY_TERMS = 18  # terms of the expansion of the kernel in a cell of the density


# ---------------------------------------------------------------- A1, A2, A10

def count_by(df: DataFrame, keys: Sequence[str | Column], name: str = "n") -> DataFrame:
    """A1 / A10: rows per group (``group_by %>% count()``, ``table``)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def count_by_expr(df: DataFrame, keys: Sequence[str], expr: Column, expr_name: str, name: str = "n",
                  keep: bool | None = True) -> DataFrame:
    """A2: ``count(flag = <expr>)`` per group, then keep rows where the flag is ``keep``."""
    out = df.groupBy(*keys, expr.alias(expr_name)).agg(F.count(F.lit(1)).alias(name))
    if keep is not None:
        out = out.where(F.col(expr_name) == F.lit(keep))
    return out


# ---------------------------------------------------------------- A8, A9

def freq_table(df: DataFrame, keys: Sequence[str], n: str = "n", prop: str = "prop") -> DataFrame:
    """Counts and percent (1 decimal) within all keys but the last; rows with a null key removed."""
    keys = list(keys)
    counts = df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    total = F.sum(n).over(Window.partitionBy(*keys[:-1])) if len(keys) > 1 else _grand_total(counts, n)
    return counts.withColumn(prop, F.bround(F.lit(100.0) * F.col(n) / total, 1))


def _grand_total(counts: DataFrame, n: str) -> Column:
    """The sum of ``n`` over a whole aggregated table as a scalar subquery, without a single-partition
    window (the table may have many rows); the exchange of the counts is reused."""
    return counts.select(F.sum(n)).scalar()


# ---------------------------------------------------------------- A11

def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row, for each column the number of nulls."""
    cols = list(cols or df.columns)
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])


# ---------------------------------------------------------------- A16

def share(cols: Sequence[str], of: Sequence[str] | None = None) -> dict[str, Column]:
    """Each count divided by the sum of counts (null when the sum is 0 or null)."""
    total = None
    for c in (of or cols):
        total = F.col(c) if total is None else total + F.col(c)
    return {c: F.try_divide(F.col(c).cast("double"), total.cast("double")) for c in cols}


# ---------------------------------------------------------------- A5, A6, A7, A12, A13

def _numeric_columns(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    num = ("int", "bigint", "double", "float", "smallint", "tinyint")
    return [c for c, t in df.dtypes if c not in exclude and (t in num or t.startswith("decimal"))]


def to_long(df: DataFrame, keys: Sequence[str], variables: Sequence[str], value: str = "value",
            variable: str = "variable") -> DataFrame:
    """Wide to long over numeric variables (values cast to double); used by ``summary_stats``."""
    return df.select(*keys, *[F.col(v).cast("double").alias(v) for v in variables]) \
             .unpivot(list(keys), list(variables), variable, value)


def summary_stats(
    df: DataFrame,
    keys: Sequence[str] = (),
    variables: Sequence[str] | None = None,
    kind: str = "common",
    digits: int = 3,
) -> DataFrame:
    """A5-A7 (rstatix ``get_summary_stats``): one row per group × variable, over non-null values.

    ``kind='full'``: n, min, max, median, q1, q3, iqr, mad, mean, sd, se, ci.
    ``kind='common'`` (the reference's default, U4): n, min, max, median, iqr, mean, sd, se, ci.
    Quantiles interpolate linearly (R type 7); ``mad`` = 1.4826 · median |x − median|;
    ``se`` = sd / √n; ``ci`` = t(0.975, n − 1) · se. Everything but ``n`` is rounded
    half-to-even to ``digits``. ``variables=None`` takes every numeric non-key column.
    The rows are read once, and quantiles are exact for groups of any size (``selection``).
    """
    keys = list(keys)
    if variables is None:
        variables = _numeric_columns(df, keys)
    long = to_long(df, keys, variables)
    v = F.col("_qs_value")
    moments = {"_n": F.count(v), "_min": F.min(v), "_max": F.max(v), "_mean": F.avg(v), "_sd": F.stddev_samp(v)}
    st = order_statistics(long, keys + ["variable"], F.col("value"), {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75}, moments,
                          mad="_mad" if kind == "full" else None)
    r = lambda c: F.bround(c, digits)
    se = F.col("_sd") / F.sqrt(F.col("_n"))
    out = {
        "n": F.col("_n"),
        "min": r(F.col("_min")), "max": r(F.col("_max")), "median": r(F.col("_q2")),
        "q1": r(F.col("_q1")), "q3": r(F.col("_q3")), "iqr": r(F.col("_q3") - F.col("_q1")),
        "mad": r(F.lit(MAD_SCALE) * F.col("_mad")) if kind == "full" else None,
        "mean": r(F.col("_mean")), "sd": r(F.col("_sd")), "se": r(se),
        "ci": r(t975(F.col("_n") - 1) * se),
    }
    names = FULL if kind == "full" else COMMON
    return st.select(*keys, "variable", *[out[k].alias(k) for k in names])


def with_error_bars(stats: DataFrame, k: float = 2.0, mean: str = "mean", se: str = "se") -> DataFrame:
    """``mean ± k·se`` columns ``lower`` and ``upper`` (the error bars of the plots)."""
    return stats.withColumns({
        "lower": F.bround(F.col(mean) - F.lit(k) * F.col(se), 3),
        "upper": F.bround(F.col(mean) + F.lit(k) * F.col(se), 3),
    })


# ---------------------------------------------------------------- A14, A15

def histogram(df: DataFrame, col: str, binwidth: float | None = None, bins: int = 30,
              keys: Sequence[str] = ()) -> DataFrame:
    """Counts per bin; bins are centred on multiples of the width (ggplot's default boundary).

    With ``binwidth=None`` the width is ``range / (bins − 1)`` (ggplot's rule), found
    by a scalar subquery. Output: keys..., ``bin`` (index), ``x`` (centre), ``count``,
    ``density`` (count / (N · width) within the keys).
    """
    keys = list(keys)
    x = F.col(col).cast("double")
    base = df.select(*keys, x.alias("_x")).where(F.col("_x").isNotNull())
    if binwidth is None:  # ggplot's width from the range, a scalar subquery
        width = base.select(((F.max("_x") - F.min("_x")) / F.lit(bins - 1)).alias("w")).scalar()
        w = F.coalesce(F.nullif(width, F.lit(0.0)), F.lit(1.0))
    else:
        w = F.lit(float(binwidth))
    base = base.withColumn("_bin", F.floor(F.col("_x") / w + F.lit(0.5)).cast("long"))
    idx = F.col("_bin")
    counts = base.groupBy(*keys, idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(*keys)) if keys else _grand_total(counts, "count")
    return counts.select(*keys, "bin", (F.col("bin") * w).alias("x"), "count",
                         (F.col("count") / (total * w)).alias("density"))


def bandwidth_nrd0(sd: Column, iqr: Column, n: Column) -> Column:
    """R ``bw.nrd0``: 0.9 · min(sd, iqr / 1.34) · n^(−1/5) (sd when the iqr is 0)."""
    lo = F.when(F.least(sd, iqr / 1.34) > 0, F.least(sd, iqr / 1.34)).otherwise(sd)
    return F.lit(0.9) * lo * F.pow(n.cast("double"), F.lit(-0.2))


def _hermite(terms: int) -> list[list[int]]:
    """Coefficients, by power, of the (probabilists') Hermite polynomials 0 .. terms - 1."""
    out = [[1], [0, 1]]
    for k in range(2, terms):
        up, last = [0, *out[-1]], out[-2]
        out.append([a - (k - 1) * b for a, b in zip(up, last + [0] * (len(up) - len(last)))])
    return out[:terms]


def density(df: DataFrame, col: str, points: int = 512, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density of ``col`` on ``points`` grid points (R ``density`` defaults).

    The rule-of-thumb bandwidth and the grid (min − cut·bw … max + cut·bw) come from the exact quartiles and
    moments. Then one pass: the values are summed up in cells of one bandwidth, each cell by the first
    ``DENSITY_TERMS`` moments of its values around its centre, and a cell adds to a grid point the kernel's
    Taylor expansion around the centre (Hermite polynomials). With values at most half a bandwidth off the centre and
    |He_k(t)| · exp(−t²/4) ≤ 1.09 √k!, the terms left out are below 1.2 · 0.5^18 / √18! < 1e-13 of a kernel's peak for
    each value. Every value counts at every point; the work after the pass is cells × points.
    """
    x = F.col(col).cast("double")
    base = materialize(df.select(x.alias("_x")).where(F.col("_x").isNotNull()), "density")  # read for the statistics and for the cells
    v = F.col("_qs_value")
    st = order_statistics(base, [], F.col("_x"), {"q1": 0.25, "q3": 0.75},
                          {"n": F.count(v), "lo": F.min(v), "hi": F.max(v), "sd": F.stddev_samp(v)})
    st = st.withColumn("bw", bandwidth_nrd0(F.col("sd"), F.col("q3") - F.col("q1"), F.col("n")))
    start, end = F.col("lo") - cut * F.col("bw"), F.col("hi") + cut * F.col("bw")
    grid = st.select(F.struct("n", "bw", start.alias("start"), ((end - start) / (points - 1)).alias("step")).alias("grid")).scalar()
    g = {c: F.col(f"_grid.{c}") for c in ("n", "bw", "start", "step")}
    cells = base.withColumn("_grid", grid).where(g["bw"] > 0)
    cells = cells.select("_grid", F.floor(F.col("_x") / g["bw"]).alias("cell"), (F.col("_x") / g["bw"]).alias("u"))
    off = F.col("u") - F.col("cell") - 0.5
    cells = cells.groupBy("cell").agg(F.first("_grid").alias("_grid"), *[F.sum(F.pow(off, F.lit(float(k))) if k else F.lit(1.0)).alias(f"m{k}") for k in range(DENSITY_TERMS)])
    # the sum over k of m_k / k! · He_k(t) as one polynomial in t
    polys, factorial, power = _hermite(DENSITY_TERMS), 1.0, [[] for _ in range(DENSITY_TERMS)]
    for k, poly in enumerate(polys):
        factorial *= max(k, 1)
        for j, c in enumerate(poly):
            if c:
                power[j].append(F.col(f"m{k}") * F.lit(c / factorial))
    cells = cells.select("cell", "_grid", *[sum(terms[1:], terms[0]).alias(f"c{j}") for j, terms in enumerate(power)])
    at = cells.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = at.withColumn("t", (g["start"] + F.col("point") * g["step"]) / g["bw"] - F.col("cell") - 0.5)
    value = F.col(f"c{DENSITY_TERMS - 1}")
    for j in range(DENSITY_TERMS - 2, -1, -1):
        value = value * F.col("t") + F.col(f"c{j}")
    kernel = value * F.exp(F.lit(-0.5) * F.col("t") * F.col("t"))
    total = at.select("point", "_grid", kernel.alias("k")).groupBy("point").agg(F.sum("k").alias("k"), F.first("_grid").alias("_grid"))
    norm = g["n"] * g["bw"] * F.lit(2.5066282746310002)  # n · bw · sqrt(2π)
    return total.select("point", (g["start"] + F.col("point") * g["step"]).alias("x"), F.bround(F.col("k") / norm, 6).alias("density"))
