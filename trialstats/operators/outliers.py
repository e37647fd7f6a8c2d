"""Outliers and grouped apply (M1-M3).

* ``identify_outliers`` — box-plot rule per group: quartiles by one aggregate,
  joined back on the group (struct key, null-safe), rows outside the fences kept.
* ``mahalanobis`` — per group means and sample covariances by one aggregate; their
  Cholesky factor is a few columns on the group's row of statistics, and the distance
  a few columns on every row: no matrix ever travels to the driver, any number of
  groups and of columns works.
* ``apply_per_group`` — ``applyInPandas`` for arbitrary pandas functions; with
  ``split`` the function runs on sub-groups and ``combine`` merges their partial
  results, so a hot group never lands in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialstats.functions.distributions import chi2_quantile
from trialstats.operators.joins import join_group_stats
from trialstats.operators.selection import order_statistics
from trialstats.session import materialize

_G = "_ol_group"


# ---------------------------------------------------------------- M1

def identify_outliers(df: DataFrame, keys: Sequence[str], col: str, coef: float = 1.5,
                      extreme_coef: float = 3.0) -> DataFrame:
    """rstatix ``identify_outliers``: rows outside Q1 − 1.5·IQR … Q3 + 1.5·IQR of their group.

    Adds ``is_outlier`` and ``is_extreme`` (3·IQR) and returns the outlier rows only.
    Quartiles are type-7 (linear interpolation), as R's ``quantile``.
    """
    keys = list(keys)
    x = F.col(col).cast("double")
    q = order_statistics(df, keys, x, {"_q1": 0.25, "_q3": 0.75})
    if keys:
        base = df.withColumn(_G, F.struct(*keys))
        joined = join_group_stats(base, materialize(q.select(F.struct(*keys).alias(_G), "_q1", "_q3"), "quartiles"), _G)
    else:  # one group: its quartiles are a scalar subquery (no join)
        joined = df.withColumn(_G, F.lit(0)).withColumn("_q", q.select(F.struct("_q1", "_q3").alias("q")).scalar())
        joined = joined.withColumns({"_q1": F.col("_q._q1"), "_q3": F.col("_q._q3")}).drop("_q")
    q1, q3 = F.col("_q1"), F.col("_q3")
    iqr = q3 - q1
    out = joined.withColumns({
        "is_outlier": (x < q1 - coef * iqr) | (x > q3 + coef * iqr),
        "is_extreme": (x < q1 - extreme_coef * iqr) | (x > q3 + extreme_coef * iqr),
    })
    return out.where(F.col("is_outlier")).drop(_G, "_q1", "_q3")


# ---------------------------------------------------------------- M2

def _whitening(df: DataFrame, k: int, cov) -> tuple[DataFrame, list[str]]:
    """Cholesky factor of the k×k covariances ``cov(i, j)`` (i >= j) as columns ``_l{i}_{j}``, one step of columns at a time.

    Each entry refers to earlier columns, so the text of the plan grows with k², not with k!. A factor that is not
    positive (constant or collinear columns) is null, and with it the distance.
    """
    names: list[str] = []
    for j in range(k):
        taken = lambda i: sum((F.col(f"_l{i}_{m}") * F.col(f"_l{j}_{m}") for m in range(j)), F.lit(0.0))  # noqa: B023, E731
        rest = cov(j, j) - taken(j)
        df = df.withColumn(f"_l{j}_{j}", F.when(rest > F.abs(cov(j, j)) * 1e-12, F.sqrt(rest)))
        df = df.withColumns({f"_l{i}_{j}": (cov(i, j) - taken(i)) / F.col(f"_l{j}_{j}") for i in range(j + 1, k)})
        names += [f"_l{i}_{j}" for i in range(j, k)]
    return df, names


def mahalanobis(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), p: float = 0.999,
                digits: int = 3) -> DataFrame:
    """rstatix ``mahalanobis_distance`` over complete rows: adds ``mahal_dist`` and ``is_outlier``
    (distance above the chi-square ``p`` quantile with ``len(cols)`` degrees of freedom).

    The covariances of each group are factored on its one row of statistics; a row's distance is the
    squared length of the forward solution for its deviations, a few columns for any number of them.
    """
    keys, cols = list(keys), list(cols)
    k = len(cols)
    x = [F.col(c).cast("double") for c in cols]
    base = df.dropna(subset=cols)
    if keys:
        base = base.withColumn(_G, F.struct(*keys))
    st = base.groupBy(*[_G] * bool(keys)).agg(*[F.avg(x[i]).alias(f"_mu{i}") for i in range(k)],
                                              *[F.covar_samp(x[i], x[j]).alias(f"_cv{i}_{j}") for i in range(k) for j in range(i + 1)])
    st, factor = _whitening(st, k, lambda i, j: F.col(f"_cv{i}_{j}"))
    own = [*[f"_mu{i}" for i in range(k)], *factor]
    if keys:
        out = join_group_stats(base, materialize(st.select(_G, *own), "covariances"), _G)
    else:  # one group: its statistics are a scalar subquery (no join, so no row moves)
        out = base.withColumn(_G, st.select(F.struct(*own).alias("s")).scalar())
        out = out.withColumns({c: F.col(f"{_G}.{c}") for c in own}).drop(_G)
    for i in range(k):
        done = sum((F.col(f"_l{i}_{m}") * F.col(f"_z{m}") for m in range(i)), F.lit(0.0))
        out = out.withColumn(f"_z{i}", (x[i] - F.col(f"_mu{i}") - done) / F.col(f"_l{i}_{i}"))
    dist = F.bround(sum((F.col(f"_z{i}") * F.col(f"_z{i}") for i in range(k)), F.lit(0.0)), digits)
    out = out.withColumn("mahal_dist", dist).withColumn("is_outlier", F.col("mahal_dist") > F.lit(chi2_quantile(p, k)))
    return out.select(*df.columns, "mahal_dist", "is_outlier")


# ---------------------------------------------------------------- M3

def _ship_by_value(fn: Callable) -> None:
    """Pickle a grouped function by value when its module is user code (this package, a
    script, a test module) rather than an installed library, so Python workers that do not
    have that module on their path (a cluster without ``--py-files``) can still run it."""
    import sys
    import sysconfig

    from pyspark import cloudpickle
    mod = sys.modules.get(getattr(fn, "__module__", "") or "")
    path = getattr(mod, "__file__", None) or ""
    if mod is None or not path or mod.__name__ == "__main__":
        return  # __main__ and dynamic functions are pickled by value anyway
    installed = (sysconfig.get_paths()["purelib"], sysconfig.get_paths()["stdlib"], "site-packages")
    if not any(p and p in path for p in installed):
        cloudpickle.register_pickle_by_value(mod)


def apply_per_group(df: DataFrame, keys: Sequence[str], fn: Callable, schema: str,
                    split: Column | None = None, combine: Mapping[str, Column] | None = None) -> DataFrame:
    """``doo`` / grouped apply: run a pandas ``fn(pdf) -> pdf`` on each group.

    Without ``split`` every group is one pandas frame in one task — only for groups
    bounded by design. With ``split`` (a column that cuts a group into sub-groups, e.g.
    a time bucket) ``fn`` must return partial results, which ``combine`` (``{out: agg}``)
    merges per group with an ordinary aggregate.
    """
    keys = list(keys)
    _ship_by_value(fn)
    if split is None:
        return df.groupBy(*keys).applyInPandas(fn, schema)
    parts = df.withColumn("_ap_split", split).groupBy(*keys, "_ap_split").applyInPandas(fn, schema)
    return parts.groupBy(*keys).agg(*[e.alias(n) for n, e in (combine or {}).items()])
