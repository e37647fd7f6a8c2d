"""Exact order statistics of groups of any size (quantiles, median absolute deviation).

``percentile`` keeps a counter for each distinct value of a group in one task. Here the
distinct values of all groups are counted with map-side aggregation, dealt to ranges of
(group, value), and a running sum of the counts along each group (the ordered scan, which
cuts hot groups) tells the ranks that each value covers. The values at the wanted ranks are
picked by one aggregate. No task holds a group, and the rows are read once: the grouping
sets that count the values also give one row of moments for each group.

That row comes first in its group (null value), so its number of rows reaches
every value by a running sum too, without a join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialstats.operators.joins import join_group_stats
from trialstats.operators.sequence import ordered_scan, ranged
from trialstats.session import materialize

_G, _V, _N, _ALL, _SEG = "_qs_group", "_qs_value", "_qs_n", "_qs_all", "_qs_range"


def _picked(scanned: DataFrame, probs: Mapping[str, float], more: Sequence[Column] = ()) -> DataFrame:
    """One row per group: a column for each type-7 quantile. ``_qs_sum`` is the running sum of the counts, ``_qs_all`` their total."""
    aggs, wanted, values = [], [f"{_V} IS NULL"], []
    for name, p in probs.items():
        at = f"(({_ALL} - 1) * {float(p)!r}D)"
        for side, rank in (("lo", f"floor({at})"), ("hi", f"ceil({at})")):
            held = f"(_qs_sum - {_N} <= {rank} AND {rank} < _qs_sum)"  # the rows of this value include the rank
            wanted.append(held)
            aggs.append(f"max(CASE WHEN {held} THEN {_V} END) AS _{side}_{name}")
        aggs.append(f"max({at} - floor({at})) AS _w_{name}")
        values.append(f"_lo_{name} * (1 - _w_{name}) + _hi_{name} * _w_{name} AS {name}")
    out = scanned.where(" OR ".join(wanted)).groupBy(_G).agg(*map(F.expr, aggs), *more)
    kept = [c for c in out.columns if not c.startswith(("_lo_", "_hi_", "_w_"))]
    return out.selectExpr(*kept, *values)


def _scanned(counts: DataFrame, order: Sequence[str]) -> DataFrame:
    """Running sums of the counts and of the groups' numbers of rows, along ``order`` (the group's own row first)."""
    cut = ranged(counts, [_G], order, _SEG)
    return ordered_scan(cut, [_G], order, running_sum={"_qs_sum": _N, _ALL: "_qs_head"}, segment=F.col(_SEG)).drop(_SEG)


def order_statistics(df: DataFrame, keys: Sequence[str], value: Column, probs: Mapping[str, float],
                     moments: Mapping[str, Column] | None = None, mad: str | None = None) -> DataFrame:
    """One row per group with exact type-7 quantiles ``{name: p}`` of the non-null values.

    ``moments`` — ``{name: aggregate of the column _qs_value}`` taken in the same pass over the rows.
    ``mad``     — name of the median of |value − median| (not scaled), found from the counts of the values.
    Groups are told apart null-safely; NaN counts as the largest value, as in Spark's order.
    """
    keys, moments, probs = list(keys), dict(moments or {}), dict(probs)
    rows = df.select(F.struct(*keys, F.lit(0).alias("_qs_0")).alias(_G), value.cast("double").alias(_V)).where(F.col(_V).isNotNull())
    sets = rows.groupingSets([[_G, _V], [_G]], _G, _V).agg(
        F.grouping(_V).alias("_qs_own"), F.count(F.lit(1)).alias(_N), *[e.alias(n) for n, e in moments.items()])
    own = F.col("_qs_own") == 1
    counts = sets.select(_G, F.when(~own, F.col(_V)).alias(_V), F.when(~own, F.col(_N)).alias(_N), F.when(own, F.col(_N)).alias("_qs_head"),
                         *[F.when(own, F.col(n)).alias(n) for n in moments])
    scanned = _scanned(counts, [_V])
    if mad:
        probs.setdefault("_qs_median", 0.5)
    out = _picked(scanned, probs, [F.max(n).alias(n) for n in moments])
    if mad:
        out = materialize(out, "quantiles")  # read for the medians and for the result
        both = join_group_stats(scanned.select(_G, _V, _N, "_qs_head"), out.select(_G, "_qs_median"), _G)
        away = F.abs(F.col(_V) - F.col("_qs_median"))
        away = both.select(_G, away.alias(_V), _N, "_qs_head").groupBy(_G, _V).agg(F.sum(_N).alias(_N), F.max("_qs_head").alias("_qs_head"))
        spread = _picked(_scanned(away, [_V]), {mad: 0.5})
        out = out.join(spread.hint("merge"), _G).drop("_qs_median")  # as many rows as groups on both sides: neither goes to the driver
    return out.select(*[F.col(f"{_G}.{k}").alias(k) for k in keys], *[c for c in out.columns if c != _G])
