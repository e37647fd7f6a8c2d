"""Reshape and category order.

Pivots always take explicit levels: no extra job to find them, a fixed output
schema, and no level silently missing (§2.16 #12). The pivot is written as a
conditional aggregation, so it keeps map-side partial aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialstats.operators.sequence import ordered_scan, ranged


def _level_name(v: Any) -> str:
    if isinstance(v, float) and v.is_integer():
        return str(int(v))
    return str(v)


def pivot_wider(df: DataFrame, ids: Sequence[str], names_from: str, values_from: str,
                levels: Sequence[Any], names: Mapping[Any, str] | None = None) -> DataFrame:
    """Long → wide; one column per level (named by ``names`` or by the level value). Two values for one cell are an error."""
    names = dict(names or {})
    aggs = []
    for lv in levels:
        value = F.when(F.col(names_from) == F.lit(lv), F.col(values_from))
        only = F.when(F.count(value) <= 1, F.first(value, ignorenulls=True)).otherwise(
            F.raise_error(F.lit(f"several values of {values_from} for {names_from} = {lv}")))
        aggs.append(only.alias(names.get(lv, _level_name(lv))))
    return df.groupBy(*ids).agg(*aggs)


def pivot_longer(df: DataFrame, ids: Sequence[str], cols: Sequence[str], names_to: str = "name",
                 values_to: str = "value", names_prefix: str | None = None, cast: str | None = None) -> DataFrame:
    """R2: wide → long; nulls are kept (``values_drop_na = FALSE``); ``names_prefix`` is stripped."""
    src = df.select(*ids, *[(F.col(c).cast(cast) if cast else F.col(c)).alias(c) for c in cols])
    out = src.unpivot(list(ids), list(cols), names_to, values_to)
    if names_prefix:
        out = out.withColumn(names_to, F.regexp_replace(names_to, "^" + names_prefix, ""))
    return out


def complete_by_round_trip(df: DataFrame, ids: Sequence[str], names_from: str, values_from: str,
                           levels: Sequence[Any], fill: Any = 0) -> DataFrame:
    """Wide, zero-fill, long again — adds the missing (ids, level) rows with ``fill``."""
    wide = pivot_wider(df, ids, names_from, values_from, levels)
    cols = [_level_name(lv) for lv in levels]
    wide = wide.fillna(fill, subset=cols)
    return pivot_longer(wide, ids, cols, names_from, values_from)


def with_order(df: DataFrame, col: str, levels: Sequence[str] | None = None, reverse: bool = False,
               name: str | None = None) -> DataFrame:
    """O3: category order as a sort column (``factor(levels=...)``); position 0 = not a level.

    Without ``levels`` the order is alphabetic (``as.factor``): the distinct values are numbered by
    the ordered scan (ranges of the values, the count of each range carried to the next), so a
    column with very many categories is numbered without one task that holds them all. Null is
    not a category.
    """
    name = name or f"{col}_order"
    if levels is None:
        distinct = df.select(col).where(F.col(col).isNotNull()).distinct()
        numbered = ordered_scan(ranged(distinct, [], [col]), [], [col], row_number=name, segment=F.col("scan_segment"))
        numbered = numbered.select(col, F.col(name).cast("int").alias(name))
        if reverse:
            numbered = numbered.withColumn(name, numbered.select((F.max(name) + 1).alias("n")).scalar() - F.col(name))
        return df.join(numbered, col, "left").select(*df.columns, name)
    pos = F.array_position(F.array(*[F.lit(x) for x in levels]), F.col(col)).cast("int")
    return df.withColumn(name, F.lit(len(levels) + 1) - pos if reverse else pos)


def relabel(c: str | Column, labels: Mapping[str, str]) -> Column:
    """Display labels looked up **by value** (the reference labels by position, §2.16 #11)."""
    x = F.col(c) if isinstance(c, str) else c
    out = None
    for k, v in labels.items():
        out = F.when(x == F.lit(k), F.lit(v)) if out is None else out.when(x == F.lit(k), F.lit(v))
    return out
