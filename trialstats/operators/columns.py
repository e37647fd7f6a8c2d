"""Projection and schema operators (P1-P12): rename, ranges, patterns, relocate, transforms.

All of them only build a ``select`` list from ``df.columns`` / ``df.schema`` on the
driver (metadata, no data) — Catalyst then prunes the scan to the columns used.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean_name(name: str) -> str:
    """Rule 14: dots in names (``both_loc_cb1_mix.keys``) become underscores at the source."""
    return name.replace(".", "_")


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[clean_name(c) for c in df.columns])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename columns (missing names are an error, as in dplyr)."""
    missing = [c for c in mapping if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.withColumnsRenamed(dict(mapping))


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names of the columns lying from ``first`` to ``last`` inclusive (R's ``'a':'b'``)."""
    cols = df.columns
    i, j = cols.index(first), cols.index(last)
    return cols[i:j + 1] if i <= j else cols[j:i + 1][::-1]


def select_range(df: DataFrame, *parts: str | tuple[str, str]) -> DataFrame:
    """Select names and ``(first, last)`` ranges, in the given order."""
    out: list[str] = []
    for p in parts:
        names = column_range(df, *p) if isinstance(p, tuple) else [p]
        out += [n for n in names if n not in out]
    return df.select(*out)


def matching(df: DataFrame, prefix: str = "", suffix: str = "") -> list[str]:
    """``starts_with(prefix) & ends_with(suffix)``, ignoring case (rule 9)."""
    p, s = prefix.lower(), suffix.lower()
    return [c for c in df.columns if c.lower().startswith(p) and c.lower().endswith(s)]


def drop_columns(df: DataFrame, *parts: str | tuple[str, str]) -> DataFrame:
    """P5: drop names and ``(first, last)`` ranges (``select(-c('a':'b', 'x'))``)."""
    gone: list[str] = []
    for p in parts:
        gone += column_range(df, *p) if isinstance(p, tuple) else [p]
    return df.drop(*gone)


def relocate(df: DataFrame, cols: Sequence[str], after: str | None = None, before: str | None = None) -> DataFrame:
    """Move ``cols`` after / before another column (default: to the front)."""
    cols = list(cols)
    rest = [c for c in df.columns if c not in cols]
    if after is not None:
        i = rest.index(after) + 1
    elif before is not None:
        i = rest.index(before)
    else:
        i = 0
    return df.select(*rest[:i], *cols, *rest[i:])


def mutate_keep_unused(df: DataFrame, name: str, expr: Column, used: Sequence[str]) -> DataFrame:
    """``mutate(.keep='unused')`` — add ``name`` and drop the columns it was made from."""
    return df.withColumn(name, expr).drop(*[u for u in used if u != name])


def transform_where(df: DataFrame, fn: Callable[[Column], Column],
                    predicate: Callable[[T.StructField], bool] | None = None,
                    cols: Sequence[str] | None = None) -> DataFrame:
    """Apply ``fn`` to every column chosen by a type predicate or a name list.

    ``mutate_if(is.character, f)`` is ``transform_where(df, f, is_string)``;
    ``mutate_at(2:5, f)`` is ``transform_where(df, f, cols=df.columns[1:5])``.
    """
    chosen = [f.name for f in df.schema.fields
              if (cols is None or f.name in cols) and (predicate is None or predicate(f))]
    return df.withColumns({c: fn(F.col(c)).alias(c) for c in chosen})


def is_string(f: T.StructField) -> bool:
    return isinstance(f.dataType, T.StringType)


def is_numeric(f: T.StructField) -> bool:
    return isinstance(f.dataType, T.NumericType)
