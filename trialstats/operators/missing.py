"""Missing-data operators."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialstats.functions import scalars as X
from trialstats.operators.columns import is_numeric, is_string


def blank_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``na_if(x, '')`` over the text columns (or the listed ones)."""
    chosen = [f.name for f in df.schema.fields if is_string(f) and (cols is None or f.name in cols)]
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in chosen})


def value_to_null(df: DataFrame, cols: Sequence[str], value: Any) -> DataFrame:
    """``replace(x, x == v, NA)`` — 'None' in key columns, '888' in corr columns, 0 in summaries."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(value)) for c in cols})


def zero_fill(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``replace_na(0)`` on the chosen (default: all numeric) columns; NaN → 0 too."""
    chosen = [f.name for f in df.schema.fields if is_numeric(f) and (cols is None or f.name in cols)]
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c), F.lit(None)) if _is_frac(df, c) else F.col(c),
                                         F.lit(0)).cast(df.schema[c].dataType) for c in chosen})


def _is_frac(df: DataFrame, c: str) -> bool:
    return df.schema[c].dataType.typeName() in ("double", "float")


def filter_any_not_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Keep a row when at least one listed column (default: all) is non-null."""
    return df.where(X.any_not_null(list(cols or df.columns)))


def filter_all_not_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """keep a row only when every listed column is non-null."""
    return df.dropna(how="any", subset=list(cols))


def coalesce_wide(df: DataFrame, cols: Sequence[str], name: str, cast: str | None = None,
                  null_value: Any = None, drop: bool = True) -> DataFrame:
    """Join the non-null values of matched one-hot columns into one column, then cast.

    Concatenation (not ``coalesce``) on purpose: two non-null keys give a 2-character
    response that the double-response filter drops; two rt values give a text that
    does not parse, i.e. null.
    """
    parts = [F.nullif(F.col(c), F.lit(null_value)) if null_value is not None else F.col(c) for c in cols]
    joined = X.unite(parts)
    if cast == "int":
        value = X.to_int(joined)
    elif cast == "double":
        value = X.to_double(joined)
    else:
        value = joined
    out = df.withColumn(name, value)
    return out.drop(*[c for c in cols if c != name]) if drop else out


def pick_one_of_two(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """The value of whichever of two columns is set (null if both or neither)."""
    return df.withColumn(name, X.pick_one_of_two(a, b))


def all_null(cols: Sequence[str | Column]) -> Column:
    return X.all_null(cols)
