"""Column-level functions (X1-X14, F5-F10, P11): pure ``Column -> Column``.

Everything here is a built-in Spark expression, so it stays inside whole-stage
codegen. R semantics that differ from Spark defaults are spelled out (SURVEY §1.5).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- casts (P11, rule 6)

def to_double(c: str | Column) -> Column:
    """``as.numeric``: text that is not a number gives null instead of an error."""
    return col(c).try_cast("double")


def to_int(c: str | Column) -> Column:
    """``as.integer``: '' → null, '1.0' → 1, '2.7' → 2 (truncation, as R)."""
    return col(c).try_cast("double").try_cast("int")


def to_long(c: str | Column) -> Column:
    """``as.integer`` for identifiers that may exceed 32 bits (participant / user ids)."""
    return col(c).try_cast("double").try_cast("long")


def to_str(c: str | Column) -> Column:
    """``as.character``."""
    return col(c).cast("string")


# ---------------------------------------------------------------- arithmetic

def rmod(c: str | Column, m: int) -> Column:
    """R ``%%``: result has the sign of the divisor (``pmod``)."""
    return F.pmod(col(c), F.lit(m))


def round_half_even(c: str | Column, digits: int = 0) -> Column:
    """R ``round``: IEC 60559 half-to-even (``bround``)."""
    return F.bround(col(c), digits)


def safe_divide(a: str | Column, b: str | Column) -> Column:
    """``a / b`` with 0/0 and x/0 as null (R's NaN / Inf, which summaries drop)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def row_sum(cols: Sequence[str | Column], na_rm: bool = False) -> Column:
    """Sum across columns; ``na_rm=False`` gives null if any is null, ``True`` skips nulls."""
    cs = [col(c) for c in cols]
    if na_rm:
        cs = [F.coalesce(c, F.lit(0)) for c in cs]
    out = cs[0]
    for c in cs[1:]:
        out = out + c
    return out


# ---------------------------------------------------------------- conditionals

def case_when(pairs: Sequence[tuple[Column, Any]], default: Any = None) -> Column:
    """First matching condition wins; no default gives null."""
    out = None
    for cond, val in pairs:
        v = val if isinstance(val, Column) else F.lit(val)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    if default is not None:
        out = out.otherwise(default if isinstance(default, Column) else F.lit(default))
    return out


def remap(c: str | Column, mapping: Mapping[Any, Any]) -> Column:
    """Replace listed values, keep the rest (a literal ``CASE``; the map is fixed and small)."""
    x = col(c)
    return case_when([(x == F.lit(k), v) for k, v in mapping.items()], default=x)


def if_null(c: str | Column, value: Any) -> Column:
    """``ifelse(is.na(x), v, x)``."""
    return F.coalesce(col(c), F.lit(value))


def all_null(cols: Sequence[str | Column]) -> Column:
    """``if_all(cols, is.na)``."""
    return F.coalesce(*[col(c) for c in cols]).isNull()


def any_not_null(cols: Sequence[str | Column]) -> Column:
    """at least one listed column is non-null."""
    return F.coalesce(*[col(c) for c in cols]).isNotNull()


def pick_one_of_two(a: str | Column, b: str | Column) -> Column:
    """``a`` if ``b`` is missing, ``b`` if ``a`` is missing, null if both are set or both missing."""
    a, b = col(a), col(b)
    return F.when(a.isNull(), b).when(b.isNull(), a)


def not_in(c: str | Column, values: Iterable[Any]) -> Column:
    """``%nin%``; like R, a missing value gives a missing (dropped) predicate."""
    return ~col(c).isin(list(values))


def unite(cols: Sequence[str | Column], sep: str = "") -> Column:
    """``unite(na.rm=TRUE)`` — join the non-null values; all-null gives ''."""
    return F.concat_ws(sep, *[col(c).cast("string") for c in cols])


# ---------------------------------------------------------------- text

def split_fixed(c: str | Column, positions: Sequence[int]) -> list[Column]:
    """``separate(sep=c(2,3))`` — cut a text at fixed 1-based positions."""
    x = col(c)
    out, start = [], 1
    for p in positions:
        out.append(F.substring(x, start, p - start + 1))
        start = p + 1
    out.append(x.substr(F.lit(start), F.length(x)))
    return out


def paste(*parts: str | Column, sep: str = " ") -> Column:
    """R ``paste``; numbers are written without trailing zeros, as R prints them."""
    cs = []
    for p in parts:
        if isinstance(p, Column):
            cs.append(p.cast("string"))
        else:
            cs.append(F.lit(p))
    return F.concat_ws(sep, *cs)
