"""Quantiles of the t and chi-square distributions without SciPy.

* ``t975(nu)`` — the 0.975 quantile of Student's t with ``nu`` degrees of
  freedom, as a Spark column: exact values (bisection on the regularized
  incomplete beta function, computed once on the driver with ``math.lgamma``)
  for ``nu <= T_EXACT_MAX``, beyond that the Cornish-Fisher expansion
  (Abramowitz & Stegun 26.7.5), whose error there is below 1e-9. The same
  numbers are written into the DuckDB oracle, so both sides agree bit for bit.
* ``chi2_quantile(p, k)`` — driver-side scalar, for the Mahalanobis cut-off
  (one value per number of columns).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

T_EXACT_MAX = 100
Z975 = 1.959963984540054  # 0.975 quantile of the standard normal


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, eps = 1e-300, 1e-16
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        de = d * c
        h *= de
        if abs(de - 1.0) < eps:
            break
    return h


def reg_inc_beta(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1.0 - x) / b


def t_cdf(t: float, nu: float) -> float:
    x = nu / (nu + t * t)
    tail = 0.5 * reg_inc_beta(nu / 2.0, 0.5, x)
    return 1.0 - tail if t >= 0 else tail


def t_quantile(p: float, nu: float) -> float:
    """Quantile of Student's t by bisection (p in (0.5, 1))."""
    lo, hi = 0.0, 1.0
    while t_cdf(hi, nu) < p:
        hi *= 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if t_cdf(mid, nu) < p:
            lo = mid
        else:
            hi = mid
        if hi - lo < 1e-15 * max(1.0, hi):
            break
    return 0.5 * (lo + hi)


def t975_cornish_fisher(nu: float, z: float = Z975) -> float:
    g1 = (z ** 3 + z) / 4
    g2 = (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96
    g3 = (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384
    g4 = (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / 92160
    return z + g1 / nu + g2 / nu ** 2 + g3 / nu ** 3 + g4 / nu ** 4


_T975_TABLE: list[float] | None = None


def t975_table() -> list[float]:
    """Exact 0.975 quantiles for nu = 1..T_EXACT_MAX (computed once per process)."""
    global _T975_TABLE
    if _T975_TABLE is None:
        _T975_TABLE = [t_quantile(0.975, float(nu)) for nu in range(1, T_EXACT_MAX + 1)]
    return _T975_TABLE


def _cf_coeffs(z: float = Z975) -> tuple[float, float, float, float]:
    return ((z ** 3 + z) / 4,
            (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96,
            (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384,
            (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / 92160)


def t975(nu: Column) -> Column:
    """Spark column: 0.975 t quantile for ``nu`` (null when nu < 1)."""
    g1, g2, g3, g4 = _cf_coeffs()
    v = nu.cast("double")
    table = F.expr("array(" + ", ".join(f"{x!r}D" for x in t975_table()) + ")")
    approx = F.lit(Z975) + F.lit(g1) / v + F.lit(g2) / (v * v) + F.lit(g3) / (v * v * v) + F.lit(g4) / (v * v * v * v)
    return (F.when(nu < 1, F.lit(None).cast("double"))
            .when(nu <= T_EXACT_MAX, F.element_at(table, nu.cast("int")))
            .otherwise(approx))


def t975_sql_duckdb(nu: str) -> str:
    """The same function as DuckDB SQL text (for the oracle)."""
    g1, g2, g3, g4 = _cf_coeffs()
    lst = ", ".join(repr(x) for x in t975_table())
    v = f"CAST({nu} AS DOUBLE)"
    return (f"(CASE WHEN {nu} < 1 THEN NULL WHEN {nu} <= {T_EXACT_MAX} "
            f"THEN list_extract([{lst}], CAST({nu} AS INTEGER)) "
            f"ELSE {Z975!r} + {g1!r} / {v} + {g2!r} / ({v} * {v}) + {g3!r} / ({v} * {v} * {v}) "
            f"+ {g4!r} / ({v} * {v} * {v} * {v}) END)")


# ---------------------------------------------------------------- chi-square

def reg_lower_gamma(a: float, x: float) -> float:
    """Regularized lower incomplete gamma P(a, x) (series / continued fraction)."""
    if x <= 0:
        return 0.0
    gln = math.lgamma(a)
    if x < a + 1.0:
        ap, s, d = a, 1.0 / a, 1.0 / a
        for _ in range(100000):
            ap += 1.0
            d *= x / ap
            s += d
            if abs(d) < abs(s) * 1e-16:
                break
        return s * math.exp(-x + a * math.log(x) - gln)
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 100000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        de = d * c
        h *= de
        if abs(de - 1.0) < 1e-16:
            break
    return 1.0 - math.exp(-x + a * math.log(x) - gln) * h


def chi2_quantile(p: float, k: int) -> float:
    """Quantile of the chi-square distribution with ``k`` degrees of freedom."""
    lo, hi = 0.0, max(1.0, float(k))
    while reg_lower_gamma(k / 2.0, hi / 2.0) < p:
        hi *= 2.0
    for _ in range(300):
        mid = 0.5 * (lo + hi)
        if reg_lower_gamma(k / 2.0, mid / 2.0) < p:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)
