"""Tail probabilities of the normal, t, F, chi-square and beta distributions.

Plain functions for the driver, and Arrow-batched columns for small aggregated
tables. The incomplete beta and gamma functions use the usual continued fractions
and series.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

TINY = 1e-300
EPS = 1e-15


def log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if math.isnan(x) or math.isnan(a) or math.isnan(b):
        return math.nan
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_inc(b, a, 1.0 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - log_beta(a, b)) / a
    # Lentz evaluation of the continued fraction; large shapes need about sqrt(shape) terms
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > TINY else TINY)
    h = d
    for m in range(1, 500 + int(5 * math.sqrt(max(a, b)))):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > TINY else TINY)
            c = 1.0 + term / c
            c = c if abs(c) > TINY else TINY
            h *= c * d
        if abs(c * d - 1.0) < EPS:
            break
    return min(1.0, front * h)


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if math.isnan(x) or math.isnan(a):
        return math.nan
    if x <= 0.0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    steps = 500 + int(5 * math.sqrt(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        for k in range(1, steps):
            term *= x / (a + k)
            total += term
            if term < total * EPS:
                break
        return max(0.0, 1.0 - total * scale)
    b = x + 1.0 - a
    c, d = 1.0 / TINY, 1.0 / b
    h = d
    for k in range(1, steps):
        an = -k * (k - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > TINY else TINY)
        c = b + an / c
        c = c if abs(c) > TINY else TINY
        h *= c * d
        if abs(c * d - 1.0) < EPS:
            break
    return scale * h


def norm_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def norm_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def t_two_sided(t: float, df: float) -> float:
    if math.isinf(t):
        return 0.0
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    if math.isinf(f):
        return 0.0
    if f <= 0.0:
        return 1.0
    return beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def chi2_tail(x: float, df: float) -> float:
    if math.isinf(x):
        return 0.0
    return gamma_upper(df / 2.0, x / 2.0)


def _solve(fn, low: float, high: float) -> float:
    """Root of a falling function by bisection."""
    for _ in range(200):
        mid = (low + high) / 2.0
        if fn(mid) > 0:
            low = mid
        else:
            high = mid
    return (low + high) / 2.0


def t_quantile(p: float, df: float) -> float:
    """Upper quantile q with P(|T| > q) = 2 (1 - p), for p > 0.5."""
    return _solve(lambda q: t_two_sided(q, df) - 2 * (1 - p), 0.0, 1e4)


def norm_quantile(p: float) -> float:
    return _solve(lambda q: p - norm_cdf(q), -40.0, 40.0)


def _batched(fn):
    @F.pandas_udf(DoubleType())
    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        def one(x, y, z):
            if x is None or y is None or z is None or np.isnan([x, y, z]).any():
                return None
            return fn(x, y, z)

        return pd.Series([one(*v) for v in zip(a, b, c)], dtype="float64")

    return three


def _positive(fn):
    return lambda x, y, z: fn(x, y, z) if y > 0 and z > 0 else math.nan


_f_tail = _batched(_positive(f_tail))
_t_two_sided = _batched(_positive(lambda x, y, z: t_two_sided(x, y)))
_chi2_tail = _batched(_positive(lambda x, y, z: chi2_tail(x, y)))
_norm_cdf = _batched(lambda x, y, z: norm_cdf((x - y) / z) if z > 0 else math.nan)


def f_p(stat, d1, d2):
    """Column: P(F(d1, d2) > stat)."""
    return F.nanvl(_f_tail(_d(stat), _d(d1), _d(d2)), F.lit(None).cast("double"))


def t_p(stat, df):
    """Column: two-sided p-value of t with df degrees of freedom."""
    return F.nanvl(_t_two_sided(_d(stat), _d(df), F.lit(1.0)), F.lit(None).cast("double"))


def chi2_p(stat, df):
    """Column: P(chi2(df) > stat)."""
    return F.nanvl(_chi2_tail(_d(stat), _d(df), F.lit(1.0)), F.lit(None).cast("double"))


def normal_cdf(value, mean=0.0, std=1.0):
    """Column: P(N(mean, std) <= value)."""
    return F.nanvl(_norm_cdf(_d(value), _d(mean), _d(std)), F.lit(None).cast("double"))


def _d(c):
    if isinstance(c, str):
        return F.col(c).cast("double")
    return F.lit(c).cast("double") if isinstance(c, (int, float)) else c.cast("double")
