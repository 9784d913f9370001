"""Tail probabilities for test statistics, applied to result rows (one per test, never one per event)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _beta_fraction(x: float, a: float, b: float) -> float:
    """Continued fraction of the incomplete beta integral, evaluated from the front (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return value
    raise ArithmeticError(f"no convergence of the beta integral at {x}, {a}, {b}")


def regularised_beta(x: float, a: float, b: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(x, a, b) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(1.0 - x, b, a) / b


def student_two_sided(t: float, dof: float) -> float:
    if dof > 1e5:  # the beta integral cancels here, and a corrected normal tail is off by the order of 1 / dof^2
        return normal_two_sided(t * (1.0 - 0.25 / dof) / math.sqrt(1.0 + 0.5 * t * t / dof))
    return regularised_beta(dof / (dof + t * t), dof / 2.0, 0.5)


def student_quantile(p_upper: float, dof: float) -> float:
    """t with P(|T| > t) = 2 * p_upper, by bisection on the tail."""
    lo, hi = 0.0, 1.0
    while student_two_sided(hi, dof) > 2.0 * p_upper:
        hi *= 2.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if student_two_sided(mid, dof) > 2.0 * p_upper else (lo, mid)
    return (lo + hi) / 2.0


def chi2_upper(x: float, dof: float) -> float:
    """Upper tail of chi-square: one minus the series of the lower incomplete gamma integral, or its tail fraction."""
    if x <= 0.0:
        return 1.0
    s, half = dof / 2.0, x / 2.0
    front = math.exp(s * math.log(half) - half - math.lgamma(s))
    if half < s + 1.0:
        term = total = 1.0 / s
        n = s
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= half / n
            total += term
        return 1.0 - front * total
    value = 0.0
    for k in range(400, 0, -1):
        value = k * (k - s) / (half + 2 * k + 1.0 - s - value)
    return front / (half + 1.0 - s - value)


def _safe(fn):
    def run(*args):
        if any(a is None or math.isnan(a) for a in args):
            return None
        if math.isinf(args[0]):
            return 0.0
        return fn(*args)
    return run


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided normal p-value."""
    return pd.Series([_safe(normal_two_sided)(v) for v in z.astype(float)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def student_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided Student p-value."""
    return pd.Series([_safe(student_two_sided)(a, b) for a, b in zip(t.astype(float), dof.astype(float))],
                     dtype="float64")


@F.pandas_udf(T.DoubleType())
def student_t95(dof: pd.Series) -> pd.Series:
    """Half-width multiplier of a 95 % t interval."""
    return pd.Series([_safe(lambda d: student_quantile(0.025, d))(v) if v > 0 else None for v in dof.astype(float)],
                     dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper-tail chi-square p-value."""
    return pd.Series([_safe(chi2_upper)(a, b) for a, b in zip(x.astype(float), dof.astype(float))], dtype="float64")
