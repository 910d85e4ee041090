"""Tail probabilities of t, F and chi-square, and digamma.

Result frames of the selectors have one row per (fold, target, feature), so the
p-values are computed in an Arrow-batched pandas UDF over those few rows with
the NumPy functions below (regularised incomplete beta and gamma by continued
fractions, Numerical-Recipes style).  Digamma of the neighbour counts used by
the KSG estimator is a plain Column expression (recurrence + asymptotic series),
so it stays inside whole-stage codegen.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPS = 1e-15
_TINY = 1e-300


def _betacf(a, b, x, iters=300):
    qab = a + b
    qap = a + 1.0
    qam = a - 1.0
    c = np.ones_like(x)
    d = 1.0 - qab * x / qap
    d = np.where(np.abs(d) < _TINY, _TINY, d)
    d = 1.0 / d
    h = d.copy()
    for m in range(1, iters + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < _TINY, _TINY, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        d = 1.0 / d
        h = h * d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < _TINY, _TINY, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        d = 1.0 / d
        de = d * c
        h = h * de
        if np.all(np.abs(de - 1.0) < _EPS):
            break
    return h


def betainc(a, b, x):
    """Regularised incomplete beta I_x(a, b), vectorised."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    out = np.full(x.shape, np.nan)
    ok = np.isfinite(a) & np.isfinite(b) & np.isfinite(x) & (a > 0) & (b > 0)
    out[ok & (x <= 0)] = 0.0
    out[ok & (x >= 1)] = 1.0
    mid = ok & (x > 0) & (x < 1)
    if mid.any():
        am, bm, xm = a[mid], b[mid], x[mid]
        lbeta = (np.vectorize(math.lgamma)(am + bm) - np.vectorize(math.lgamma)(am)
                 - np.vectorize(math.lgamma)(bm))
        front = np.exp(lbeta + am * np.log(xm) + bm * np.log1p(-xm))
        direct = xm < (am + 1.0) / (am + bm + 2.0)
        res = np.empty_like(xm)
        if direct.any():
            res[direct] = front[direct] * _betacf(am[direct], bm[direct], xm[direct]) / am[direct]
        if (~direct).any():
            r = ~direct
            res[r] = 1.0 - front[r] * _betacf(bm[r], am[r], 1.0 - xm[r]) / bm[r]
        out[mid] = res
    return out


def gammaincc(s, x):
    """Regularised upper incomplete gamma Q(s, x), vectorised."""
    s, x = np.broadcast_arrays(np.asarray(s, float), np.asarray(x, float))
    out = np.full(x.shape, np.nan)
    ok = np.isfinite(s) & (s > 0) & ~np.isnan(x)
    out[ok & (x <= 0)] = 1.0
    out[ok & np.isposinf(x)] = 0.0
    mid = ok & (x > 0) & np.isfinite(x)
    if not mid.any():
        return out
    sm, xm = s[mid], x[mid]
    lg = np.vectorize(math.lgamma)(sm)
    res = np.empty_like(xm)
    series = xm < sm + 1.0
    if series.any():
        a, xx = sm[series], xm[series]
        ap = a.copy()
        total = 1.0 / a
        delta = total.copy()
        for _ in range(1000):
            ap = ap + 1.0
            delta = delta * xx / ap
            total = total + delta
            if np.all(np.abs(delta) < np.abs(total) * _EPS):
                break
        p = total * np.exp(-xx + a * np.log(xx) - lg[series])
        res[series] = 1.0 - p
    if (~series).any():
        r = ~series
        a, xx = sm[r], xm[r]
        b = xx + 1.0 - a
        c = np.full_like(xx, 1.0 / _TINY)
        d = 1.0 / b
        h = d.copy()
        for i in range(1, 1000):
            an = -i * (i - a)
            b = b + 2.0
            d = an * d + b
            d = np.where(np.abs(d) < _TINY, _TINY, d)
            c = b + an / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            d = 1.0 / d
            de = d * c
            h = h * de
            if np.all(np.abs(de - 1.0) < _EPS):
                break
        res[r] = np.exp(-xx + a * np.log(xx) - lg[r]) * h
    out[mid] = res
    return out


def gamma_quantile(u, shape: float):
    """x with P(Gamma(shape, 1) <= x) = u, by bisection of log x on the upper tail."""
    u = np.asarray(u, float)
    lo, hi = np.full(u.shape, -745.0), np.full(u.shape, math.log(shape + 40.0 * math.sqrt(shape) + 800.0))
    for _ in range(80):
        mid = (lo + hi) / 2.0
        above = 1.0 - gammaincc(np.full(u.shape, shape), np.exp(mid)) < u
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return np.exp((lo + hi) / 2.0)


def t_two_sided_p(t, df):
    t = np.asarray(t, float)
    df = np.asarray(df, float)
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def f_upper_p(f, d1, d2):
    f = np.asarray(f, float)
    d1 = np.asarray(d1, float)
    d2 = np.asarray(d2, float)
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def chi2_upper_p(x, k):
    return gammaincc(np.asarray(k, float) / 2.0, np.asarray(x, float) / 2.0)


# --- Column wrappers (Arrow batches over the small result frames) -------------

@F.pandas_udf(T.DoubleType())
def p_value_t(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided_p(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def p_value_f(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(f_upper_p(f.to_numpy(float), d1.to_numpy(float), d2.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def p_value_chi2(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series(chi2_upper_p(x.to_numpy(float), k.to_numpy(float)))


def pearson_p_value(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation coefficient with n - 2 degrees of freedom."""
    df = (n - 2).cast("double")
    t = r * F.sqrt(df / F.greatest(F.lit(1e-300), 1.0 - r * r))
    return F.when(n > 2, F.when(F.abs(r) >= 1.0, F.lit(0.0)).otherwise(p_value_t(t, df)))


def digamma(x: Column) -> Column:
    """psi(x) for x >= 1: shift by six, then the asymptotic series (error < 1e-12)."""
    y = x.cast("double") + 6.0
    shift = sum((1.0 / (x.cast("double") + float(k)) for k in range(6)), F.lit(0.0))
    inv = 1.0 / y
    inv2 = inv * inv
    series = (F.log(y) - 0.5 * inv
              - inv2 * (1.0 / 12 - inv2 * (1.0 / 120 - inv2 * (1.0 / 252 - inv2 * (1.0 / 240 - inv2 / 132)))))
    return series - shift


def digamma_py(x: float) -> float:
    y = x + 6.0
    shift = sum(1.0 / (x + k) for k in range(6))
    inv2 = 1.0 / (y * y)
    return (math.log(y) - 0.5 / y
            - inv2 * (1.0 / 12 - inv2 * (1.0 / 120 - inv2 * (1.0 / 252 - inv2 * (1.0 / 240 - inv2 / 132))))) - shift
