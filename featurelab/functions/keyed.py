"""Keyed random numbers.

A uniform number in [0, 1) is derived from md5(seed ':' part ':' ...): the first
13 hex digits (52 bits) divided by 2**52.  It depends only on the key, never on
partitioning or row order, so a job recomputed after an executor loss gives the
same numbers, and DuckDB computes the identical value with
``('0x' || substr(md5(concat_ws(':', seed, key)), 1, 13))::BIGINT / 2**52``.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = float(2 ** 52)


def _as_col(p) -> Column:
    return p if isinstance(p, Column) else F.lit(str(p))


def keyed_uniform(seed, *parts) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), *[_as_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(TWO_52)


def keyed_bucket(seed, k: int, *parts) -> Column:
    """Integer in [0, k) from the same 52 bits (``bits mod k``)."""
    text = F.concat_ws(":", F.lit(str(seed)), *[_as_col(p).cast("string") for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long"), F.lit(k)).cast("int")


def keyed_uniform_pair(seed, *parts) -> tuple[Column, Column]:
    """Two independent uniforms from ONE md5: hex digits 1-13 and 14-26 (52 bits each)."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[_as_col(p).cast("string") for p in parts]))
    u1 = F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(TWO_52)
    u2 = F.conv(F.substring(h, 14, 13), 16, 10).cast("double") / F.lit(TWO_52)
    return u1, u2


def keyed_normal(seed, *parts) -> Column:
    """Standard normal by Box-Muller from the two keyed uniforms of one md5."""
    u1, u2 = keyed_uniform_pair(seed, "n", *parts)
    # 1 - u1 lies in (0, 1], so the log is finite.
    return F.sqrt(-2.0 * F.log(1.0 - u1)) * F.cos(2.0 * math.pi * u2)


def poisson_cdf(lam: float) -> list[float]:
    """Cumulated probabilities of 0, 1, 2, ... below 1 - 2**-52, the largest uniform number."""
    out, total, k, log_p = [], 0.0, 0, -lam
    while total < 1.0 - 2.0 ** -52 and not (k > lam and math.exp(log_p) < 1e-18):
        total = min(total + math.exp(log_p), 1.0)
        out.append(total)
        k += 1
        log_p += math.log(lam) - math.log(k)
    return out


def keyed_poisson(seed, lam: float, *parts) -> Column:
    """Poisson(lam) by inverse CDF: how many cumulated probabilities the uniform number reaches.
    The table ends where no uniform number reaches further, so nothing is cut off."""
    if lam <= 0:
        raise ValueError("lam must be positive")
    u = keyed_uniform(seed, "p", *parts)
    table = F.array(*[F.lit(c) for c in poisson_cdf(lam)])
    return F.size(F.filter(table, lambda c: c <= u)).cast("double")


def keyed_gamma(seed, shape: float, *parts) -> Column:
    """Gamma(shape, 1) for any positive shape: the quantile of a keyed uniform number, by
    bisection in an Arrow function.  An integer shape gives sums of exponentials instead."""
    if shape <= 0:
        raise ValueError("gamma shape must be positive")
    if shape == int(shape) and shape <= 16:
        return keyed_gamma_exp(seed, int(shape), *parts)
    def quantile(u: pd.Series) -> pd.Series:
        from featurelab.functions.special import gamma_quantile
        return pd.Series(gamma_quantile(u.to_numpy(dtype=float), shape))
    return F.pandas_udf(quantile, "double")(keyed_uniform(seed, "gamma", *parts))


def keyed_gamma_exp(seed, shape: int, *parts) -> Column:
    """Gamma(shape, 1) for an integer shape: sum of ``shape`` exponentials."""
    if shape < 1:
        raise ValueError("gamma shape must be a positive integer here")
    out = None
    for i in range(shape):
        e = -F.log(1.0 - keyed_uniform(seed, f"g{i}", *parts))
        out = e if out is None else out + e
    return out


def sql_keyed_uniform(seed, *parts: str) -> str:
    """DuckDB twin of :func:`keyed_uniform` (parts are SQL expressions)."""
    args = ", ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"(CAST('0x' || substr(md5(concat_ws(':', {args})), 1, 13) AS BIGINT) / 4503599627370496.0)"


def sql_keyed_bucket(seed, k: int, *parts: str) -> str:
    args = ", ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"CAST(CAST('0x' || substr(md5(concat_ws(':', {args})), 1, 13) AS BIGINT) % {k} AS INTEGER)"
