"""F1-F8: alignment, winsorising and scaling.

Each scaler needs a few numbers per column (quantiles, mean, sd, min, max):
one aggregate pass, F small numbers to the driver, then a column expression
per feature -- a narrow map over the rows, inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurelab.functions.wide import column_quantiles, fused_agg, q
from featurelab.operators.cleaning import remove_constant
from featurelab.session import ship_package


def align(features: DataFrame, targets: DataFrame, key: str = "entity") -> tuple[DataFrame, DataFrame]:
    """restrict both tables to their common keys (left-semi joins both ways)."""
    fk = features.select(key)
    tk = targets.select(key)
    return features.join(tk, key, "left_semi"), targets.join(fk, key, "left_semi")


def _feats(df: DataFrame, keys: list[str]) -> list[str]:
    return [c for c in df.columns if c not in keys]


def winsorise(df: DataFrame, keys: list[str], modifier: float = 1.0, exact: bool = True) -> DataFrame:
    """clip each column to [q1 - m*iqr, q3 + m*iqr]; nulls stay null."""
    feats = _feats(df, keys)
    st = column_quantiles(df, feats, [0.25, 0.75], exact)
    out = []
    for c in feats:
        qs = st.get(c)
        if qs is None:
            out.append(q(c))
            continue
        q1, q3 = qs
        iqr = q3 - q1
        lo, hi = q1 - modifier * iqr, q3 + modifier * iqr
        out.append(F.when(q(c).isNotNull(), F.greatest(F.least(q(c), F.lit(hi)), F.lit(lo))).alias(c))
    return df.select(*[q(k) for k in keys], *out)


def standard_scale(df: DataFrame, keys: list[str]) -> DataFrame:
    """(x - mean) / population sd; a zero sd divides by 1."""
    feats = _feats(df, keys)
    st = fused_agg(df, {**{f"m{i}": F.avg(q(c)) for i, c in enumerate(feats)},
                        **{f"s{i}": F.stddev_pop(q(c)) for i, c in enumerate(feats)}})
    out = []
    for i, c in enumerate(feats):
        m, s = st[f"m{i}"], st[f"s{i}"]
        if m is None:
            out.append(q(c))
            continue
        s = s if s else 1.0
        out.append(((q(c) - F.lit(m)) / F.lit(s)).alias(c))
    return df.select(*[q(k) for k in keys], *out)


def minmax_scale(df: DataFrame, keys: list[str]) -> DataFrame:
    """(x - min) / (max - min); a constant column maps to 0."""
    feats = _feats(df, keys)
    st = fused_agg(df, {**{f"lo{i}": F.min(q(c)) for i, c in enumerate(feats)},
                        **{f"hi{i}": F.max(q(c)) for i, c in enumerate(feats)}})
    out = []
    for i, c in enumerate(feats):
        lo, hi = st[f"lo{i}"], st[f"hi{i}"]
        if lo is None:
            out.append(q(c))
            continue
        rng = (hi - lo) if hi != lo else 1.0
        out.append(((q(c) - F.lit(lo)) / F.lit(rng)).alias(c))
    return df.select(*[q(k) for k in keys], *out)


# ---- F5 Yeo-Johnson --------------------------------------------------------

def yeo_johnson(x: Column, lam: float) -> Column:
    pos = x >= 0
    if abs(lam) < 1e-12:
        p = F.log1p(x)
    else:
        p = (F.pow(x + 1.0, F.lit(lam)) - 1.0) / lam
    if abs(lam - 2.0) < 1e-12:
        n = -F.log1p(-x)
    else:
        n = -(F.pow(1.0 - x, F.lit(2.0 - lam)) - 1.0) / (2.0 - lam)
    return F.when(pos, p).otherwise(n)


#: Candidates per column and pass, the bracket they start from, how far it may widen, and the
#: decimals that a found lambda is rounded to.
CANDIDATES, START, FURTHEST, DECIMALS = 24, 2.0, 1024.0, 4


def _likelihood_parts(df: DataFrame, feats: list[str], lams: dict[int, np.ndarray]) -> dict[int, tuple]:
    """{column number: (n, mean, M2 by candidate, S)}: moments of the transformed values about
    their mean, merged from blocks, and S = sum of sign(x) log1p(abs(x))."""
    cols = sorted(lams)
    src = df.select(F.array(*[F.nanvl(q(feats[i]).cast("double"), F.lit(None)) for i in cols]).alias("x"))

    def merge(a, b):
        if a is None:
            return b
        n = a[0] + b[0]
        d = b[1] - a[1]
        return n, a[1] + d * (b[0] / n), a[2] + b[2] + d * d * (a[0] * b[0] / n), a[3] + b[3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list = [None] * len(cols)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(cols))
            for j, c in enumerate(cols):
                v = x[~np.isnan(x[:, j]), j]
                if len(v):
                    y = yeo_johnson_values(v[:, None], lams[c][None, :])
                    with np.errstate(over="ignore", invalid="ignore"):
                        mean = y.mean(axis=0)
                        part = len(v), mean, ((y - mean) ** 2).sum(axis=0), float((np.sign(v) * np.log1p(np.abs(v))).sum())
                        total[j] = merge(total[j], part)
        rows = [{"c": c, "n": t[0], "mean": t[1].tolist(), "m2": t[2].tolist(), "s": t[3]} for c, t in zip(cols, total) if t is not None]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("c", pa.int32()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())),
                                                          ("m2", pa.list_(pa.float64())), ("s", pa.float64())]))

    kind = "c int, n long, mean array<double>, m2 array<double>, s double"

    def merged(t: pa.Table) -> pa.Table:
        out = None
        for r in t.to_pylist():
            with np.errstate(over="ignore", invalid="ignore"):
                out = merge(out, (r["n"], np.array(r["mean"]), np.array(r["m2"]), r["s"]))
        return pa.table({"c": t.column("c").slice(0, 1), "n": [out[0]], "mean": [out[1].tolist()], "m2": [out[2].tolist()], "s": [out[3]]})

    # blocks of one column are merged by a few tasks first: no task reads a row from every block
    blocks = src.mapInArrow(run, kind).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    once = blocks.groupBy("c", "part").applyInArrow(lambda t: merged(t.drop(["part"])), kind)
    return {r["c"]: (r["n"], np.array(r["mean"]), np.array(r["m2"]), r["s"]) for r in once.groupBy("c").applyInArrow(merged, kind).collect()}


def yeo_johnson_values(x: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """The Yeo-Johnson transform of NumPy values, broadcasting."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        up, down = np.log1p(np.maximum(x, 0.0)), np.log1p(np.maximum(-x, 0.0))
        pos = np.where(np.abs(lam) < 1e-12, up, np.expm1(lam * up) / np.where(np.abs(lam) < 1e-12, 1.0, lam))
        two = 2.0 - lam
        neg = np.where(np.abs(two) < 1e-12, -down, -np.expm1(two * down) / np.where(np.abs(two) < 1e-12, 1.0, two))
        return np.where(x >= 0, pos, neg)


def power_lambdas(df: DataFrame, feats: list[str]) -> dict[str, float]:
    """lambda of the largest Yeo-Johnson log-likelihood of every column, to ``DECIMALS`` decimals.

    loglik(l) = -n/2 ln var(yj(x, l)) + (l - 1) sum sign(x) log1p(|x|).  All columns are searched
    at once: a pass scores ``CANDIDATES`` values in each column's bracket; the bracket doubles
    while its best value is at an end (to ``FURTHEST`` at most) and shrinks around it otherwise,
    to a ninth or so of its width.  Columns whose bracket is narrower than a hundredth of
    the last decimal leave.  A column that does not vary has no lambda."""
    ship_package(df.sparkSession)
    bracket = {i: (-START, START) for i in range(len(feats))}
    found: dict[str, float] = {}
    while bracket:
        lams = {i: np.linspace(lo, hi, CANDIDATES) for i, (lo, hi) in bracket.items()}
        parts = _likelihood_parts(df, feats, lams)
        for i in list(bracket):
            if i not in parts:
                del bracket[i]
                continue
            n, mean, m2, s = parts[i]
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                ll = -n / 2.0 * np.log(m2 / n) + (lams[i] - 1.0) * s
                varies = np.isfinite(m2) & (m2 > n * (1e-13 * mean) ** 2)        # beyond rounding
            ll = np.where(varies, ll, -np.inf)
            if not np.isfinite(ll).any():
                del bracket[i]
                continue
            best, (lo, hi) = int(np.argmax(ll)), bracket[i]
            step = lams[i][1] - lams[i][0]
            if best == 0 and lo > -FURTHEST:
                bracket[i] = (max(-FURTHEST, lo - 2 * (hi - lo)), lo + step)
            elif best == CANDIDATES - 1 and hi < FURTHEST:
                bracket[i] = (hi - step, min(FURTHEST, hi + 2 * (hi - lo)))
            elif hi - lo < 10.0 ** -(DECIMALS + 2):
                found[feats[i]] = round(float(lams[i][best]), DECIMALS)
                del bracket[i]
            else:
                bracket[i] = (max(lo, lams[i][best] - step), min(hi, lams[i][best] + step))
    return found


def power_transform(df: DataFrame, keys: list[str]) -> DataFrame:
    """Yeo-Johnson with the lambda of the largest likelihood (the identity where a column
    does not vary), then standard scaling."""
    feats = _feats(df, keys)
    lams = power_lambdas(df, feats)
    t = df.select(*[q(k) for k in keys], *[yeo_johnson(q(c), lams.get(c, 1.0)).alias(c) for c in feats])
    return standard_scale(t, keys)


def _placed(refs: np.ndarray, at: np.ndarray):
    """Arrow function: place of a value among ``refs`` (ascending), as a share ``at``."""
    def place(v: pd.Series) -> pd.Series:
        x = v.to_numpy(dtype=float)
        up = np.interp(x, refs, at)
        down = 1.0 - np.interp(-x, -refs[::-1], 1.0 - at[::-1])
        res = np.where(x <= refs[0], 0.0, np.where(x >= refs[-1], 1.0, (up + down) / 2.0))
        return pd.Series(np.where(np.isnan(x), np.nan, res))
    return F.pandas_udf(place, "double")


def quantile_transform(df: DataFrame, keys: list[str], n_quantiles: int = 1000) -> DataFrame:
    """map each column to uniform [0, 1] through its reference quantiles.

    References are the interpolated percentiles of the column, exact at any size.  A value at
    or below the first reference is 0 (also in a constant column), at or above the last 1;
    one equal to a run of references gets the middle of the run; others are interpolated
    linearly.  Each value is looked up by binary search.
    """
    feats = _feats(df, keys)
    at = np.arange(max(2, n_quantiles)) / (max(2, n_quantiles) - 1)
    found = column_quantiles(df, feats, at.tolist())
    out = []
    for c in feats:
        if c not in found:
            out.append(q(c))
            continue

        placed = _placed(np.array(found[c]), at)(q(c).cast("double"))
        out.append(F.when(q(c).isNotNull(), F.nanvl(placed, F.lit(None))).alias(c))
    return df.select(*[q(k) for k in keys], *out)


SCALERS = {"standard": standard_scale, "minmax": minmax_scale, "power": power_transform,
           "quantile": quantile_transform}


def scale_chain(df: DataFrame, keys: list[str], to_scale: list[str], remove_outliers: bool = False,
                outlier_modifier: float = 1.0) -> tuple[DataFrame, str | None]:
    """Optional F2, then the scalers in list order, then drop constant columns.

    Returns the frame and the suffix (scaler names joined by '_').
    """
    if remove_outliers:
        df = winsorise(df, keys, outlier_modifier)
    for name in to_scale:
        df = SCALERS[name](df, keys)
    df = remove_constant(df, keys)
    return df, ("_".join(to_scale) if to_scale else None)
