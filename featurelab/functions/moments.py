"""Pairwise second moments per fold, in two passes.

Every pair of columns has its own number of rows, sums and products over the rows in which
both are present.  Values are taken about a centre near each column's mean, found in a first
pass, so products lose no digits to a large mean.  All parts are plain sums: blocks of tasks
and folds add up, and training moments of a fold are *total - fold*.  Only folds x F x F
numbers reach the driver, whatever the row count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelab.functions.wide import q
from featurelab.session import ship_package

_PARTS = ("n", "s", "sq", "p")


@dataclass
class Moments:
    """About ``centre``: ``n[i, j]`` rows with columns i and j, ``s[i, j]`` and ``sq[i, j]`` sum
    and sum of squares of column i over them, ``p[i, j]`` sum of products."""

    centre: np.ndarray
    n: np.ndarray
    s: np.ndarray
    sq: np.ndarray
    p: np.ndarray

    def _with(self, other: Moments, sign: int) -> Moments:
        return Moments(self.centre, *(getattr(self, k) + sign * getattr(other, k) for k in _PARTS))

    def __add__(self, other: Moments) -> Moments:
        return self._with(other, 1)

    def __sub__(self, other: Moments) -> Moments:
        return self._with(other, -1)

    def means(self) -> np.ndarray:
        """Mean of every column over its present rows (nan without any)."""
        with np.errstate(invalid="ignore", divide="ignore"):
            return self.centre + np.diag(self.s) / np.diag(self.n)

    def centred(self) -> np.ndarray:
        """Sums of products about the means of the rows of each pair (0 for a pair without rows)."""
        return self.p - self.s * self.s.T / np.maximum(self.n, 1)

    def covariance(self) -> np.ndarray:
        return self.centred() / np.maximum(self.n, 1)

    def correlation(self) -> np.ndarray:
        """Pearson correlation of every pair over its own rows; nan where a column does not vary."""
        v = np.maximum(self.sq - self.s * self.s / np.maximum(self.n, 1), 0.0)
        flat = v <= 1e-14 * np.maximum(self.sq, 1e-300)
        with np.errstate(invalid="ignore", divide="ignore"):
            r = self.centred() / np.sqrt(np.where(flat, np.nan, v) * np.where(flat, np.nan, v).T)
        return np.clip(r, -1.0, 1.0)

    def gramian(self) -> np.ndarray:
        """Sums of products of the values themselves."""
        a = self.centre
        return self.p + self.s * a[None, :] + (self.s * a[None, :]).T + self.n * np.outer(a, a)


def fold_moments(df: DataFrame, cols: list[str], fold: str | None = None) -> dict[int, Moments]:
    """{fold: Moments} of ``cols`` (fold None: one entry 0; rows without a fold are left out).
    Nulls and NaN are missing values, pair by pair.  No rows: {}."""
    ship_package(df.sparkSession)
    d = len(cols)
    values = [F.nanvl(q(c).cast("double"), F.lit(None)) for c in cols]
    first = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)]).first()
    centre = np.array([m if m is not None and np.isfinite(m) else 0.0 for m in first])
    group = F.col(fold).cast("int") if fold else F.lit(0)
    rows = df.select(group.alias("f"), F.array(*values).alias("x")).where(F.col("f").isNotNull())

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            f = batch.column("f").to_numpy()
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d) - centre
            m = ~np.isnan(x)
            x, m = np.where(m, x, 0.0), m.astype(np.float64)
            for k in np.unique(f).tolist():
                at = f == k
                y, w = x[at], m[at]
                total[k] = total.get(k, 0.0) + np.stack([w.T @ w, y.T @ w, (y * y).T @ w, y.T @ y])
        for k, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, k, np.int32)), pa.array(np.arange(d * d, dtype=np.int32)),
                                              *(pa.array(t[i].ravel()) for i in range(4))], ["f", "at", *_PARTS])

    sums = (rows.mapInArrow(blocks, "f int, at int, " + ", ".join(f"{c} double" for c in _PARTS))
            .groupBy("f", "at").agg(*[F.sum(c).alias(c) for c in _PARTS]).toArrow())
    f, at = sums.column("f").to_numpy(), sums.column("at").to_numpy()
    out = {}
    for k in np.unique(f).tolist():
        parts = []
        for c in _PARTS:
            block = np.zeros(d * d)
            block[at[f == k]] = sums.column(c).to_numpy()[f == k]
            parts.append(block.reshape(d, d))
        out[int(k)] = Moments(centre, *parts)
    return out


def total_moments(df: DataFrame, cols: list[str]) -> Moments:
    """Moments of all rows; all zero for an empty frame."""
    zero = np.zeros((len(cols), len(cols)))
    return fold_moments(df, cols).get(0) or Moments(np.zeros(len(cols)), zero, zero, zero, zero)
