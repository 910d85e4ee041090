"""Correlation matrix, collinearity drop, variance-inflation elimination.

The F x F matrices are the only thing that reaches the driver.  Pearson comes from the
centred pairwise moments (P3), Spearman from Spark ML's ``Correlation`` (distributed sorts),
Kendall from distributed inversion counts.  All three use, for every pair of columns, the
rows in which both are present.  VIF needs one pass of moments; the elimination loop then
works on the F x F matrix only.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurelab.functions.concordance import kendall
from featurelab.functions.moments import total_moments
from featurelab.functions.wide import fused_agg, q


def _ranked_correlation(df: DataFrame, feats: list[str]) -> np.ndarray:
    """Spearman of columns without nulls, over at least one row."""
    tmp = [f"_c{i}" for i in range(len(feats))]
    renamed = df.select(*[q(c).cast("double").alias(t) for c, t in zip(feats, tmp)])
    v = VectorAssembler(inputCols=tmp, outputCol="_v", handleInvalid="error").transform(renamed).select("_v")
    return Correlation.corr(v, "_v", "spearman").collect()[0][0].toArray()


def _spearman(df: DataFrame, feats: list[str]) -> np.ndarray:
    """Columns without nulls are ranked together; a pair with nulls is ranked by itself, over
    the rows in which both are present."""
    from featurelab.operators.learning import _in_pool
    present = {f: F.nanvl(q(f).cast("double"), F.lit(None)) for f in feats}
    st = fused_agg(df, {"n": F.count(F.lit(1)), **{f"c{i}": F.count(present[f]) for i, f in enumerate(feats)}})
    m = np.full((len(feats), len(feats)), np.nan)
    full = [i for i in range(len(feats)) if st["n"] and st[f"c{i}"] == st["n"]]
    if full:
        m[np.ix_(full, full)] = _ranked_correlation(df, [feats[i] for i in full])
    holes = [(i, j) for i in range(len(feats)) for j in range(i + 1, len(feats))
             if not (i in full and j in full) and st[f"c{i}"] and st[f"c{j}"]]

    def one(ij):
        a, b = (feats[x] for x in ij)
        both = df.where(present[a].isNotNull() & present[b].isNotNull())
        return np.nan if both.isEmpty() else _ranked_correlation(both, [a, b])[0, 1]
    for (i, j), r in zip(holes, _in_pool(one, holes)):
        m[i, j] = m[j, i] = r
    return m


def correlation_matrix(df: DataFrame, feats: list[str], method: str = "spearman") -> np.ndarray:
    """F x F correlation (pearson / spearman / kendall) of the feature columns; nan where a
    pair has no common rows or a column does not vary."""
    if method == "pearson":
        return total_moments(df, feats).correlation()
    if method == "spearman":
        return _spearman(df, feats)
    if method != "kendall":
        raise ValueError("method must be pearson, spearman or kendall")
    m = np.full((len(feats), len(feats)), np.nan)
    at = {f: i for i, f in enumerate(feats)}
    for (a, b), r in kendall(df, [(a, b) for i, a in enumerate(feats) for b in feats[i + 1:]]).items():
        if r is not None:
            m[at[a], at[b]] = m[at[b], at[a]] = r
    return m


def correlation_pairs(spark: SparkSession, df: DataFrame, feats: list[str], method: str = "spearman") -> DataFrame:
    """F9 as a tidy frame (a, b, r) for a < b by name."""
    m = correlation_matrix(df, feats, method)
    rows = []
    for i, a in enumerate(feats):
        for j, b in enumerate(feats):
            if a < b:
                r = float(m[i, j])
                rows.append((a, b, None if np.isnan(r) else r))
    return spark.createDataFrame(rows, "a string, b string, r double")


def collinear_drop_list(df: DataFrame, feats: list[str], method: str = "spearman",
                        threshold: float = 0.9) -> list[str]:
    """for every pair with abs(r) >= threshold drop the alphabetically first name."""
    m = correlation_matrix(df, feats, method)
    drop = set()
    for i, a in enumerate(feats):
        for j, b in enumerate(feats):
            if i != j and abs(m[i, j]) >= threshold:
                drop.add(min(a, b))
    return sorted(drop)


def drop_collinear(df: DataFrame, keys: list[str], method: str = "spearman", threshold: float = 0.9) -> DataFrame:
    feats = [c for c in df.columns if c not in keys]
    return df.drop(*collinear_drop_list(df, feats, method, threshold))


def gramian(df: DataFrame, feats: list[str]) -> np.ndarray:
    """X^T X; each entry sums the rows in which both columns are present."""
    return total_moments(df, feats).gramian()


def vif_from_gramian(g: np.ndarray) -> np.ndarray:
    """VIF of each column regressed on the others without intercept (uncentred R^2).

    Columns that take part in an exact linear dependence have an infinite VIF; an all-zero
    column has 0."""
    d = np.sqrt(np.diag(g))
    zero = d == 0
    d = np.where(zero, 1.0, d)
    norm = g / np.outer(d, d) + np.diag(zero.astype(float))
    w, v = np.linalg.eigh(norm)
    null = w <= 1e-12 * max(w.max(initial=0.0), 1.0)
    out = (v[:, ~null] ** 2 / w[~null]).sum(axis=1)
    out[(v[:, null] ** 2).sum(axis=1) > 1e-8] = np.inf
    out[zero] = 0.0
    return out


def vif_elimination(df: DataFrame, keys: list[str], value_threshold: float | None = None,
                    count_threshold: int | None = None) -> list[tuple[str, float]]:
    """drop the worst column while max VIF >= threshold, at most ``count_threshold`` times.

    Without either threshold nothing is dropped.  Returns the surviving (feature, vif) sorted by VIF descending.
    """
    feats = [c for c in df.columns if c not in keys]
    g = gramian(df, feats)
    alive = list(range(len(feats)))

    def current():
        v = vif_from_gramian(g[np.ix_(alive, alive)])
        return sorted(zip([feats[i] for i in alive], v, alive), key=lambda t: -t[1])
    ranked = current()
    if count_threshold is not None:
        steps = count_threshold
    else:
        steps = len(feats) if value_threshold is not None else 0
    for _ in range(steps):
        if not ranked:
            break
        if value_threshold is not None and ranked[0][1] < value_threshold:
            break
        alive = [t[2] for t in ranked[1:]]
        ranked = current() if alive else []
    return [(f, float(v)) for f, v, _ in ranked]


def vif_frame(spark: SparkSession, df: DataFrame, keys: list[str], value_threshold=None,
              count_threshold=None) -> DataFrame:
    res = vif_elimination(df, keys, value_threshold, count_threshold)
    return spark.createDataFrame(res, "feature string, vif double").withColumn("vif", F.round("vif", 6))
