"""K1, K2, K4: two-dimensional instance-space projection.

The reference searches A (2 x F) and B with multi-start BFGS to minimise the
squared error of [X, y] ~ B A X.  That is reduced-rank regression, solved
exactly from the (uncentred, as in the reference) Gramian of [X, y]: one pass
over the rows, then an F x F eigenproblem on the driver.  Coordinates are a
column expression per row.

K3 (correlation of all pairwise distances before and after) is not built: it
needs every pair of rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurelab.functions.linalg import fold_gramians
from featurelab.functions.moments import total_moments
from featurelab.functions.wide import q


def fit_projection(df: DataFrame, feats: list[str], targets: list[str], ridge: float = 1e-9):
    cols = feats + targets
    g = fold_gramians(df, cols)[0]
    nf = len(feats)
    gxx = g[:nf, :nf] + ridge * np.eye(nf)
    gvx = g[:, :nf]                     # (F+T) x F
    c_ols = gvx @ np.linalg.inv(gxx)    # (F+T) x F
    s = c_ols @ gxx @ c_ols.T           # covariance of fitted values
    vals, vecs = np.linalg.eigh(s)
    order = np.argsort(vals)[::-1][:2]
    u = vecs[:, order]                  # B
    a = u.T @ c_ols                     # 2 x F
    for i in range(2):                  # sign fixed by the largest loading
        j = int(np.argmax(np.abs(a[i])))
        if a[i, j] < 0:
            a[i] *= -1
            u[:, i] *= -1
    error = float(np.trace(g) - vals[order].sum())
    return a, u, error


def project(df: DataFrame, key: str, feats: list[str], a: np.ndarray) -> DataFrame:
    """K2: coordinates z1, z2 of every row."""
    z = [sum((q(f) * float(a[i, j]) for j, f in enumerate(feats)), F.lit(0.0)).alias(f"z{i + 1}") for i in range(2)]
    return df.select(key, *z)


def reconstruction_r2(df: DataFrame, feats: list[str], targets: list[str], a: np.ndarray,
                      b: np.ndarray) -> dict[str, float]:
    """K2: r^2 per column between [X, y] and its reconstruction B A x.  The reconstruction is
    linear in x, so its correlations follow from the covariances of the columns (P3)."""
    cols = feats + targets
    cov = total_moments(df, cols).covariance()
    w = b @ a                                            # reconstruction of each column: weights on x
    with_own = np.einsum("kj,kj->k", w, cov[:, :len(feats)])
    own = np.einsum("ki,ij,kj->k", w, cov[:len(feats), :len(feats)], w)
    out = {}
    for k, c in enumerate(cols):
        v = own[k] * cov[k, k]
        out[c] = float(with_own[k] ** 2 / v) if v > 0 else None
    return out


def loadings(spark: SparkSession, feats: list[str], a: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(f, round(float(a[0, j]), 4), round(float(a[1, j]), 4))
                                  for j, f in enumerate(feats)], "feature string, z1 double, z2 double")
