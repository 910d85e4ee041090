"""Treatment-effect and counterfactual selectors without per-column loops over rows.

I9 -- cross-fitted double ML, partially linear model.  Per fold one block of
pairwise moments of [X, y] (two passes for all folds and targets).  For test fold f
and each other fold g the nuisance regressions (feature j on the others, y on the
others, with intercept) are ridge fits on the moments of the remaining folds; their
residual products on fold g are quadratic forms of its moments about the training
means.  theta_j = sum(r_y r_j) / sum(r_j^2), averaged over g, so fold f is never
seen; keep the top ``1 - quantile_value`` share by abs(theta).

I10 -- counterfactual fitness.  For every (test fold, target, column) a one-variable
logistic model on the training rows: damped Newton steps for all cells at once, one
pass per step, cells that have converged leave.  A row "flips" when the decision
point x* = -b/w lies within ``cf_steps * lr`` of x and the penalised gain is positive
(abs(w) * MAD > 2 * dc).  Score = share of training rows that flip, from one more
pass; keep > 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelab.functions.moments import Moments, fold_moments
from featurelab.functions.wide import column_quantiles, q
from featurelab.session import cut_lineage, ship_package


def _cross_fit(train: Moments, held: Moments, ridge: float) -> np.ndarray:
    """theta of every feature (all columns but the last, which is y); nan where nothing is left
    of a feature."""
    mu = train.means()
    cov = train.covariance()
    nf = len(mu) - 1
    scale = np.diag(cov)[:nf]
    scale = np.where(scale > 0, scale, 1.0)              # the ridge is relative to each column's variance
    p = np.linalg.inv(cov[:nf, :nf] + ridge * np.diag(scale))
    u = p @ cov[:nf, nf]
    # columns of r_x: residual of feature j on the others; of r_y: of y on all but j (one inverse gives both)
    r_x = p / np.diag(p)[None, :]
    r_y = -(u[:, None] - p * (u / np.diag(p))[None, :])
    np.fill_diagonal(r_y, 0.0)
    shift = held.means() - mu
    about = held.centred() + held.n * np.outer(shift, shift)
    den = np.einsum("ij,ik,kj->j", r_x, about[:nf, :nf], r_x)
    num = np.einsum("ij,ik,kj->j", r_y, about[:nf, :nf], r_x) + about[nf, :nf] @ r_x
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(den > 0, num / den, np.nan)


def double_ml_selector(df: DataFrame, feats: list[str], targets: list[str], k: int, ridge: float = 1e-3,
                       quantile_value: float = 0.8) -> DataFrame:
    """(fold, target, feature, score, kept); the rows of the test fold take no part.  Folds
    without rows are left out of the average; k is 3 or more.  A feature without variation
    beyond the others has a null score and is not kept."""
    if k < 3:
        raise ValueError("cross-fitting outside a test fold needs three folds")
    rows = []
    for t in targets:
        blocks = {f: m for f, m in fold_moments(df.where(q(t).isNotNull()), [*feats, t], "fold").items() if m.n[-1, -1] > 0}
        for fold in range(k):
            others = [f for f in sorted(blocks) if f != fold]
            thetas = []
            for g in others:
                rest = [blocks[f] for f in others if f != g]
                if rest:
                    thetas.append(_cross_fit(sum(rest[1:], rest[0]), blocks[g], ridge))
            if not thetas:
                continue
            theta = np.mean(thetas, axis=0)
            known = np.abs(theta[~np.isnan(theta)])
            thr = np.quantile(known, quantile_value) if len(known) else np.inf
            rows += [(fold, t, f, None if np.isnan(v) else float(v), bool(abs(v) >= thr)) for f, v in zip(feats, theta)]
    return df.sparkSession.createDataFrame(rows, "fold int, target string, feature string, score double, kept boolean")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def _cell_sums(rows: DataFrame, shape: tuple[int, int, int], n_stats: int, stats) -> np.ndarray:
    """Sum over training rows of ``stats(x, y, fold, target, columns)`` for every (fold, target,
    column) cell: x (rows x columns, nan where missing), y; columns None means all."""
    k, n_targets, n_feats = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, n_targets, n_feats, n_stats))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n_feats)
            y = batch.column("y").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n_targets)
            fold = batch.column("fold").to_numpy()
            for f in range(k):
                for t in range(n_targets):
                    at = (fold != f) & ~np.isnan(y[:, t])
                    if at.any():
                        stats(total[f, t], x[at], y[at, t], f, t)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["at", "v"])

    t = rows.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(k * n_targets * n_feats * n_stats)
    out[t.column("at").to_numpy()] = t.column("v").to_numpy()
    return out.reshape(k, n_targets, n_feats, n_stats)


def logistic_cells(rows: DataFrame, shape: tuple[int, int, int], centre: np.ndarray, scale: np.ndarray, ridge: float = 1e-6,
                   tolerance: float = 1e-10, most_steps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Slope and intercept (on (x - centre) / scale) of every cell, minimising the mean log loss
    plus ``ridge`` / 2 times their squares.  A step that raises a cell's loss is halved; a
    cell is done when its step falls below ``tolerance``."""
    w, b = np.zeros(shape), np.zeros(shape)
    step_w, step_b, loss = np.zeros(shape), np.zeros(shape), np.full(shape, np.inf)
    done = np.zeros(shape, bool)
    for _ in range(most_steps):
        now_w, now_b, live = w - step_w, b - step_b, ~done

        def stats(total, x, y, f, t, now_w=now_w, now_b=now_b, live=live):
            on = np.flatnonzero(live[f, t])
            z = (x[:, on] - centre[on]) / scale[on]
            m = ~np.isnan(z)
            z = np.where(m, z, 0.0)
            u = z * now_w[f, t, on] + now_b[f, t, on]
            p = _sigmoid(u)
            r, h = (p - y[:, None]) * m, p * (1 - p) * m
            cost = (np.logaddexp(0.0, u) - y[:, None] * u) * m
            total[on] += np.stack([v.sum(axis=0) for v in (m.astype(float), cost, r * z, r, h * z * z, h * z, h)], axis=1)

        n, cost, gw, gb, hww, hwb, hbb = np.moveaxis(_cell_sums(rows, shape, 7, stats), 3, 0)
        n = np.maximum(n, 1.0)
        new = cost / n + ridge / 2 * (now_w ** 2 + now_b ** 2)
        worse = live & (new > loss + 1e-12)
        step_w, step_b = np.where(worse, step_w / 2, step_w), np.where(worse, step_b / 2, step_b)
        good = live & ~worse
        w, b, loss = np.where(good, now_w, w), np.where(good, now_b, b), np.where(good, new, loss)
        a11, a12, a22 = hww / n + ridge, hwb / n, hbb / n + ridge
        g1, g2 = gw / n + ridge * w, gb / n + ridge * b
        det = a11 * a22 - a12 * a12
        step_w = np.where(good, (a22 * g1 - a12 * g2) / det, step_w)
        step_b = np.where(good, (a11 * g2 - a12 * g1) / det, step_b)
        done |= np.maximum(np.abs(step_w), np.abs(step_b)) < tolerance
        if done.all():
            break
    return w, b


def counterfactual_selector(df: DataFrame, feats: list[str], targets: list[str], k: int,
                            cf_steps: int = 500, lr: float = 0.01, dc: float = 0.2) -> DataFrame:
    """(fold, target, feature, w, b, score, kept), from the training rows of each fold (those
    of other folds with a target of 0 or 1; a missing feature is left out of its own column)."""
    ship_package(df.sparkSession)
    shape = (k, len(targets), len(feats))
    values = lambda names: F.array(*[F.nanvl(q(c).cast("double"), F.lit(None)) for c in names])
    rows = cut_lineage(df.select(F.col("fold").cast("int").alias("fold"), values(feats).alias("x"), values(targets).alias("y"))
                       .where(F.col("fold").isNotNull()))
    st = df.agg(*[F.avg(q(f)).alias(f"a{i}") for i, f in enumerate(feats)], *[F.stddev_pop(q(f)).alias(f"s{i}") for i, f in enumerate(feats)]).first()
    centre = np.array([st[f"a{i}"] or 0.0 for i in range(len(feats))])
    scale = np.array([st[f"s{i}"] or 1.0 for i in range(len(feats))])
    w, b = logistic_cells(rows, shape, centre, scale)
    w = w / scale                                        # back on the columns' own scale
    b = b - w * centre
    mad = np.zeros(shape)
    for f in range(k):
        train = df.where(F.col("fold") != f)
        for t, name in enumerate(targets):
            mine = train.where(q(name).isNotNull())
            mid = column_quantiles(mine, feats, [0.5])
            off = mine.select(*[F.abs(q(c) - F.lit(mid[c][0])).alias(c) for c in feats if c in mid])
            spread = column_quantiles(off, [c for c in feats if c in mid], [0.5])
            mad[f, t] = [spread[c][0] if c in spread else 0.0 for c in feats]
    gains = (np.abs(w) >= 1e-12) & (np.abs(w) * mad > 2 * dc)
    point = np.where(gains, -b / np.where(gains, w, 1.0), np.inf)

    def stats(total, x, y, f, t):
        total[:, 0] += (~np.isnan(x)).sum(axis=0)
        total[:, 1] += (np.abs(x - point[f, t]) < cf_steps * lr).sum(axis=0)

    n, flips = np.moveaxis(_cell_sums(rows, shape, 2, stats), 3, 0)
    score = flips / np.maximum(n, 1.0)
    out = [(f, t, c, float(w[f, i, j]), float(b[f, i, j]), float(score[f, i, j]), bool(score[f, i, j] > 0))
           for f in range(k) for i, t in enumerate(targets) for j, c in enumerate(feats)]
    return df.sparkSession.createDataFrame(out, "fold int, target string, feature string, w double, b double, score double, kept boolean")
