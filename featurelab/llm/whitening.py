"""Embedding whitening by weighted multiplicity covariance.

Vectors become exact integers, and identical ones are grouped: each distinct vector is read,
multiplied and whitened once, with its number of copies (or one) as weight in the fit.

1. distinct integer vectors and their copies, written once;
2. fit size n and sums S: exact integers;
3. covariance: each task multiplies its centred vectors, (x - S/n) from the exact n*x - S,
   as one weighted matrix product; d x d blocks are summed by a grouped aggregate;
4. eigenvectors of the d x d covariance on the driver; projection of each distinct vector;
5. measured covariance of what came out, against the identity;
6. join back to the rows by a 128-bit key, proved free of collisions on the distinct vectors
   (else by the vectors themselves); vectors with many copies are dealt over several tasks.

Only n, S and the d x d covariance reach the driver, once for every vector length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurelab.session import ship_package

from .hot import join_classes
from .stage import written

#: Most vector lengths in one call, and the longest vector: they bound what the driver holds.
MAX_LENGTHS, MAX_DIM = 16, 4096
_LIMIT = float(1 << 52)              # larger products are cut to this: they stay exact integers
_DECIMAL = pa.decimal128(38, 0)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, integer matrix) of the vectors of each length in a batch."""
    col = batch.column("x")
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        flat = col.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield dim, at, flat.reshape(len(at), dim).astype(np.int64)


def _peak(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def _add_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, j, total): weighted sums of the components, and the sum of weights as j = -1."""
    total: dict[int, list[int]] = {}
    for batch in batches:
        weight = batch.column("weight").to_numpy()
        for dim, at, x in _by_length(batch):
            w = weight[at]
            if _peak(x) * int(w.sum()) >= 1 << 62:
                x, w = x.astype(object), w.astype(object)
            sums = [int(w.sum()), *(int(v) for v in w @ x)]
            total[dim] = [a + b for a, b in zip(total.get(dim, [0] * (dim + 1)), sums)]
    for dim, sums in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(dim + 1, dim, np.int32)), pa.array(np.arange(-1, dim, dtype=np.int32)),
             pa.array(sums, _DECIMAL)], ["dim", "j", "total"])


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, exactly: 64-bit integers where they suffice, else Python's."""
    fits = n * _peak(x) + max(map(abs, sums), default=0) < 1 << 62
    s = np.array(sums, np.int64 if fits else object)
    return x * n - s if fits else x.astype(object) * n - s


def _add_products(fits: dict[int, tuple[int, list[int]]]):
    """(dim, i, j >= i, v): weighted products of centred components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            weight = batch.column("weight").to_numpy().astype(np.float64)
            for dim, at, x in _by_length(batch):
                n, sums = fits[dim]
                c = _deviations(x, n, sums).astype(np.float64) / n
                total[dim] = total.get(dim, 0.0) + (c * weight[at, None]).T @ c
        for dim, v in total.items():
            i, j = np.triu_indices(dim)
            for lo in range(0, len(i), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(i[part]), dim, np.int32)), pa.array(i[part].astype(np.int32)),
                     pa.array(j[part].astype(np.int32)), pa.array(v[i[part], j[part]])], ["dim", "i", "j", "v"])
    return run


def _components(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, list[bool]]:
    """Projection (d x k, over the root of the eigenvalue), share of the trace, and whether
    the component varies.  A vector's entry of largest size is positive: one sign for all rows."""
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
    varies = e > max(float(e[0]), 0.0) * len(cov) * np.finfo(float).eps
    trace = float(np.trace(cov))
    return u / np.sqrt(np.where(varies, e, 1.0)), np.maximum(e, 0.0) / trace if trace > 0 else np.zeros(len(e)), varies.tolist()


def _project(fits: dict[int, tuple[int, list[int]]], model: dict[int, tuple], extra: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, x in _by_length(batch):
                n, sums = fits[dim]
                projection, _, varies = model[dim]
                dev = _deviations(x, n, sums)
                z = (dev.astype(np.float64) / n) @ projection
                if dev.dtype != object and _peak(dev) ** 2 * max(1, dim) >= 1 << 63:
                    dev = dev.astype(object)
                square = (dev * dev).sum(axis=1)
                square = (pa.array(square.astype(np.int64)).cast(_DECIMAL) if dev.dtype != object else
                          pa.array([int(v) if v < 10**38 else None for v in square], _DECIMAL))
                k = len(varies)
                flat = pa.array(z.reshape(-1), mask=np.tile(~np.array(varies, bool), len(at)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * k), flat)
                kept = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in extra), lists, square], [*extra, "z", "deviation"])
    return run


def _identity_error(white: DataFrame, model: dict[int, tuple]) -> dict[int, float]:
    """Largest absolute entry of the whitened covariance minus the identity, by vector length;
    components without variance are left out, None if there is no other."""
    k = max((len(m[2]) for m in model.values()), default=0)
    if not k:
        return {}
    w, z = F.col("weight"), [F.get("z", F.lit(i)) for i in range(k)]
    means = {r["dim"]: r for r in white.groupBy("dim").agg(
        F.sum(w).cast("double").alias("n"), *[(F.sum(w * z[i]) / F.sum(w)).alias(f"m{i}") for i in range(k)]).collect()}
    per = lambda i: F.coalesce(*[F.when(F.col("dim") == d, F.lit(r[f"m{i}"])) for d, r in means.items()])
    c = [z[i] - per(i) for i in range(k)] if means else z
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    out = {}
    for r in white.groupBy("dim").agg(*[F.sum(w * c[i] * c[j]).alias(f"c{i}_{j}") for i, j in pairs]).collect():
        found = [abs(r[f"c{i}_{j}"] / means[r["dim"]]["n"] - (i == j)) for i, j in pairs if r[f"c{i}_{j}"] is not None]
        out[r["dim"]] = max(found, default=None)
    return out


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, offset: int = 100_000, weights: str = "count",
           id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), one row for each
    row of ``vectors`` and each of its first ``components`` components.

    An entry c becomes x = floor(scale * c) + offset (scale * c is cut to +-2**52).  The fit
    list holds each distinct x-vector as often as it occurs (``weights="count"``) or once
    (``"one"``); n is its size and S its sums.  ``deviation`` is the sum of (n*x - S)**2 as an
    exact decimal, null from 10**38 on.  ``whitened`` is x - S/n on the eigenvector of the
    covariance (divisor n) over the root of its eigenvalue, null where that is zero (equal
    vectors, fewer vectors than components); ``explained`` is the eigenvalue's share of the
    trace, 0 if the trace is 0; ``identity_error`` is measured on the whitened fit list.

    Null vectors and vectors with null or non-finite entries are left out.  Vectors of each
    length are a fit list of their own (at most ``MAX_LENGTHS`` lengths, none above
    ``MAX_DIM``); empty vectors have no components, so no rows.  Null and repeated ids stay,
    one set of rows for each.  An empty table gives no rows; other columns are not read.
    """
    if weights not in ("count", "one"):
        raise ValueError("weights: count or one")
    ship_package(vectors.sparkSession)
    finite = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = lambda c: F.floor(F.least(F.greatest(c * F.lit(float(scale)), F.lit(-_LIMIT)), F.lit(_LIMIT))) + F.lit(offset)
    rows = (vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("c"))
            .filter(F.col("c").isNotNull() & finite & (F.size("c") > 0))
            .select("id", F.transform("c", lambda c: whole(c).cast("long")).alias("x"))
            .select("id", "x", F.xxhash64("x").alias("k1"), F.xxhash64(F.lit(1), "x").alias("k2")))
    distinct = written(rows.groupBy("k1", "k2", "x").agg(F.count("*").alias("copies"))
                       .withColumn("dim", F.size("x"))
                       .withColumn("weight", F.col("copies") if weights == "count" else F.lit(1).cast("long")), "vectors")
    lengths = [r[0] for r in distinct.select("dim").distinct().limit(MAX_LENGTHS + 1).collect()]
    if len(lengths) > MAX_LENGTHS or max(lengths, default=0) > MAX_DIM:
        raise ValueError(f"vectors of more than {MAX_LENGTHS} lengths, or longer than {MAX_DIM}")
    sums = (distinct.select("x", "dim", "weight").mapInArrow(_add_sums, "dim int, j int, total decimal(38,0)")
            .groupBy("dim", "j").agg(F.sum("total").cast("decimal(38,0)").alias("total")).toArrow())
    raw: dict[int, dict[int, int]] = {}
    for dim, j, total in zip(*(sums.column(c).to_pylist() for c in ("dim", "j", "total"))):
        raw.setdefault(dim, {})[j] = int(total)
    fits = {dim: (v[-1], [v[j] for j in range(dim)]) for dim, v in raw.items()}
    products = (distinct.select("x", "dim", "weight").mapInArrow(_add_products(fits), "dim int, i int, j int, v double")
                .groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).toArrow())
    at, i, j, v = (products.column(c).to_numpy() for c in ("dim", "i", "j", "v"))
    model = {}
    for dim, (n, _) in fits.items():
        mine, cov = at == dim, np.zeros((dim, dim))
        cov[i[mine], j[mine]] = cov[j[mine], i[mine]] = v[mine] / n
        model[dim] = _components(cov, components)
    clash = not distinct.groupBy("k1", "k2").count().filter("count > 1").isEmpty()
    keys = ["k1", "k2", "x"] if clash else ["k1", "k2"]
    carried = [*keys, "dim", "weight", "copies"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in distinct.select(*carried).schema)
    white = written(distinct.select(*dict.fromkeys([*carried, "x"])).mapInArrow(
        _project(fits, model, carried), f"{schema}, z array<double>, deviation decimal(38,0)"), "whitened")
    errors = _identity_error(white, model)

    def of(values: dict, kind: str) -> Column:
        pick = [F.when(F.col("dim") == d, F.lit(x)) for d, x in values.items()]
        return (F.coalesce(*pick) if pick else F.lit(None)).cast(kind)
    n_rows = distinct.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    back = join_classes(rows.select("id", *keys), white, keys, "copies", n_rows, F.xxhash64("id"))
    return (back.select(F.col("id").alias(id_col), "dim", "deviation", F.posexplode("z").alias("at", "whitened"))
            .select(id_col, (F.col("at") + 1).cast("int").alias("component"),
                    of({d: f[0] for d, f in fits.items()}, "long").alias("n"), "deviation", "whitened",
                    F.get(of({d: m[1].tolist() for d, m in model.items()}, "array<double>"), F.col("at")).alias("explained"),
                    of(errors, "double").alias("identity_error")))
