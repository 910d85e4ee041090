"""Building targets from the long metrics table.

E1 pivots one metric to entity x variant.  The variant list is read first (a
distinct over a low-cardinality column; it becomes the explicit pivot list), so
the pivot itself is a single hash aggregate.  E2 needs per-variant quantile
edges: one aggregate pass, T x (bins + 1) numbers to the driver.  E3 ranks the
variants of each entity with column arithmetic inside the pivoted row (no
shuffle, no window).  E4 needs T column means: one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurelab.functions.wide import column_quantiles, fused_agg, q

EDGE_TOL = 1e-8


def variant_list(df: DataFrame, metric: str, variant: str = "variant") -> list[str]:
    rows = df.where(F.col(metric).isNotNull()).select(variant).distinct().collect()
    return sorted(r[0] for r in rows if r[0] is not None)


def pivot_metric(df: DataFrame, metric: str, entity: str = "entity", variant: str = "variant",
                 variants: list[str] | None = None, order_col: str | None = None) -> DataFrame:
    """Entity x variant matrix of the first non-null metric.

    Variants (and entities) with no value at all vanish, as in the reference.
    With ``order_col`` "first" is the non-null value with the smallest order;
    without it the (entity, variant) pairs are expected to be unique (after C4).
    """
    src = df.where(F.col(metric).isNotNull())
    variants = variants if variants is not None else variant_list(src, metric, variant)
    if order_col is None:
        agg = F.first(metric, ignorenulls=True)
    else:
        agg = F.min_by(F.col(metric), F.col(order_col))
    return src.groupBy(entity).pivot(variant, variants).agg(agg)


def _kept_inner_edges(edges: list[float]) -> list[float]:
    """Edges closer than 1e-8 to their predecessor merge; the inner edges remain."""
    kept = [edges[0]] + [e for p, e in zip(edges[:-1], edges[1:]) if e - p > EDGE_TOL]
    return kept[1:-1]


def _class_expr(c: Column, inner: list[float]) -> Column:
    if not inner:
        return F.lit(0.0)
    total = None
    for e in inner:
        t = F.when(c >= F.lit(float(e)), 1.0).otherwise(0.0)
        total = t if total is None else total + t
    return F.when(c.isNull(), F.lit(0.0)).otherwise(total)


def quantile_edges(df: DataFrame, columns: list[str], n_bins: int = 2,
                   strategy: str = "quantile", exact: bool = True) -> dict[str, list[float]]:
    if strategy == "quantile":
        fr = [i / n_bins for i in range(n_bins + 1)]
        st = column_quantiles(df, columns, fr, exact)
        return {c: st.get(c) for c in columns}
    if strategy == "uniform":
        st = fused_agg(df, {**{f"lo{i}": F.min(q(c)) for i, c in enumerate(columns)},
                            **{f"hi{i}": F.max(q(c)) for i, c in enumerate(columns)}})
        out = {}
        for i, c in enumerate(columns):
            lo, hi = st[f"lo{i}"], st[f"hi{i}"]
            out[c] = None if lo is None else [lo + (hi - lo) * k / n_bins for k in range(n_bins + 1)]
        return out
    if strategy == "kmeans":
        return kmeans_edges(df, columns, n_bins)
    raise ValueError(f"unsupported strategy {strategy!r}")


def kmeans_edges(df: DataFrame, columns: list[str], n_bins: int, max_iter: int = 300,
                 tol: float = 1e-4) -> dict[str, list[float]]:
    """E2 ``strategy="kmeans"``: one-dimensional Lloyd iterations for all columns at once.

    Centres start at the midpoints of the uniform bins; each iteration assigns every value
    to its nearest centre (a column expression) and recomputes all centres in ONE fused
    aggregate; stop when the squared centre shift is below ``tol`` x mean variance.
    Edges are [min, midpoints of the sorted centres, max].
    """
    st0 = fused_agg(df, {**{f"lo{i}": F.min(q(c)) for i, c in enumerate(columns)},
                         **{f"hi{i}": F.max(q(c)) for i, c in enumerate(columns)},
                         **{f"v{i}": F.var_pop(q(c)) for i, c in enumerate(columns)}})
    centres = {}
    for i, c in enumerate(columns):
        lo, hi = st0[f"lo{i}"], st0[f"hi{i}"]
        if lo is None:
            continue
        e = [lo + (hi - lo) * k / n_bins for k in range(n_bins + 1)]
        centres[c] = [(a + b) / 2 for a, b in zip(e[:-1], e[1:])]
    live = [c for c in columns if c in centres]
    var_mean = sum((st0[f"v{columns.index(c)}"] or 0.0) for c in live) / max(len(live), 1)
    for _ in range(max_iter):
        exprs = {}
        for i, c in enumerate(live):
            cs = centres[c]
            x = q(c)
            # nearest centre index, ties to the lower index
            best = F.lit(0)
            bestd = F.abs(x - F.lit(cs[0]))
            for j in range(1, len(cs)):
                d = F.abs(x - F.lit(cs[j]))
                best = F.when(d < bestd, F.lit(j)).otherwise(best)
                bestd = F.least(d, bestd)
            for j in range(len(cs)):
                exprs[f"s{i}_{j}"] = F.avg(F.when(best == j, x))
        st = fused_agg(df, exprs)
        shift = 0.0
        for i, c in enumerate(live):
            new = [st[f"s{i}_{j}"] if st[f"s{i}_{j}"] is not None else centres[c][j]
                   for j in range(len(centres[c]))]
            shift += sum((a - b) ** 2 for a, b in zip(new, centres[c]))
            centres[c] = new
        if shift <= tol * var_mean:
            break
    out = {c: None for c in columns}
    for i, c in enumerate(columns):
        if c not in centres:
            continue
        cs = sorted(centres[c])
        lo, hi = st0[f"lo{i}"], st0[f"hi{i}"]
        out[c] = [lo] + [(a + b) / 2 for a, b in zip(cs[:-1], cs[1:])] + [hi]
    return out


def abs_perf_classes(wide: DataFrame, entity: str = "entity", n_bins: int = 2,
                     strategy: str = "quantile") -> DataFrame:
    """Each variant column cut into ``n_bins`` classes; equal to an inner edge goes up.

    A constant column has no inner edge left after merging -> all 0.  Nulls
    (missing variant) are the lowest class.
    """
    cols = [c for c in wide.columns if c != entity]
    edges = quantile_edges(wide, cols, n_bins, strategy)
    return wide.select(entity, *[_class_expr(q(c), _kept_inner_edges(edges[c]) if edges[c] else []).alias(c)
                                 for c in cols])


def _entity_ranks(cols: list[str]) -> dict[str, Column]:
    """Rank 1 = best (largest) value; a tie goes to the later column; null lowest."""
    v = {c: F.coalesce(q(c), F.lit(float("-inf"))) for c in cols}
    ranks = {}
    for j, c in enumerate(cols):
        r = F.lit(1)
        for k, d in enumerate(cols):
            if k == j:
                continue
            beats = (v[d] > v[c]) | ((v[d] == v[c]) & F.lit(k > j))
            r = r + F.when(beats, 1).otherwise(0)
        ranks[c] = r
    return ranks


def rel_perf_classes(wide: DataFrame, entity: str = "entity", n_bins: int = 2) -> DataFrame:
    """Rank the variants of each entity, then bin ranks 1..m at their own quantiles.

    The edges of 1..m are 1 + (m-1)*i/n, so for two bins rank >= (m+1)/2 -> 1:
    class 0 is the better half (the opposite sense of E2).
    """
    cols = [c for c in wide.columns if c != entity]
    m = len(cols)
    edges = [1.0 + (m - 1) * i / n_bins for i in range(n_bins + 1)]
    inner = _kept_inner_edges(edges)
    ranks = _entity_ranks(cols)
    return wide.select(entity, *[_class_expr(ranks[c].cast("double"), inner).alias(c) for c in cols])


def diff_target(wide: DataFrame, classes: list[str], variant_classes: dict[str, str],
                entity: str = "entity") -> tuple[DataFrame, str]:
    """Best variant (highest mean) per class; label 0 if first - second > 0 else 1.

    Returns the frame ``(entity, <A>__<B>)`` and the target name.  Only the
    first two classes are compared, as in the reference.
    """
    cols = [c for c in wide.columns if c != entity and c in variant_classes]
    means = fused_agg(wide, {f"m{i}": F.avg(q(c)) for i, c in enumerate(cols)})
    best: dict[str, tuple[str, float]] = {}
    for i, c in enumerate(cols):
        mv = means[f"m{i}"]
        cls = variant_classes[c]
        if mv is None:
            continue
        if cls not in best or mv > best[cls][1]:
            best[cls] = (c, mv)
    a, b = best[classes[0]][0], best[classes[1]][0]
    name = f"{a}__{b}"
    label = F.when(q(a) - q(b) > 0, 0.0).otherwise(1.0)
    return wide.select(entity, label.alias(name)), name
