"""Exact order statistics without a shuffle of the values.

Interpolated percentiles, the definition of ``F.percentile``, at every size:

* groups of few cells (rows x features): one aggregate whose states hold the values;
* larger groups: a mergeable sketch brackets every percentile; one counting pass over the
  rows counts what lies below each bracket and, map-side first, the values inside; the
  two order statistics around the percentile are picked from those.  Two passes, and only
  counts and about ``4 / ACCURACY`` of the values per percentile are shuffled;
* if the brackets would cover most values (many percentiles), or do not hold the ranks,
  running counts of all distinct values.

All three give the same numbers; which one runs depends on measured sizes only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurelab.functions.ranks import running_sum_before
from featurelab.functions.wide import q, to_long
from featurelab.session import cut_lineage

#: Cells of one group whose values an aggregate state may hold (about 80 bytes each).
STATE_CELLS = 1_000_000
#: Accuracy of the bracketing sketch: ranks are off by at most n / ACCURACY.
ACCURACY = 2_000


def _interpolated(x: Column, lo: Column, hi: Column) -> Column:
    between = (F.ceil(x) - x) * lo + (x - F.floor(x)) * hi
    return F.when((F.ceil(x) == F.floor(x)) | (lo == hi), lo).otherwise(between)


def _by_state(keyed: DataFrame, gs: list[str], feats: list[str], names: list[str], ps: list[float]) -> DataFrame:
    wide = keyed.groupBy(*gs).agg(*[F.percentile(F.col(f), [float(p) for p in ps]).alias(f) for f in feats])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f).alias("quantiles")) for f, n in zip(feats, names)]))
    return wide.select(*gs, each.alias("s")).select(*gs, "s.feature", "s.quantiles").where(F.col("quantiles").isNotNull())


def _picked(counted: DataFrame, gs: list[str], totals: DataFrame, ps: list[float]) -> DataFrame:
    """From (gs, _f, _v, _n, _before) of all values, the percentiles of every (gs, _f)."""
    at = [F.lit(float(p)) * (F.col("_total") - 1) for p in ps]
    covers = [(F.col("_before") <= k) & (k < F.col("_before") + F.col("_n")) for x in at for k in (F.floor(x), F.ceil(x))]
    picks = [F.max(F.when(hit, F.col("_v"))).alias(f"_p{i}") for i, hit in enumerate(covers)]
    found = counted.join(totals, [*gs, "_f"]).groupBy(*gs, "_f", "_total").agg(*picks)
    out = [_interpolated(x, F.col(f"_p{2 * i}"), F.col(f"_p{2 * i + 1}")) for i, x in enumerate(at)]
    return found.select(*gs, "_f", F.array(*out).alias("quantiles"))


def _by_counts(keyed: DataFrame, gs: list[str], feats: list[str], ps: list[float]) -> DataFrame:
    """All distinct values counted, and their running counts."""
    long_df = to_long(keyed, gs, feats, "_f", "_v").where(F.col("_v").isNotNull())
    ties = cut_lineage(long_df.groupBy(*gs, "_f", "_v").agg(F.count(F.lit(1)).alias("_n")))
    counted = running_sum_before(ties, [*gs, "_f"], ["_v"], "_n", "_before")
    return _picked(counted, gs, ties.groupBy(*gs, "_f").agg(F.sum("_n").alias("_total")), ps)


def _by_brackets(keyed: DataFrame, gs: list[str], feats: list[str], ps: list[float]) -> DataFrame | None:
    """(gs, _f, quantiles), or None if some bracket does not hold its ranks."""
    order = sorted(range(len(ps)), key=lambda j: ps[j])
    off = 2.0 / ACCURACY
    probs = [x for j in order for x in (max(0.0, ps[j] - off), min(1.0, ps[j] + off))]
    sketch = [F.percentile_approx(F.col(f), probs, ACCURACY).alias(f"_s{i}") for i, f in enumerate(feats)]
    if gs:
        ends = cut_lineage(keyed.groupBy(*gs).agg(*sketch))
        rows = keyed.join(ends, gs)
        end = lambda i, j: F.get(F.col(f"_s{i}"), F.lit(j))
    else:
        st = keyed.agg(*sketch).first()
        rows = keyed
        end = lambda i, j: F.lit(None if st[f"_s{i}"] is None else float(st[f"_s{i}"][j])).cast("double")
    cells = []
    for i, f in enumerate(feats):
        v = F.col(f)
        inside, above = F.lit(False), F.lit(0)
        for j in range(len(ps)):
            inside = inside | ((v >= end(i, 2 * j)) & (v <= end(i, 2 * j + 1)))
            above = above + (v >= end(i, 2 * j)).cast("int")       # how many brackets begin at or below v
        cells.append(F.when(v.isNotNull(), F.struct(F.lit(f).alias("_f"), above.alias("_r"), F.when(inside, v).alias("_v"))))
    counts = cut_lineage(rows.select(*gs, F.explode(F.array(*cells)).alias("c")).where(F.col("c").isNotNull())
                         .groupBy(*gs, "c._f", "c._r", "c._v").agg(F.count(F.lit(1)).alias("_n")))
    base = counts.groupBy(*gs, "_f").agg(
        F.sum("_n").alias("_total"), *[F.sum(F.when(F.col("_r") <= j, F.col("_n")).otherwise(0)).alias(f"_below{j}") for j in range(len(ps))])
    # every bracket is a group of its own: its values, and the ranks that it must hold
    spans = [F.struct(F.lit(j).alias("_j"), F.col(f"_below{j}").alias("_below"),
                      (F.lit(float(ps[order[j]])) * (F.col("_total") - 1)).alias("_x")) for j in range(len(ps))]
    spans = base.select(*gs, "_f", F.explode(F.array(*spans)).alias("s")).select(*gs, "_f", "s.*")
    # values of a bracket: those from its begin on that some bracket holds; later ones do no harm
    held = counts.where(F.col("_v").isNotNull()).select(*gs, "_f", "_v", "_n", F.explode(F.sequence(F.lit(0), F.col("_r") - 1)).alias("_j"))
    # values that lie between brackets are missing from later ones' counts, so a bracket ends with its own
    limits = F.create_map(*[x for i, f in enumerate(feats) for x in (F.lit(f), F.array(*[end(i, 2 * j + 1) for j in range(len(ps))]))])
    if gs:
        held = held.join(ends, gs)
    held = held.where(F.col("_v") <= F.get(F.element_at(limits, F.col("_f")), F.col("_j"))).select(*gs, "_f", "_j", "_v", "_n")
    run = running_sum_before(held, [*gs, "_f", "_j"], ["_v"], "_n", "_inside").join(spans, [*gs, "_f", "_j"])
    before = F.col("_below") + F.col("_inside")
    hit = lambda k: F.max(F.when((before <= k) & (k < before + F.col("_n")), F.col("_v")))
    picked = run.groupBy(*gs, "_f", "_j", "_x").agg(hit(F.floor("_x")).alias("_lo"), hit(F.ceil("_x")).alias("_hi"))
    found = cut_lineage(spans.select(*gs, "_f", "_j").join(
        picked.select(*gs, "_f", "_j", _interpolated(F.col("_x"), F.col("_lo"), F.col("_hi")).alias("_q")), [*gs, "_f", "_j"], "left"))
    if not found.where(F.col("_q").isNull()).isEmpty():
        return None
    cols = [F.max(F.when(F.col("_j") == order.index(i), F.col("_q"))) for i in range(len(ps))]
    return found.groupBy(*gs, "_f").agg(F.array(*cols).alias("quantiles"))


def exact_quantiles(df: DataFrame, groups: list[str], features: list[str], ps: list[float],
                    state_cells: int | None = None) -> DataFrame:
    """(*groups, feature, quantiles): the interpolated percentiles ``ps`` of every column in
    every group; no row where a column has no value.  A null group is a group.  Groups of more
    than ``state_cells`` (default ``STATE_CELLS``) rows x features are never held by one state."""
    gs = [f"_g{i}" for i in range(len(groups))]
    feats = [f"_c{i}" for i in range(len(features))]
    # a null group is one of its own: joins below must not lose it
    keyed = df.select(*[F.struct(q(g)).alias(n) for g, n in zip(groups, gs)],
                      *[q(f).cast("double").alias(c) for f, c in zip(features, feats)])
    limit = max(1, (state_cells or STATE_CELLS) // max(1, len(features)))
    parts = []
    if groups:
        big = cut_lineage(keyed.groupBy(*gs).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > limit).select(*gs))
        if big.isEmpty():
            parts, large = [keyed], None
        else:
            parts, large = [keyed.join(big, gs, "left_anti")], keyed.join(big, gs, "left_semi")
    elif keyed.count() <= limit:
        parts, large = [keyed], None
    else:
        large = keyed
    out = [_by_state(p, gs, feats, features, ps) for p in parts]
    if large is not None:
        found = _by_brackets(large, gs, feats, ps) if len(ps) * 4 < ACCURACY / 4 else None
        found = _by_counts(large, gs, feats, ps) if found is None else found
        names = F.create_map(*[x for c, n in zip(feats, features) for x in (F.lit(c), F.lit(n))])
        out.append(found.select(*gs, F.element_at(names, F.col("_f")).alias("feature"), "quantiles"))
    res = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    return res.select(*[F.col(n)[g].alias(g) for g, n in zip(groups, gs)], "feature", "quantiles")
