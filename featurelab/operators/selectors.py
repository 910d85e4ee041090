"""Filter selectors computed for every (training fold, target) in one job.

Input: a wide table ``(key, fold, features..., targets...)`` where ``fold`` is
the test fold of the row (H1).  The training rows of fold k are the rows with
``fold != k``.  Additive statistics (class sums, counts, moments, joint bin
counts) are computed once per (row fold, ...) and the training value of fold k
is *total - part of fold k*: no row is replicated.  Spearman needs ranks, which
are not additive: every row gets its rank among the training rows of each fold
from per-fold running counts (P1), still without copying rows.

Every selector returns the tidy frame
``(fold, target, feature, n, score, kept)``; ``selection`` adds ``rank`` by
abs(score) desc, ties by feature name, and keeps the rejected rows with a null
rank so that empty selections stay visible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featurelab.functions.ranks import fold_average_ranks, sums_before
from featurelab.functions.special import p_value_chi2, p_value_f, pearson_p_value
from featurelab.functions.wide import q, safe_corr, to_long
from featurelab.session import cut_lineage, ship_package


def _folds_array(k: int) -> Column:
    return F.array(*[F.lit(i) for i in range(k)])


def _train_folds(fold: Column, k: int) -> Column:
    return F.filter(_folds_array(k), lambda f: f != fold)


# ----------------------------------------------------------------- I1 base --

def base_selector(df: DataFrame, key: str, features: list[str], targets: list[str], k: int) -> DataFrame:
    """Keep every feature with score 0 (a tiny frame derived from the schema)."""
    grid = df.select(F.explode(_folds_array(k)).alias("fold")).distinct()
    feats = F.explode(F.array(*[F.lit(f) for f in features])).alias("feature")
    tg = F.explode(F.array(*[F.lit(t) for t in targets])).alias("target")
    n = df.groupBy("fold").count()
    total = df.count()
    out = grid.select("fold", tg).select("fold", "target", feats)
    out = out.join(n.withColumnRenamed("count", "_nf"), "fold", "left") \
             .withColumn("n", F.lit(total) - F.coalesce(F.col("_nf"), F.lit(0))).drop("_nf")
    return out.select("fold", "target", "feature", F.col("n").cast("long"),
                      F.lit(0.0).alias("score"), F.lit(True).alias("kept"))


# ------------------------------------------------------- I2 correlation -----

def correlation_selector(df: DataFrame, key: str, features: list[str], targets: list[str], k: int,
                         method: str = "spearman", p_threshold: float = 0.05,
                         abs_threshold: float = 0.2) -> DataFrame:
    """Keep if p <= p_threshold and abs(r) >= abs_threshold (spearman or pearson).

    No row is copied to its training folds: each row carries one value per training fold
    t (its average rank among the rows with fold != t, P1 per fold; for pearson the raw
    value), and the correlation of fold t is a masked ``corr`` over the rows with
    fold != t.  One aggregate per feature gives all k x T correlations.
    """
    ship_package(df.sparkSession)        # the p-values are Arrow UDFs
    base = df.select(key, "fold", *[q(c).cast("double").alias(c) for c in features + targets])
    xl = to_long(base, [key, "fold"], features)
    yl = to_long(base, [key, "fold"], targets, name="target", value="y")
    if method == "spearman":
        xr = fold_average_ranks(xl, ["feature"], "value", k, prefix="_x")
        yr = fold_average_ranks(yl, ["target"], "y", k, prefix="_y")
    else:
        xr = xl.select("*", *[F.col("value").alias(f"_x{t}") for t in range(k)])
        yr = yl.select("*", *[F.col("y").alias(f"_y{t}") for t in range(k)])
    # targets back to one row per key: a conditional aggregate with the explicit target list
    yw = yr.groupBy(key).agg(*[F.max(F.when(F.col("target") == tg, F.col(f"_y{t}"))).alias(f"_y{i}_{t}")
                               for i, tg in enumerate(targets) for t in range(k)])
    j = xr.join(yw, key)
    aggs = []
    for t in range(k):
        train = F.col("fold") != t
        for i, _tg in enumerate(targets):
            xv = F.when(train, F.col(f"_x{t}"))
            yv = F.when(train, F.col(f"_y{i}_{t}"))
            aggs += [safe_corr(xv, yv).alias(f"r{t}_{i}"),
                     F.count(F.when(xv.isNotNull() & yv.isNotNull(), 1)).alias(f"n{t}_{i}")]
    st = j.groupBy("feature").agg(*aggs)
    packed = F.explode(F.array(*[F.struct(F.lit(t).alias("fold"), F.lit(tg).alias("target"),
                                          F.col(f"r{t}_{i}").alias("r"), F.col(f"n{t}_{i}").alias("n"))
                                 for t in range(k) for i, tg in enumerate(targets)]))
    res = st.select("feature", packed.alias("s")) \
            .select(F.col("s.fold").alias("fold"), F.col("s.target").alias("target"), "feature",
                    F.col("s.n").cast("long").alias("n"), F.nanvl(F.col("s.r"), F.lit(None)).alias("score"))
    p = pearson_p_value(F.col("score"), F.col("n"))
    kept = F.coalesce((p <= p_threshold) & (F.abs("score") >= abs_threshold), F.lit(False))
    return res.withColumn("kept", kept)


# ------------------------------------------------------- additive stats -----

def _fold_totals(stats: DataFrame, keys: list[str], value_cols: list[str], k: int) -> DataFrame:
    """From per-(row fold, keys) sums derive per-(training fold, keys) sums = total - own fold."""
    tot = stats.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in value_cols])
    grid = tot.select(*keys, *value_cols, F.explode(_folds_array(k)).alias("train_fold"))
    own = stats.select(*keys, F.col("fold").alias("train_fold"),
                       *[F.col(c).alias(f"_own_{c}") for c in value_cols])
    j = grid.join(own, [*keys, "train_fold"], "left")
    return j.select("train_fold", *keys,
                    *[(F.col(c) - F.coalesce(F.col(f"_own_{c}"), F.lit(0))).alias(c) for c in value_cols])


def _class_sums(df: DataFrame, features: list[str], targets: list[str], moments: int) -> DataFrame:
    """Long (fold, target, cls, feature, cnt, s1[, s2]) from one pass over the wide rows; cnt
    counts the rows in which the feature is present."""
    yl = df.select("fold", *[q(f).cast("double").alias(f) for f in features],
                   F.explode(F.array(*[F.struct(F.lit(t).alias("target"), q(t).cast("double").alias("cls"))
                                       for t in targets])).alias("_t")) \
           .select("fold", "_t.target", "_t.cls", *[q(f) for f in features]) \
           .where(F.col("cls").isNotNull())
    aggs = []
    for i, f in enumerate(features):
        aggs += [F.count(q(f)).alias(f"n_{i}"), F.coalesce(F.sum(q(f)), F.lit(0.0)).alias(f"s1_{i}")]
        if moments >= 2:
            aggs.append(F.coalesce(F.sum(q(f) * q(f)), F.lit(0.0)).alias(f"s2_{i}"))
    g = yl.groupBy("fold", "target", "cls").agg(*aggs)
    structs = []
    for i, f in enumerate(features):
        fields = [F.lit(f).alias("feature"), F.col(f"n_{i}").alias("cnt"), F.col(f"s1_{i}").alias("s1")]
        if moments >= 2:
            fields.append(F.col(f"s2_{i}").alias("s2"))
        structs.append(F.struct(*fields))
    cols = ["s1", "s2"] if moments >= 2 else ["s1"]
    return g.select("fold", "target", "cls", F.explode(F.array(*structs)).alias("_f")) \
            .select("fold", "target", "cls", "_f.cnt", "_f.feature", *[F.col(f"_f.{c}").alias(c) for c in cols])


def chi2_selector(df: DataFrame, key: str, features: list[str], targets: list[str], k: int,
                  p_threshold: float = 0.05) -> DataFrame:
    """Chi-square of non-negative features summed per class; keep if p <= threshold."""
    ship_package(df.sparkSession)
    neg = df.select(*[F.min(q(f)).alias(f) for f in features]).collect()[0]
    bad = [f for f in features if neg[f] is not None and neg[f] < 0]
    if bad:
        raise ValueError(f"chi-square needs non-negative features: {bad[:5]}")
    cs = _class_sums(df, features, targets, 1)
    tr = _fold_totals(cs, ["target", "cls", "feature"], ["cnt", "s1"], k)
    w_all = Window.partitionBy("train_fold", "target", "feature")
    e = tr.withColumn("n", F.sum("cnt").over(w_all)) \
          .withColumn("ftot", F.sum("s1").over(w_all)) \
          .withColumn("ncls", F.count(F.when(F.col("cnt") > 0, 1)).over(w_all)) \
          .where(F.col("cnt") > 0) \
          .withColumn("exp", F.col("ftot") * F.col("cnt") / F.col("n")) \
          .withColumn("term", F.try_divide((F.col("s1") - F.col("exp")) ** 2, F.col("exp")))
    st = e.groupBy("train_fold", "target", "feature").agg(
        F.first("n").alias("n"), F.sum("term").alias("stat"), F.first("ncls").alias("ncls"))
    p = p_value_chi2(F.col("stat"), (F.col("ncls") - 1).cast("double"))
    return st.select(F.col("train_fold").alias("fold"), "target", "feature", F.col("n").cast("long"),
                     F.col("stat").alias("score"),
                     F.coalesce(p <= p_threshold, F.lit(False)).alias("kept"))




def f_value_selector(df: DataFrame, key: str, features: list[str], targets: list[str], k: int,
                     p_threshold: float = 0.05, quantile_value: float = 0.5) -> DataFrame:
    """One-way ANOVA F; keep if p <= threshold and F >= the median F of the (fold, target)."""
    ship_package(df.sparkSession)
    # sums about each column's mean: squares keep their digits whatever the mean
    means = df.agg(*[F.avg(q(f)).alias(f"m{i}") for i, f in enumerate(features)]).first()
    about = df.select("fold", *[q(t) for t in targets if t not in features],
                      *[(q(f).cast("double") - F.lit(means[i] or 0.0)).alias(f) for i, f in enumerate(features)])
    cs = _class_sums(about, features, targets, 2)
    tr = _fold_totals(cs, ["target", "cls", "feature"], ["cnt", "s1", "s2"], k).where(F.col("cnt") > 0)
    st = tr.groupBy("train_fold", "target", "feature").agg(
        F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("ncls"),
        F.sum("s1").alias("t1"), F.sum("s2").alias("t2"),
        F.sum(F.col("s1") * F.col("s1") / F.col("cnt")).alias("b"))
    ss_tot = F.col("t2") - F.col("t1") * F.col("t1") / F.col("n")
    ss_between = F.col("b") - F.col("t1") * F.col("t1") / F.col("n")
    ss_within = ss_tot - ss_between
    dfb = (F.col("ncls") - 1).cast("double")
    dfw = (F.col("n") - F.col("ncls")).cast("double")
    fstat = F.try_divide(F.try_divide(ss_between, dfb), F.try_divide(ss_within, dfw))
    st = st.select(F.col("train_fold").alias("fold"), "target", "feature", F.col("n").cast("long"),
                   fstat.alias("score"), dfb.alias("dfb"), dfw.alias("dfw"))
    w = Window.partitionBy("fold", "target")
    med = F.percentile(F.col("score"), quantile_value).over(w)
    p = p_value_f(F.col("score"), F.col("dfb"), F.col("dfw"))
    st = st.withColumn("p_ok", F.coalesce(p <= p_threshold, F.lit(False)))
    kept = F.coalesce(F.col("p_ok") & (F.abs("score") >= med), F.lit(False))
    return st.withColumn("kept", kept).drop("dfb", "dfw")


def mutual_info_selector(df: DataFrame, key: str, features: list[str], targets: list[str], k: int,
                         n_bins: int = 10, quantile_value: float = 0.9) -> DataFrame:
    """I4 (binned): MI of feature bins and classes; keep if MI >= the ``quantile_value`` quantile
    of the (fold, target) scores.

    Bins are of equal frequency in each training set: a value belongs to the bin
    floor(n_bins * (training values below it) / (training values)), so equal values share a
    bin and no row of the test fold moves a bin.  Counts below come from running counts per
    fold over distinct values (P1): training = total - fold.
    MI = sum p(x,y) log(p(x,y) / (p(x) p(y))) in nats."""
    base = df.select("fold", *[q(c).cast("double").alias(c) for c in dict.fromkeys([*features, *targets])])
    yl = to_long(base, ["fold", *targets], features)
    rows = yl.select("fold", "feature", "value", F.explode(F.array(*[F.struct(F.lit(t).alias("target"), q(t).alias("cls"))
                                                                     for t in targets])).alias("_t")) \
             .select("fold", "feature", "value", "_t.target", "_t.cls") \
             .where(F.col("value").isNotNull() & F.col("cls").isNotNull())
    # one row per (target, feature, value, class) with its rows in each fold; written once, read twice
    counts = cut_lineage(rows.groupBy("target", "feature", "value", "cls").agg(*[F.count_if(F.col("fold") == f).alias(f"_n{f}") for f in range(k)]))
    folds = [f"_n{f}" for f in range(k)]
    g = ["target", "feature"]
    values = counts.groupBy(*g, "value").agg(*[F.sum(c).alias(c) for c in folds])
    below = sums_before(values, g, ["value"], folds, [f"_b{f}" for f in range(k)])
    totals = counts.groupBy(*g).agg(*[F.sum(c).alias(f"_t{f}") for f, c in enumerate(folds)])
    others = lambda p, t: sum((F.col(f"{p}{f}") for f in range(k) if f != t), F.lit(0))
    bins = below.join(totals, g).select(*g, "value", *[F.try_divide(F.lit(n_bins) * others("_b", t), others("_t", t)).cast("int").alias(f"_bin{t}")
                                                       for t in range(k)])
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("train_fold"), F.col(f"_bin{t}").alias("bin"), others("_n", t).alias("c")) for t in range(k)]))
    tr = counts.join(bins, [*g, "value"]).select(*g, "cls", each.alias("s")).where(F.col("s.c") > 0) \
               .groupBy("s.train_fold", *g, "s.bin", "cls").agg(F.sum("s.c").alias("c"))
    wg = Window.partitionBy("train_fold", "target", "feature")
    tr = tr.withColumn("n", F.sum("c").over(wg)) \
           .withColumn("cx", F.sum("c").over(Window.partitionBy("train_fold", "target", "feature", "bin"))) \
           .withColumn("cy", F.sum("c").over(Window.partitionBy("train_fold", "target", "feature", "cls")))
    term = (F.col("c") / F.col("n")) * F.log(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy")))
    st = tr.groupBy("train_fold", "target", "feature").agg(F.first("n").alias("n"), F.sum(term).alias("score"))
    st = st.select(F.col("train_fold").alias("fold"), "target", "feature", F.col("n").cast("long"), "score")
    thr = F.percentile(F.col("score"), quantile_value).over(Window.partitionBy("fold", "target"))
    return st.withColumn("kept", F.coalesce(F.col("score") >= thr, F.lit(False)))


# --------------------------------------------------------------- I11, I12 ---

def selection(result: DataFrame) -> DataFrame:
    """Rank kept features by abs(score) desc (ties: feature name); rejected rank null."""
    w = Window.partitionBy("fold", "target", "kept").orderBy(F.abs("score").desc_nulls_last(), "feature")
    return result.withColumn("rank", F.when(F.col("kept"), F.row_number().over(w)).cast("int"))


def empty_selections(result: DataFrame) -> DataFrame:
    """(fold, target) cells where nothing was kept (the reference's error records)."""
    cells = result.select("fold", "target").distinct()
    hits = result.where("kept").select("fold", "target").distinct()
    return cells.join(hits, ["fold", "target"], "left_anti")


def multi_output(result: DataFrame, score_name: str, targets: list[str]) -> DataFrame:
    """One score column per target named ``<target>__<score>`` (null = rejected);
    features rejected for every target are dropped."""
    s = result.select("fold", "feature", "target", F.when(F.col("kept"), F.col("score")).alias("s"))
    wide = s.groupBy("fold", "feature").pivot("target", targets).agg(F.first("s"))
    any_kept = None
    for t in targets:
        c = F.col(t).isNotNull()
        any_kept = c if any_kept is None else (any_kept | c)
    return wide.where(any_kept).select("fold", "feature", *[F.col(t).alias(f"{t}__{score_name}") for t in targets])


def selected_features(selection_df: DataFrame, fold: int, target: str) -> list[str]:
    """I14 helper: the kept names of one cell in rank order (at most F names)."""
    rows = selection_df.where((F.col("fold") == fold) & (F.col("target") == target) & F.col("kept")) \
                       .select("feature", "rank").collect()
    return [r[0] for r in sorted(rows, key=lambda r: r[1])]


def project_to_selection(df: DataFrame, selection_df: DataFrame, key: str, fold: int | None = None,
                         target: str | None = None) -> DataFrame:
    """The features table restricted to one cell's selection (default: all columns)."""
    if fold is None or target is None:
        return df
    names = selected_features(selection_df, fold, target)
    return df.select(key, *[q(n) for n in names])


# ------------------------------------------------- I4, nearest neighbours ---
RADIUS_SHRINK = 1e-12

def ksg_mutual_info_selector(df: DataFrame, key: str, features: list[str], targets: list[str], k: int,
                             n_neighbors: int = 3, quantile_value: float = 0.9,
                             rows_per_bucket: int | None = None) -> DataFrame:
    """I4 with the nearest-neighbour estimator (continuous feature x class).

    For row i of class c (n_c rows in the training fold, n_c > 1):
      k_i = min(n_neighbors, n_c - 1); r_i = distance to its k_i-th nearest same-class
      neighbour (among k lags and k leads of the (feature, class)-sorted order);
      m_i = number of training rows (any class with > 1 row) with |x_j - x_i| < r_i,
      or with x_j = x_i when r_i = 0 (itself included).
    MI = psi(N) + mean psi(k_i) - mean psi(n_c) - mean psi(m_i), floored at 0, in nats.
    m_i is counted with an event union (x+r, 0), (x, 1), (x-r, 2) and distributed running
    counts, so no task holds a whole feature and no pair of rows is formed.
    """
    from featurelab.functions.ranks import ROWS_PER_BUCKET, neighbour_distances, running_sum_before
    from featurelab.functions.special import digamma
    rpb = rows_per_bucket or ROWS_PER_BUCKET
    kk = n_neighbors
    base = df.select(key, "fold", *[q(c).cast("double").alias(c) for c in features + targets]) \
             .withColumn("train_fold", F.explode(_train_folds(F.col("fold"), k))).drop("fold")
    # a cell (training fold, target, feature) is one number: rows that are sorted and dealt stay narrow
    cells = [(t, f) for t in targets for f in features]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), q(f).alias("value"), q(t).alias("cls")) for i, (t, f) in enumerate(cells)]))
    rows = base.select(key, "train_fold", each.alias("_e")) \
               .select(key, (F.col("train_fold") * len(cells) + F.col("_e.c")).alias("_g"), "_e.value", "_e.cls") \
               .where(F.col("value").isNotNull() & F.col("cls").isNotNull())
    g = ["_g"]
    # class sizes by a grouped count (partial aggregate), joined back on the small key set
    sizes = rows.groupBy(*g, "cls").agg(F.count(F.lit(1)).alias("n_c"))
    rows = rows.join(sizes, [*g, "cls"]).where(F.col("n_c") > 1).withColumn("_rid", F.col(key).cast("string"))
    nb = neighbour_distances(rows, g + ["cls"], "value", kk, rpb)
    kcol = F.least(F.lit(kk), F.col("n_c") - 1).cast("int")
    dists = F.array_sort(F.filter(F.array(*[F.col(f"_lag{i}") for i in range(1, kk + 1)],
                                          *[F.col(f"_lead{i}") for i in range(1, kk + 1)]),
                                  lambda d: d.isNotNull()))
    # read three times
    pts = cut_lineage(nb.select(*g, key, "value", "n_c", kcol.alias("k_i"), F.element_at(dists, kcol).alias("r")))
    # events: upper edge (x + r, 0), point (x, 1), lower edge (x - r, 2)
    # the radius is shrunk by a relative 1e-12 (the estimator counts distance < r): the k-th
    # neighbour itself sits at distance r and must stay out whatever the rounding of x + r
    rr = F.col("r") * (1.0 - RADIUS_SHRINK)
    ev = pts.select(*g, key, F.explode(F.array(
        F.struct((F.col("value") + rr).alias("ev"), F.lit(0).alias("kind"), F.lit(0).alias("w")),
        F.struct(F.col("value").alias("ev"), F.lit(1).alias("kind"), F.lit(1).alias("w")),
        F.struct((F.col("value") - rr).alias("ev"), F.lit(2).alias("kind"), F.lit(0).alias("w")))).alias("e")) \
        .select(*g, key, "e.ev", "e.kind", "e.w")
    run = running_sum_before(ev, g, ["ev", "kind", key], "w", "before", rpb)
    # points strictly below x + r: points before the upper event; points <= x - r: before the lower
    # event plus none (the lower event sorts after equal points)
    m = run.groupBy(*g, key).agg(
        F.max(F.when(F.col("kind") == 0, F.col("before"))).alias("up"),
        F.max(F.when(F.col("kind") == 2, F.col("before"))).alias("lo"))
    ties = pts.groupBy(*g, "value").agg(F.count(F.lit(1)).alias("n_tie"))
    full = pts.join(m, [*g, key]).join(ties, [*g, "value"])
    mcol = F.when(F.col("r") > 0, F.col("up") - F.col("lo")).otherwise(F.col("n_tie"))
    st = full.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(digamma(F.col("k_i"))).alias("pk"), F.avg(digamma(F.col("n_c"))).alias("pc"),
        F.avg(digamma(mcol)).alias("pm"))
    mi = F.greatest(F.lit(0.0), digamma(F.col("n")) + F.col("pk") - F.col("pc") - F.col("pm"))
    at = F.col("_g") % len(cells) + 1
    st = st.select(F.floor(F.col("_g") / len(cells)).cast("int").alias("fold"), F.element_at(F.array(*[F.lit(t) for t, _ in cells]), at).alias("target"),
                   F.element_at(F.array(*[F.lit(f) for _, f in cells]), at).alias("feature"), F.col("n").cast("long"), mi.alias("score"))
    thr = F.percentile(F.col("score"), quantile_value).over(Window.partitionBy("fold", "target"))
    return st.withColumn("kept", F.coalesce(F.col("score") >= thr, F.lit(False)))


# ------------------------------------------------- I12 grid over slices -----

def selection_over_slices(result: DataFrame, slices: DataFrame, relative: tuple[str, float] | None = None,
                          absolute_kept: str | None = "kept") -> DataFrame:
    """I12 with H3: the selection of every (slice, iter, fold, target) cell in one job.

    A univariate score does not depend on the other columns of a slice, so ``result``
    (fold, target, feature, n, score, kept) is computed once and joined with the slice
    table (slice, iter, feature) -- names only, a few rows per feature.  What depends on
    the column set is re-evaluated per cell: ``relative = ("median"|"quantile", q)`` keeps a
    feature only if its score is >= the q-quantile of the cell's scores (F value: median,
    mutual information: 0.9), on top of the fixed-threshold flag ``absolute_kept``.
    Ranks are by abs(score) desc, ties by name, per cell.
    """
    j = result.join(slices, "feature")
    cell = ["slice", "iter", "fold", "target"]
    kept = F.col(absolute_kept) if absolute_kept else F.lit(True)
    if relative is not None:
        _kind, qv = relative
        thr = F.percentile(F.col("score"), qv).over(Window.partitionBy(*cell))
        kept = kept & (F.col("score") >= thr)
    j = j.withColumn("kept", F.coalesce(kept, F.lit(False)))
    w = Window.partitionBy(*cell, "kept").orderBy(F.abs("score").desc_nulls_last(), "feature")
    return j.withColumn("rank", F.when(F.col("kept"), F.row_number().over(w)).cast("int"))
