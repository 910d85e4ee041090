"""Scores and result analytics, all plain aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featurelab.functions.ranks import average_rank, sums_before


# ---------------------------------------------------------------- J9, J10 ---

def balanced_accuracy(pred: DataFrame, groups: list[str], y: str = "y", yhat: str = "pred") -> DataFrame:
    """Mean over classes of recall, per group."""
    per_cls = pred.groupBy(*groups, y).agg(F.avg(F.when(F.col(yhat) == F.col(y), 1.0).otherwise(0.0)).alias("rec"))
    return per_cls.groupBy(*groups).agg(F.avg("rec").alias("b_acc"))


def weighted_f1(pred: DataFrame, groups: list[str], y: str = "y", yhat: str = "pred") -> DataFrame:
    """Support-weighted mean of per-class F1, from the counts of (class, predicted class)."""
    n = pred.groupBy(*groups, F.col(y).alias("_y"), F.col(yhat).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    zero = F.lit(0).cast("long")
    each = F.explode(F.array(
        F.struct(F.col("_y").alias("cls"), F.col("_n").alias("sup"), zero.alias("npred"),
                 F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(zero).alias("tp")),
        F.struct(F.col("_p").alias("cls"), zero.alias("sup"), F.col("_n").alias("npred"), zero.alias("tp"))))
    st = n.select(*groups, each.alias("s")).groupBy(*groups, "s.cls").agg(*[F.sum(f"s.{c}").alias(c) for c in ("tp", "sup", "npred")])
    f1 = F.when(F.col("sup") + F.col("npred") > 0, 2.0 * F.col("tp") / (F.col("sup") + F.col("npred"))).otherwise(0.0)
    return st.groupBy(*groups).agg((F.sum(f1 * F.col("sup")) / F.sum("sup")).alias("f1"))


def roc_auc(pred: DataFrame, groups: list[str], y: str = "y", score: str = "p") -> DataFrame:
    """Binary ROC-AUC by the rank-sum (Mann-Whitney) formula with average ranks for ties."""
    r = average_rank(pred, groups, score, "_r")
    return r.groupBy(*groups).agg(
        F.sum(F.when(F.col(y) == 1, F.col("_r")).otherwise(0.0)).alias("_sr"),
        F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("_np"),
        F.sum(F.when(F.col(y) != 1, 1).otherwise(0)).alias("_nn"),
    ).select(*groups, F.try_divide(F.col("_sr") - F.col("_np") * (F.col("_np") + 1) / 2.0,
                                   (F.col("_np") * F.col("_nn")).cast("double")).alias("roc"))


def roc_auc_ovo(pred: DataFrame, groups: list[str], classes: list[float], y: str = "y", probs: str = "probs") -> DataFrame:
    """ROC-AUC one against one, weighted by the rows of each pair of classes.

    ``probs`` holds the score of every class of ``classes`` (two or more, known to the model).
    The AUC of a against b ranks the rows of both by the score of a; a pair counts the mean
    of both directions.  All directions come from the counts of (class scored, score, true
    class) by running sums; rows never meet classes or each other.  Pairs of which a group
    lacks a class are left out; null if none is left."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_a"), F.get(probs, F.lit(i)).alias("_s")) for i in range(len(classes))]))
    counts = (pred.select(*groups, F.col(y).alias("_y"), each.alias("e")).where(F.col("e._s").isNotNull())
              .groupBy(*groups, F.col("e._a").alias("_a"), F.col("e._s").alias("_s"))
              .agg(*[F.count_if(F.col("_y") == F.lit(c)).alias(f"_n{i}") for i, c in enumerate(classes)]))
    every = range(len(classes))
    run = sums_before(counts, [*groups, "_a"], ["_s"], [f"_n{i}" for i in every], [f"_b{i}" for i in every])
    own = F.coalesce(*[F.when(F.col("_a") == i, F.col(f"_n{i}")) for i in every])
    wins = run.groupBy(*groups, "_a").agg(*[F.sum(own * (F.col(f"_b{i}") + F.col(f"_n{i}") / 2.0)).alias(f"_w{i}") for i in every],
                                          *[F.sum(f"_n{i}").alias(f"_t{i}") for i in every])
    mine = F.coalesce(*[F.when(F.col("_a") == i, F.col(f"_t{i}")) for i in every])
    # a row per direction, keyed by the unordered pair
    pair = F.explode(F.array(*[F.struct(F.least(F.col("_a"), F.lit(i)).alias("lo"), F.greatest(F.col("_a"), F.lit(i)).alias("hi"),
                                        F.try_divide(F.col(f"_w{i}"), mine * F.col(f"_t{i}")).alias("auc"),
                                        (mine + F.col(f"_t{i}")).alias("rows")) for i in every]))
    both = wins.select(*groups, pair.alias("s")).where((F.col("s.lo") < F.col("s.hi")) & F.col("s.auc").isNotNull())
    return both.groupBy(*groups).agg((F.sum(F.col("s.auc") * F.col("s.rows")) / F.sum("s.rows")).alias("roc"))


def score_table(pred: DataFrame, groups: list[str], classes: list[float] | None = None) -> DataFrame:
    """b_acc, f1 (weighted), roc per group of a prediction table (y, pred, and p, the score
    of class 1; with ``classes`` also ``probs``, the scores of all of them)."""
    roc = roc_auc(pred, groups) if classes is None else roc_auc_ovo(pred, groups, classes)
    return balanced_accuracy(pred, groups).join(weighted_f1(pred, groups), groups).join(roc, groups, "left")


def fold_summary(scores: DataFrame, groups: list[str], metrics: list[str]) -> DataFrame:
    """Mean and sample sd over folds per metric, plus the number of folds."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"test_{m}_mean"), F.stddev_samp(m).alias(f"test_{m}_std")]
    return scores.groupBy(*groups).agg(*aggs, F.count(F.lit(1)).alias("samples"))


# ---------------------------------------------------------------- L2 .. L9 --

def importance_fraction(imp: DataFrame, groups: list[str], k: int = 5, value: str = "importance") -> DataFrame:
    """L2: share of the top-k columns (by abs importance) in the total."""
    w = Window.partitionBy(*groups).orderBy(F.abs(value).desc(), "feature")
    r = imp.withColumn("_r", F.row_number().over(w))
    return r.groupBy(*groups).agg(
        F.try_divide(F.sum(F.when(F.col("_r") <= k, F.abs(value)).otherwise(0.0)), F.sum(F.abs(value)))
        .alias("fraction"))


def top_methods(results: DataFrame, by: list[str], method: str = "method", score: str = "score",
                n: int = 3) -> DataFrame:
    """L4: top-n methods per group by mean score."""
    m = results.groupBy(*by, method).agg(F.avg(score).alias("mean_score"))
    w = Window.partitionBy(*by).orderBy(F.col("mean_score").desc(), method)
    return m.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def top3_share(results: DataFrame, cell: list[str], method: str = "method", score: str = "score") -> DataFrame:
    """Percent of cells in which a method is among the top 3."""
    top = top_methods(results, cell, method, score, 3)
    n_cells = results.select(*cell).distinct().count()
    return top.groupBy(method).agg((F.count(F.lit(1)) * 100.0 / F.lit(n_cells)).alias("share"))


def centroids(results: DataFrame, method: str, cols: list[str]) -> DataFrame:
    """Mean of each column per method."""
    return results.groupBy(method).agg(*[F.avg(c).alias(f"mean_{c}") for c in cols])


def clean_label(label: Column, suffix_sep: str, name_map: dict[str, str]) -> Column:
    """Strip the suffix after ``suffix_sep``, keep the text before '(', map names."""
    base = F.trim(F.substring_index(F.substring_index(label, suffix_sep, 1), "(", 1))
    mapping = F.create_map(*[x for kv in name_map.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.coalesce(F.element_at(mapping, base), base)


def jaccard_stability(selected: DataFrame, run: str, groups: list[str], runs: DataFrame | None = None) -> DataFrame:
    """Mean pairwise Jaccard of the selected sets of runs within each group.

    ``selected`` has (groups..., run, feature) rows; ``runs`` lists (groups..., run) of all
    runs, so that those which kept nothing count (default: runs with a feature).  The Jaccard
    of two empty sets is 0.  Intersections come from a join on (groups, feature) -- each
    feature row meets the rows of the same feature only, never all pairs of a group; set
    sizes come from counts.
    """
    kept = selected.select(*groups, F.col(run).alias("_r"), "feature").distinct()
    sizes = kept.groupBy(*groups, "_r").agg(F.count(F.lit(1)).alias("_n"))
    if runs is not None:
        grid = runs.select(*groups, F.col(run).alias("_r")).distinct()
        sizes = grid.join(sizes, [*groups, "_r"], "left").fillna(0, ["_n"])
    a = kept.withColumnRenamed("_r", "_ra")
    b = kept.withColumnRenamed("_r", "_rb")
    inter = a.join(b, [*groups, "feature"]).where(F.col("_ra") < F.col("_rb")) \
             .groupBy(*groups, "_ra", "_rb").agg(F.count(F.lit(1)).alias("_i"))
    pairs = sizes.alias("x").join(sizes.alias("y"), groups).where(F.col("x._r") < F.col("y._r")) \
                 .select(*groups, F.col("x._r").alias("_ra"), F.col("y._r").alias("_rb"),
                         F.col("x._n").alias("_na"), F.col("y._n").alias("_nb"))
    j = pairs.join(inter, [*groups, "_ra", "_rb"], "left").fillna(0, ["_i"])
    union = F.col("_na") + F.col("_nb") - F.col("_i")
    jac = F.when(union > 0, F.col("_i") / union).otherwise(0.0)
    return j.groupBy(*groups).agg(F.avg(jac).alias("jaccard"))


def summaries(results: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, sample sd, count and a normal-theory 95 % interval per group."""
    s = results.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
                                 F.count(value).alias("n"))
    half = F.try_divide(1.959963984540054 * F.col("sd"), F.sqrt(F.col("n")))
    return s.withColumn("lo", F.col("mean") - half).withColumn("hi", F.col("mean") + half)


def linear_attribution(df: DataFrame, weights: dict[str, float], groups: list[str] | None = None) -> DataFrame:
    """L1 (linear models): mean abs SHAP value per column, avg(abs(w * (x - mean(x)))),
    exact for a linear model.  Means per group come from one aggregate (joined back on
    the group keys, or literals when there is no group), attributions from a second."""
    from featurelab.functions.wide import fused_agg, to_long
    groups = groups or []
    feats = list(weights)
    if groups:
        means = df.groupBy(*groups).agg(*[F.avg(F.col(f"`{f}`")).alias(f"_m{i}") for i, f in enumerate(feats)])
        j = df.join(means, groups)
        mcol = {f: F.col(f"_m{i}") for i, f in enumerate(feats)}
    else:
        st = fused_agg(df, {f"_m{i}": F.avg(F.col(f"`{f}`")) for i, f in enumerate(feats)})
        j = df
        mcol = {f: F.lit(st[f"_m{i}"]) for i, f in enumerate(feats)}
    out = j.groupBy(*groups).agg(*[
        F.avg(F.abs(F.lit(float(weights[f])) * (F.col(f"`{f}`") - mcol[f]))).alias(f) for f in feats])
    return to_long(out, groups, feats, "feature", "attribution")
