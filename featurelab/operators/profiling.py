"""Profiling many entities of a long table in one grouped job.

One ``groupBy(entity)`` pass gives the general and statistical measures of
every value column; information-theoretic measures come from joint counts
``(entity, attribute, class)``.  Output columns are named
``f__profile.<group>.<name>[.<summary>]``; B4 folds the per-column values of a
measure into summaries (mean, sd, min, max) with a second grouped aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featurelab.functions.wide import grouped_quantiles, q, safe_corr

#: Bins of the histogram summary.
N_BINS = 10
STATS = ["mean", "sd", "min", "max", "skewness", "kurtosis", "cv", "median", "iq_range"]


def _stat_exprs(c: str, quartiles: Column) -> dict[str, Column]:
    x = q(c)
    return {
        "mean": F.avg(x), "sd": F.stddev_pop(x), "min": F.min(x), "max": F.max(x),
        "skewness": F.skewness(x), "kurtosis": F.kurtosis(x),
        "cv": F.try_divide(F.stddev_pop(x), F.avg(x)),
        "median": quartiles[1],
        "iq_range": quartiles[2] - quartiles[0],
    }


def _with_quartiles(df: DataFrame, entity: str, cols: list[str], stats: DataFrame, exact: bool) -> DataFrame:
    """``stats`` (a row per entity) with ``_q<i>``: the quartiles of every column, null without values."""
    if exact:
        found = grouped_quantiles(df, [entity], cols, [0.25, 0.5, 0.75])
    else:           # bounded sketch per group
        found = df.groupBy(entity).agg(*[F.percentile_approx(q(c), [0.25, 0.5, 0.75], 10_000).alias(f"_q{i}") for i, c in enumerate(cols)])
    found = found.select(q(entity).alias("_entity"), *[F.col(f"_q{i}") for i in range(len(cols))])
    return stats.join(found, q(entity).eqNullSafe(F.col("_entity")), "left").drop("_entity")


def general(df: DataFrame, entity: str, numeric: list[str], categorical: list[str], cls: str | None) -> DataFrame:
    """B1: rows, attributes, numeric / categorical / binary columns, classes per entity."""
    aggs = [F.count(F.lit(1)).cast("double").alias("f__profile.general.nr_inst")]
    binary = [F.when(F.countDistinct(q(c)) == 2, 1).otherwise(0) for c in numeric + categorical]
    aggs.append(sum(binary, F.lit(0)).cast("double").alias("f__profile.general.nr_bin"))
    if cls is not None:
        aggs.append(F.countDistinct(q(cls)).cast("double").alias("f__profile.general.nr_class"))
    out = df.groupBy(entity).agg(*aggs)
    return out.select(entity, F.lit(float(len(numeric) + len(categorical))).alias("f__profile.general.nr_attr"),
                      F.lit(float(len(numeric))).alias("f__profile.general.nr_num"),
                      F.lit(float(len(categorical))).alias("f__profile.general.nr_cat"),
                      *[q(c) for c in out.columns if c != entity])


def statistical(df: DataFrame, entity: str, numeric: list[str], exact: bool = True) -> DataFrame:
    """B2: per entity and value column: mean, sd, min, max, skewness, kurtosis, cv, median, IQR.

    Quantiles are exact at any size (an entity is spread over many tasks), bounded sketches
    only if ``exact`` is False.
    """
    order, late = [], {}
    aggs = []
    for i, c in enumerate(numeric):
        for name, e in _stat_exprs(c, F.col(f"_q{i}")).items():
            e = F.nanvl(e.cast("double"), F.lit(None)).alias(f"f__profile.statistical.{name}.{c}")
            order.append(f"f__profile.statistical.{name}.{c}")
            if name in ("median", "iq_range"):
                late[order[-1]] = e
            else:
                aggs.append(e)
    j = _with_quartiles(df, entity, numeric, df.groupBy(entity).agg(*aggs), exact)
    return j.select(q(entity), *[late.get(n, q(n)) for n in order])


def statistical_more(df: DataFrame, entity: str, numeric: list[str]) -> DataFrame:
    """B2, the measures that ``statistical`` has not: per entity and value column the variance,
    the median absolute deviation and the share of outliers (beyond 1.5 IQR of the quartiles),
    and per pair of columns the correlation (of the rows that hold both)."""
    name = "f__profile.statistical."
    aggs = [F.var_pop(q(c)).alias(f"{name}var.{c}") for c in numeric]
    aggs += [safe_corr(q(a), q(b)).alias(f"{name}cor.{a}.{b}") for i, a in enumerate(numeric) for b in numeric[i + 1:]]
    st = _with_quartiles(df, entity, numeric, df.groupBy(entity).agg(*aggs), True)
    bounds = st.select(q(entity).alias("_e"), *[F.col(f"_q{i}") for i in range(len(numeric))])
    j = df.join(bounds, q(entity).eqNullSafe(F.col("_e")))
    away, share = [], []
    for i, c in enumerate(numeric):
        lo, mid, hi = (F.col(f"_q{i}")[k] for k in range(3))
        away.append(F.abs(q(c) - mid).alias(c))
        out = (q(c) < lo - 1.5 * (hi - lo)) | (q(c) > hi + 1.5 * (hi - lo))
        share.append(F.avg(F.when(q(c).isNotNull(), out.cast("double"))).alias(f"{name}outlier_share.{c}"))
    mad = grouped_quantiles(j.select(q(entity), *away), [entity], numeric, [0.5])
    mad = mad.select(q(entity).alias("_m"), *[F.col(f"_q{i}")[0].alias(f"{name}mad.{c}") for i, c in enumerate(numeric)])
    share = j.groupBy(q(entity).alias("_s")).agg(*share)
    out = st.drop(*[f"_q{i}" for i in range(len(numeric))]).join(mad, q(entity).eqNullSafe(F.col("_m")), "left")
    return out.join(share, q(entity).eqNullSafe(F.col("_s")), "left").drop("_m", "_s")


def summarise(stat_wide: DataFrame, entity: str, numeric: list[str], measures: list[str] = STATS,
              summaries: tuple[str, ...] = ("mean", "sd", "min", "max")) -> DataFrame:
    """Fold the per-column values of each measure into summary scalars.

    ``summaries`` may name any of mean, sd, min, max, median, range, iq_range, skewness,
    kurtosis (excess, as in B2), count, quantiles (five columns) and histogram (shares in
    ``N_BINS`` equal bins from min to max).  sd, skewness and kurtosis are of the population.
    """
    cols = []
    for m in measures:
        vals = F.array(*[q(f"f__profile.statistical.{m}.{c}") for c in numeric])
        nn = F.filter(vals, lambda v: v.isNotNull())
        n = F.size(nn).cast("double")
        mean = F.try_divide(F.aggregate(nn, F.lit(0.0), lambda a, v: a + v), n)
        var = F.try_divide(F.aggregate(nn, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)), n)
        fns = {"mean": mean, "sd": F.sqrt(var), "min": F.array_min(nn), "max": F.array_max(nn)}
        moment = lambda k: F.try_divide(F.aggregate(nn, F.lit(0.0), lambda a, v: a + F.pow(v - mean, F.lit(k))), n)
        ordered = F.sort_array(nn)

        def at(p: float) -> Column:
            """Interpolated percentile of the values; null without values."""
            x = F.lit(float(p)) * (n - 1)
            lo, hi = (F.try_element_at(ordered, (g(x) + 1).cast("int")) for g in (F.floor, F.ceil))
            return F.when(n > 0, lo + (hi - lo) * (x - F.floor(x)))

        low, wide_by = F.array_min(nn), F.array_max(nn) - F.array_min(nn)
        bin_of = lambda v: F.when(wide_by > 0, F.least(F.floor(F.try_divide(v - low, wide_by) * N_BINS), F.lit(N_BINS - 1))).otherwise(0)
        share = lambda b: F.try_divide(F.size(F.filter(nn, lambda v: bin_of(v) == b)).cast("double"), n)
        fns |= {"median": at(0.5), "range": wide_by, "iq_range": at(0.75) - at(0.25), "count": n,
                "skewness": F.try_divide(moment(3), F.pow(var, F.lit(1.5))), "kurtosis": F.try_divide(moment(4), var * var) - 3}
        parts = {"quantiles": {i: at(i / 4) for i in range(5)},
                 "histogram": {b: share(b) for b in range(N_BINS)}}
        for s in summaries:
            if s in parts:
                cols += [e.alias(f"f__profile.statistical.{m}.{s}.{i}") for i, e in parts[s].items()]
                continue
            cols.append(fns[s].alias(f"f__profile.statistical.{m}.{s}"))
    return stat_wide.select(entity, *cols)


def info_theory(df: DataFrame, entity: str, attr: str, cls: str) -> DataFrame:
    """Class entropy, attribute entropy, joint entropy, mutual information (bits),
    equivalent number of attributes and noise-to-signal ratio for one categorical attribute."""
    j = df.where(q(attr).isNotNull() & q(cls).isNotNull()).groupBy(entity, attr, cls).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(entity)
    j = j.withColumn("n", F.sum("c").over(w)) \
         .withColumn("ca", F.sum("c").over(Window.partitionBy(entity, attr))) \
         .withColumn("cc", F.sum("c").over(Window.partitionBy(entity, cls)))

    def h(col_count: str, first_of: list[str]) -> Column:
        # entropy over distinct values: sum once per value (row_number == 1 within the value)
        return -F.sum(F.when(F.col(f"_first_{'_'.join(first_of)}") == 1,
                             (F.col(col_count) / F.col("n")) * F.log2(F.col(col_count) / F.col("n"))))
    j = j.withColumn(f"_first_{attr}", F.row_number().over(Window.partitionBy(entity, attr).orderBy(cls))) \
         .withColumn(f"_first_{cls}", F.row_number().over(Window.partitionBy(entity, cls).orderBy(attr)))
    st = j.groupBy(entity).agg(
        h("cc", [cls]).alias("h_class"), h("ca", [attr]).alias("h_attr"),
        (-F.sum((F.col("c") / F.col("n")) * F.log2(F.col("c") / F.col("n")))).alias("h_joint"))
    mi = F.col("h_class") + F.col("h_attr") - F.col("h_joint")
    return st.select(entity,
                     F.col("h_class").alias("f__profile.info-theory.class_ent"),
                     F.col("h_attr").alias(f"f__profile.info-theory.attr_ent.{attr}"),
                     F.col("h_joint").alias(f"f__profile.info-theory.joint_ent.{attr}"),
                     mi.alias(f"f__profile.info-theory.mut_inf.{attr}"),
                     F.try_divide(F.col("h_class"), mi).alias("f__profile.info-theory.eq_num_attr"),
                     F.try_divide(F.col("h_attr") - mi, mi).alias("f__profile.info-theory.ns_ratio"))


def bin_numeric(c: Column, width: float) -> Column:
    """Numeric -> categorical by fixed-width bins."""
    return F.floor(c / width).cast("int").cast("string")


def one_hot_counts(df: DataFrame, entity: str, cat: str, categories: list[str]) -> DataFrame:
    """B5 (categorical encoding) per entity: count of each category, ``pivot`` with the
    explicit category list (no distinct scan)."""
    return df.groupBy(entity).pivot(cat, categories).agg(F.count(F.lit(1))) \
             .select(entity, *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(f"{cat}={c}") for c in categories])


def rescale_per_entity(df: DataFrame, entity: str, cols: list[str], method: str = "standard",
                       exact: bool = True) -> DataFrame:
    """B5 (rescale) inside each entity: standard (population sd, 0 -> 1), min-max (constant -> 0)
    or robust ((x - median) / IQR, 0 -> 1).

    The statistics come from a grouped aggregate (partial on the map side) joined back on the
    entity key -- not a window over the entity, which would put a hot entity in one task.
    """
    if method == "standard":
        aggs = [F.avg(q(c)).alias(f"_a{i}") for i, c in enumerate(cols)] + \
               [F.stddev_pop(q(c)).alias(f"_b{i}") for i, c in enumerate(cols)]
    elif method == "minmax":
        aggs = [F.min(q(c)).alias(f"_a{i}") for i, c in enumerate(cols)] + \
               [(F.max(q(c)) - F.min(q(c))).alias(f"_b{i}") for i, c in enumerate(cols)]
    elif method == "robust":
        st = _with_quartiles(df, entity, cols, df.select(entity).distinct(), exact)
        st = st.select(entity, *[F.col(f"_q{i}")[1].alias(f"_a{i}") for i in range(len(cols))],
                       *[(F.col(f"_q{i}")[2] - F.col(f"_q{i}")[0]).alias(f"_b{i}") for i in range(len(cols))])
    else:
        raise ValueError(method)
    if method != "robust":
        st = df.groupBy(entity).agg(*aggs)
    # null-safe: rows without an entity are an entity of their own
    st = st.withColumnRenamed(entity, "_entity")
    j = df.join(st, q(entity).eqNullSafe(F.col("_entity")))
    out = []
    for i, c in enumerate(cols):
        scale = F.when(F.col(f"_b{i}") == 0, F.lit(1.0)).otherwise(F.col(f"_b{i}"))
        out.append(((q(c) - F.col(f"_a{i}")) / scale).alias(c))
    return j.select(*[q(x) for x in df.columns if x not in cols], *out)
