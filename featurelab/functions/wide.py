"""A5 and P5: layouts and fused wide aggregates.

Three interchangeable layouts: *wide* (one double column per feature), *long*
``(key, feature, value)`` and *vector* (``array<double>``).  Wide -> long uses
``unpivot`` (nulls kept), long -> wide uses ``pivot`` with the explicit feature
list so that no distinct scan runs.  ``fused_agg`` evaluates many per-column
statistics in ONE aggregate pass; only the per-feature numbers reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def q(name: str) -> Column:
    """Column by a name that may contain dots."""
    return F.col(f"`{name}`")


def to_long(df: DataFrame, keys: list[str], features: list[str],
            name: str = "feature", value: str = "value") -> DataFrame:
    if not features:
        return df.select(*keys, F.lit(None).cast("string").alias(name),
                         F.lit(None).cast("double").alias(value)).where(F.lit(False))
    # unpivot takes dotted strings as nested paths, so rename to positional
    # aliases first and map the names back with a literal array lookup.
    tmp = [f"_c{i}" for i in range(len(features))]
    base = df.select(*[q(k) for k in keys], *[q(f).cast("double").alias(t) for f, t in zip(features, tmp)])
    long_df = base.unpivot(keys, tmp, "_pos", value)
    names = F.array(*[F.lit(f) for f in features])
    pos = F.substring(F.col("_pos"), 3, 10).cast("int")
    return long_df.select(*[q(k) for k in keys], F.element_at(names, pos + 1).alias(name), F.col(value))


def to_wide(long_df: DataFrame, keys: list[str], features: list[str],
            name: str = "feature", value: str = "value") -> DataFrame:
    return long_df.groupBy(*keys).pivot(name, features).agg(F.first(value))


def to_vector(df: DataFrame, features: list[str], out: str = "features") -> Column:
    return F.array(*[q(f).cast("double") for f in features]).alias(out)


def fused_agg(df: DataFrame, exprs: dict[str, Column]) -> dict:
    """P5: evaluate ``exprs`` (alias -> aggregate Column) in one pass, return a dict."""
    if not exprs:
        return {}
    row = df.agg(*[e.alias(k) for k, e in exprs.items()]).collect()[0]
    return row.asDict()


# Results are compared across engines after rounding to 6 decimals.  Decimal-like
# data (prices with 2 digits, shares over 2^k rows) often gives means that sit
# exactly on a rounding tie, where 1-ulp summation-order noise would flip the
# last digit.  A nudge away from zero, far below the 6th decimal and not a short
# decimal itself, moves every tie to the same side in both engines.
NUDGE_REL = 4e-15
NUDGE_ABS = 1e-13
NUDGE_FACTOR = 1.0471975511965976


def round6(c: Column) -> Column:
    return F.round(c + F.signum(c) * (F.abs(c) * NUDGE_REL + NUDGE_ABS) * NUDGE_FACTOR, 6)


def sql_round6(x: str) -> str:
    return f"round({x} + sign({x}) * (abs({x}) * 4e-15 + 1e-13) * 1.0471975511965976, 6)"


# Accuracy of the sketches that a caller may ask for in place of exact quantiles.
APPROX_ACCURACY = 100_000


def column_quantiles(df: DataFrame, features: list[str], ps: list[float], exact: bool = True) -> dict[str, list[float]]:
    """Quantiles of whole columns on the driver (columns without a value are missing);
    a bounded sketch only if ``exact`` is False."""
    if exact:
        from featurelab.functions.order_stats import exact_quantiles
        return {r["feature"]: list(r["quantiles"]) for r in exact_quantiles(df, [], features, ps).collect()}
    st = fused_agg(df, {f"p{i}": F.percentile_approx(q(c), ps, APPROX_ACCURACY) for i, c in enumerate(features)})
    return {c: list(st[f"p{i}"]) for i, c in enumerate(features) if st[f"p{i}"] is not None}


def grouped_quantiles(df: DataFrame, groups: list[str], features: list[str], ps: list[float]) -> DataFrame:
    """``exact_quantiles`` as one row per group: columns ``_q<i>`` (array, null without values)
    in the order of ``features``."""
    from featurelab.functions.order_stats import exact_quantiles
    found = exact_quantiles(df, groups, features, ps)
    return found.groupBy(*[q(g) for g in groups]).agg(
        *[F.max(F.when(F.col("feature") == f, F.col("quantiles"))).alias(f"_q{i}") for i, f in enumerate(features)])


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation that is null (not an ANSI divide-by-zero error) when either
    side has zero variance: covar_pop / (stddev_pop(x) * stddev_pop(y)).  Pairs with a
    null on either side are left out of all three aggregates."""
    both = x.isNotNull() & y.isNotNull()
    xx = F.when(both, x)
    yy = F.when(both, y)
    return F.try_divide(F.covar_pop(xx, yy), F.stddev_pop(xx) * F.stddev_pop(yy))
