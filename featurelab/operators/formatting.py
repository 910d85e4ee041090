"""Collapsing folds, rounding count columns, family filter, metric aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelab.functions.wide import grouped_quantiles, q
from featurelab.sources.tables import nan_to_null, numeric_columns


def collapse_folds(df: DataFrame, key: str, agg_func: str = "median",
                   exclude: tuple[str, ...] = ("fold",), approx: bool | None = False) -> DataFrame:
    """Per entity median (else mean) of every numeric column; null keys dropped.

    ``median`` is exact (Spark's percentile keeps the values of one group; the
    groups here are the few fold rows of one entity).  ``approx=None`` is exact as well, for
    groups with very many rows: a group is spread over many tasks.  ``approx=True`` uses
    ``percentile_approx``.
    """
    feats = numeric_columns(df, exclude=(key, *exclude))
    if approx is None and agg_func == "median":
        src = df.where(F.col(key).isNotNull()).select(key, *[nan_to_null(q(c).cast("double")).alias(c) for c in feats])
        found = grouped_quantiles(src, [key], feats, [0.5])
        return src.select(key).distinct().join(found, key, "left") \
                  .select(key, *[F.col(f"_q{i}")[0].alias(c) for i, c in enumerate(feats)])
    if agg_func == "median":
        agg = (lambda c: F.percentile_approx(c, 0.5, 10_000)) if approx else F.median
    else:
        agg = F.avg
    return df.where(F.col(key).isNotNull()) \
             .groupBy(key) \
             .agg(*[agg(nan_to_null(q(c).cast("double"))).alias(c) for c in feats])


def round_counts(df: DataFrame, round_attrs: list[str]) -> DataFrame:
    """Round count-like columns half to even."""
    present = set(round_attrs) & set(df.columns)
    return df.select(*[F.bround(q(c), 0).alias(c) if c in present else q(c) for c in df.columns])


def filter_families(df: DataFrame, families: list[str] | None, keys: list[str],
                    family_prefix: str = "f__gen.", feature_prefix: str = "f__") -> DataFrame:
    """Drop columns of the named families and every column not starting with ``f__``."""
    if families is None:
        return df
    prefixes = [f"{family_prefix}{fam}" for fam in families]
    keep = [c for c in df.columns
            if c in keys or (c.startswith(feature_prefix) and not any(c.startswith(p) for p in prefixes))]
    return df.select(*[q(c) for c in keep])


def aggregate_metrics(df: DataFrame, entity: str = "entity", variant: str = "variant",
                      source: str = "hparam_source", default: str = "default",
                      agg_func: str = "mean", metrics: list[str] | None = None) -> DataFrame:
    """C4: default rows only, then mean (or median) per (entity, variant).

    The filter is a plain predicate, so Catalyst pushes it into the parquet scan
    of the source; the aggregate is partial (map-side) then final.
    """
    metrics = metrics or numeric_columns(df, exclude=(entity, variant, source, "fold"))
    agg = F.median if agg_func == "median" else F.avg
    return df.where(F.col(source) == default) \
             .groupBy(entity, variant) \
             .agg(*[agg(nan_to_null(F.col(m).cast("double"))).alias(m) for m in metrics])
