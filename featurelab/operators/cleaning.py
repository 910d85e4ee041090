"""Cleaning the features and metrics tables.

Drop decisions are taken from ONE aggregate pass per step (per-column numbers
only reach the driver); row removals are joins or filters on the executors.
The order of the feature steps matters: D1 D2 D3 D4 D5 D6 D7 D8 D9.
"""

from __future__ import annotations

import statistics

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelab.functions.wide import column_quantiles, fused_agg, q
from featurelab.session import cut_lineage


def _features(df: DataFrame, keys: list[str]) -> list[str]:
    return [c for c in df.columns if c not in keys]


def remove_by_func(df: DataFrame, funcs: list[str] | None, keys: list[str]) -> DataFrame:
    """Drop columns whose 4th '.'-part is listed, or with > 3 parts ending in 'relative'.

    Names with three parts or fewer are kept.  Skipped when ``funcs`` is None.
    """
    if funcs is None:
        return df
    drop = []
    for c in _features(df, keys):
        parts = c.split(".")
        if len(parts) <= 3:
            continue
        if parts[-1] == "relative" or parts[3] in funcs:
            drop.append(c)
    return df.drop(*drop)


def remove_entities(df: DataFrame, key: str, names: list | None) -> DataFrame:
    """Drop entities by name (a bounded user list: an `isin` predicate, pushed to the scan)."""
    if names is None:
        return df
    if not names:
        return df
    return df.where(~F.col(key).isin(list(names)))


def remove_by_key(df: DataFrame, substrings: list[str] | None, keys: list[str]) -> DataFrame:
    """D3: drop columns whose name contains any of the substrings."""
    if substrings is None:
        return df
    drop = [c for c in _features(df, keys) if any(s in c for s in substrings)]
    return df.drop(*drop)


def _suitability_exprs(features: list[str]) -> dict:
    exprs = {"__n": F.count(F.lit(1))}
    for i, c in enumerate(features):
        exprs[f"c{i}"] = F.count(q(c))
        exprs[f"lo{i}"] = F.min(q(c))
        exprs[f"hi{i}"] = F.max(q(c))
    return exprs


def _unsuitable_from(st: dict, features: list[str], nan_threshold: float) -> list[str]:
    n = st["__n"]
    drop = []
    for i, c in enumerate(features):
        nulls = n - st[f"c{i}"]
        constant = nulls == 0 and n > 0 and st[f"lo{i}"] == st[f"hi{i}"]
        if nulls > n * nan_threshold or constant:
            drop.append(c)
    return drop


def unsuitable_columns(df: DataFrame, features: list[str], nan_threshold: float = 0.5) -> list[str]:
    return _unsuitable_from(fused_agg(df, _suitability_exprs(features)), features, nan_threshold)


def remove_unsuitable(df: DataFrame, keys: list[str], nan_threshold: float = 0.5) -> DataFrame:
    """Drop columns with more than N*threshold nulls, or constant (no nulls, min = max)."""
    return df.drop(*unsuitable_columns(df, _features(df, keys), nan_threshold))


def outlier_plan(df: DataFrame, features: list[str], threshold: float) -> tuple[list[str], list[str]]:
    """Pass 1 of D5: outlier count per column -> (dropped columns, surviving outlier columns)."""
    exprs = {f"o{i}": F.sum(F.when(F.abs(q(c)) > threshold, 1).otherwise(0))
             for i, c in enumerate(features)}
    st = fused_agg(df, exprs)
    return _outlier_decision({c: (st[f"o{i}"] or 0) for i, c in enumerate(features)})


def _outlier_decision(counts: dict) -> tuple[list[str], list[str]]:
    multi = [v for v in counts.values() if v >= 2]
    # The reference raises on an empty median; here no column is dropped then.
    m = statistics.median(multi) if multi else float("inf")
    dropped = [c for c, v in counts.items() if v > m]
    surviving = [c for c, v in counts.items() if 0 < v <= m]
    return dropped, surviving


def _apply_outliers(df: DataFrame, dropped: list[str], surviving: list[str], threshold: float) -> DataFrame:
    out = df.drop(*dropped)
    if surviving:
        any_out = None
        for c in surviving:
            cond = F.coalesce(F.abs(q(c)) > threshold, F.lit(False))
            any_out = cond if any_out is None else (any_out | cond)
        out = out.where(~any_out)
    return out


def filter_outliers(df: DataFrame, keys: list[str], threshold: float = 10e6) -> DataFrame:
    """Drop columns with more outliers than the median count (over columns with >= 2),
    then every entity with an outlier in a surviving column."""
    feats = _features(df, keys)
    dropped, surviving = outlier_plan(df, feats, threshold)
    return _apply_outliers(df, dropped, surviving, threshold)


def _fill_values(df: DataFrame, feats: list[str], fill_func: str, exact: bool) -> dict[str, float]:
    if fill_func == "median":
        return {c: v[0] for c, v in column_quantiles(df, feats, [0.5], exact).items()}
    st = fused_agg(df, {f"v{i}": F.avg(q(c)) for i, c in enumerate(feats)})
    return {c: st[f"v{i}"] for i, c in enumerate(feats) if st[f"v{i}"] is not None}


def fill_undefined(df: DataFrame, keys: list[str], fill_func: str = "median",
                   exact: bool = True) -> DataFrame:
    """Fill nulls with the column median (else mean); an all-null column stays null.

    The median is exact at any size, a sketch only if ``exact`` is False.
    """
    feats = _features(df, keys)
    values = _fill_values(df, feats, fill_func, exact)
    return df.select(*[F.coalesce(q(c), F.lit(float(values[c]))).alias(c) if c in values else q(c)
                       for c in df.columns])


def _fill_and_drop_constant(df: DataFrame, keys: list[str], fill_func: str = "median",
                            exact: bool = True) -> DataFrame:
    """D6 then D7 from the same rows: after filling with the median of the non-null values a
    column is constant iff it has a non-null value and min = max of the non-null values
    (an all-null column stays null, which is not constant)."""
    feats = _features(df, keys)
    values = _fill_values(df, feats, fill_func, exact)
    exprs = {}
    for i, c in enumerate(feats):
        exprs[f"c{i}"] = F.count(q(c))
        exprs[f"lo{i}"] = F.min(q(c))
        exprs[f"hi{i}"] = F.max(q(c))
    st = fused_agg(df, exprs)
    constant = {c for i, c in enumerate(feats) if st[f"c{i}"] and st[f"lo{i}"] == st[f"hi{i}"]}
    return df.select(*[q(c) for c in keys],
                     *[F.coalesce(q(c), F.lit(float(values[c]))).alias(c) if c in values else q(c)
                       for c in feats if c not in constant])


def constant_columns(df: DataFrame, features: list[str]) -> list[str]:
    exprs = {"__n": F.count(F.lit(1))}
    for i, c in enumerate(features):
        exprs[f"c{i}"] = F.count(q(c))
        exprs[f"lo{i}"] = F.min(q(c))
        exprs[f"hi{i}"] = F.max(q(c))
    st = fused_agg(df, exprs)
    return [c for i, c in enumerate(features)
            if st["__n"] > 0 and st[f"c{i}"] == st["__n"] and st[f"lo{i}"] == st[f"hi{i}"]]


def remove_constant(df: DataFrame, keys: list[str]) -> DataFrame:
    """Drop columns whose values are all equal (a null makes a column non-constant)."""
    return df.drop(*constant_columns(df, _features(df, keys)))


def drop_duplicate_rows(df: DataFrame, key: str) -> DataFrame:
    """Drop rows repeating another row's feature values (key ignored); smallest key survives.

    A group-by on all feature columns: the partial aggregate collapses copies on
    the map side, so a value combination holding a third of the rows costs one
    row per map task in the shuffle.
    """
    feats = _features(df, [key])
    if not feats:
        return df
    return df.groupBy(*[q(c) for c in feats]).agg(F.min(key).alias(key)) \
             .select(*[q(c) for c in df.columns])


def duplicate_columns(df: DataFrame, key: str, features: list[str]) -> list[str]:
    """D9 plan: columns equal (null-safe) to an earlier column, without transposing.

    Pass 1 fingerprints each column (decimal sum of xxhash64(key, value)); pass 2
    checks the candidate pairs exactly with ``sum(if(a <=> b, 0, 1))``.
    """
    if len(features) < 2:
        return []
    norm = {c: (q(c) + F.lit(0.0)) for c in features}   # -0.0 -> 0.0
    fp = fused_agg(df, {f"h{i}": F.sum(F.xxhash64(F.col(key), norm[c]).cast("decimal(38,0)"))
                        for i, c in enumerate(features)})
    first_by_fp: dict = {}
    pairs = []
    for i, c in enumerate(features):
        h = fp[f"h{i}"]
        if h in first_by_fp:
            pairs.append((first_by_fp[h], c))
        else:
            first_by_fp[h] = c
    if not pairs:
        return []
    chk = fused_agg(df, {f"p{j}": F.sum(F.when(norm[a].eqNullSafe(norm[b]), 0).otherwise(1))
                         for j, (a, b) in enumerate(pairs)})
    # a pair whose fingerprints collided but values differ is rare; such a column
    # is simply kept (it is compared only against the first of its fingerprint).
    return [b for j, (a, b) in enumerate(pairs) if chk[f"p{j}"] == 0]


def drop_duplicates(df: DataFrame, key: str) -> DataFrame:
    """D8 then D9."""
    rows = drop_duplicate_rows(df, key)
    return rows.drop(*duplicate_columns(rows, key, _features(rows, [key])))


def filter_variants(df: DataFrame, variants: list[str] | None, variant: str = "variant") -> DataFrame:
    """Keep listed variants only."""
    if variants is None:
        return df
    return df.where(F.col(variant).isin(list(variants)))


def entities_with_all_variants(df: DataFrame, variants: list[str] | None, entity: str = "entity",
                               variant: str = "variant") -> DataFrame:
    """Keep entities whose set of variants equals the list (left-semi join)."""
    if variants is None:
        return df
    wanted = sorted(set(variants))
    ok = df.groupBy(entity).agg(
        F.countDistinct(variant).alias("_nd"),
        F.countDistinct(F.when(F.col(variant).isin(wanted), F.col(variant))).alias("_nin"),
        F.count(F.when(F.col(variant).isNull(), 1)).alias("_nnull"),
    ).where((F.col("_nd") == len(wanted)) & (F.col("_nin") == len(wanted)) & (F.col("_nnull") == 0)) \
     .select(entity)
    return df.join(ok, entity, "left_semi")


def clean_features(df: DataFrame, key: str, funcs_to_exclude=None, entities_to_exclude=None,
                   keys_to_exclude=None, nan_threshold: float = 0.5, value_threshold: float = 10e6,
                   fill_func: str = "median") -> DataFrame:
    """D1..D9 in the reference's order.

    The steps take their drop decisions from several aggregate passes over the
    same entity-level table, so its lineage is cut once with a reliable
    checkpoint (shared ``spark.checkpoint.dir``): later passes read that copy
    instead of recomputing the upstream joins, and a lost executor costs a
    re-read, not a recomputation of the whole chain.
    """
    keys = [key]
    df = cut_lineage(df)
    df = remove_by_func(df, funcs_to_exclude, keys)
    df = remove_entities(df, key, entities_to_exclude)
    df = remove_by_key(df, keys_to_exclude, keys)
    # D4 and the outlier counts of D5 read the same rows: one pass for both.
    feats = _features(df, keys)
    st = fused_agg(df, {**_suitability_exprs(feats),
                        **{f"o{i}": F.sum(F.when(F.abs(q(c)) > value_threshold, 1).otherwise(0))
                           for i, c in enumerate(feats)}})
    drop4 = _unsuitable_from(st, feats, nan_threshold)
    df = df.drop(*drop4)
    kept = [c for c in feats if c not in set(drop4)]
    dropped5, surviving5 = _outlier_decision({c: (st[f"o{feats.index(c)}"] or 0) for c in kept})
    df = _apply_outliers(df, dropped5, surviving5, value_threshold)
    # D6 medians and the D7 constant test read the same (filtered) rows: one pass.
    df = _fill_and_drop_constant(df, keys, fill_func)
    return drop_duplicates(df, key)


def clean_metrics(df: DataFrame, entities_to_exclude=None, variants=None,
                  entity: str = "entity", variant: str = "variant") -> DataFrame:
    """D2, D10, D11 on the long metrics table."""
    df = remove_entities(df, entity, entities_to_exclude)
    df = filter_variants(df, variants, variant)
    return entities_with_all_variants(df, variants, entity, variant)
