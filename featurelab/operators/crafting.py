"""Crafted uninformative columns.

Random values are keyed (P4): a value depends on (seed, entity key, column
name) only, so crafted columns are reproducible under any partitioning and
after recomputation.  Which columns are corrupted or multiplied is decided on
the column *names* (a driver-side list of at most F names), with the same
keyed rule.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurelab.functions.keyed import keyed_gamma, keyed_normal, keyed_poisson, keyed_uniform
from featurelab.functions.wide import q

SEP = "___"


def name_uniform(seed, *parts) -> float:
    """Python twin of keyed_uniform for names (plan-time choices)."""
    text = ":".join([str(seed), *[str(p) for p in parts]])
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2 ** 52


def noise_column(dist: str, seed, key: Column, name: str, gamma_shape: float = 1.0) -> Column:
    if dist == "normal":
        return keyed_normal(seed, key, F.lit(name))
    if dist == "uniform":
        return keyed_uniform(seed, key, F.lit(name))
    if dist == "poisson":
        return keyed_poisson(seed, 1.0, key, F.lit(name))
    if dist == "gamma":
        return keyed_gamma(seed, gamma_shape, key, F.lit(name))
    raise ValueError(f"unknown distribution {dist!r}")


def pick_names(features: list[str], k: int, seed, tag: str) -> list[str]:
    return sorted(features, key=lambda f: (name_uniform(seed, tag, f), f))[:k]


def _round(seed, r: int, x: int, half: int) -> int:
    return int(hashlib.md5(f"{seed}:pair{r}:{x}".encode()).hexdigest()[:13], 16) & ((1 << half) - 1)


def pick_pairs(features: list[str], k: int, seed) -> list[tuple[str, str]]:
    """``k`` distinct pairs of columns (all, if there are fewer), in drawn order.

    Pair numbers 0 .. F(F-1)/2 - 1 are permuted by a keyed four-round Feistel network on the
    next power of four (numbers beyond the last pair are permuted again), and the first k are
    turned into pairs: about k steps, whatever F."""
    total = len(features) * (len(features) - 1) // 2
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    out = []
    for i in range(min(k, total)):
        n = i
        while True:
            left, right = n >> half, n & ((1 << half) - 1)
            for r in range(4):
                left, right = right, left ^ _round(seed, r, right, half)
            n = left << half | right
            if n < total:
                break
        b = (1 + math.isqrt(8 * n + 1)) // 2         # pair (a, b), a < b: number b(b-1)/2 + a
        out.append((features[n - b * (b - 1) // 2], features[b]))
    return out


def add_noise(df: DataFrame, key: str, n: int, dist: str = "normal", seed: int = 42,
              gamma_shape: float = 1.0) -> DataFrame:
    """G1: ``n`` noise columns ``noise___<dist>_<i>``."""
    cols = [noise_column(dist, seed, F.col(key), f"noise{SEP}{dist}_{i}", gamma_shape).alias(f"noise{SEP}{dist}_{i}")
            for i in range(n)]
    return df.select("*", *cols)


def add_corrupted(df: DataFrame, unscaled: DataFrame, key: str, names: list[str], coeff: float = 0.5,
                  seed: int = 42, mode: str = "mix", scale: float = 1.0) -> DataFrame:
    """``corrupted___<f>`` = c*x + (1-c)*noise with x from the unscaled stage (joined on key);
    ``mode="additive"``: x + N(0, scale) (the shift experiment)."""
    src = unscaled.select(key, *[q(n).alias(f"_u_{i}") for i, n in enumerate(names)])
    j = df.join(src, key, "left")
    cols = []
    for i, n in enumerate(names):
        z = keyed_normal(seed, F.col(key), F.lit(f"corrupted{SEP}{n}"))
        x = F.col(f"_u_{i}")
        v = coeff * x + (1 - coeff) * z if mode == "mix" else x + scale * z
        cols.append(v.alias(f"corrupted{SEP}{n}"))
    return j.select(*[q(c) for c in df.columns], *cols)


def add_second_order(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Products ``so___<a>_<b>`` of sampled distinct pairs."""
    return df.select("*", *[(q(a) * q(b)).alias(f"so{SEP}{a}_{b}") for a, b in pairs])


def craft(df: DataFrame, unscaled: DataFrame, key: str, random_percent: float = 0.0,
          corrupted_percent: float = 0.0, second_order_percent: float = 0.0, dist: str = "normal",
          corrupt_coeff: float = 0.5, seed: int = 42) -> tuple[DataFrame, str]:
    """All three kinds; returns the frame and the suffix of the kinds used."""
    feats = [c for c in df.columns if c != key]
    f = len(feats)
    kinds = []
    out = df
    if random_percent:
        out = add_noise(out, key, int(f * random_percent), dist, seed)
        kinds.append(f"random_{dist}")
    if corrupted_percent:
        out = add_corrupted(out, unscaled, key, pick_names(feats, int(f * corrupted_percent), seed, "corrupt"),
                            corrupt_coeff, seed)
        kinds.append("corrupted")
    if second_order_percent:
        out = add_second_order(out, pick_pairs(feats, int(f * second_order_percent), seed))
        kinds.append("second_order")
    return out, "_".join(kinds)


def shift_sources(n_features: int, scenario: str, n_added: int, seed=42) -> list[tuple[int, ...]]:
    """Numbers of the columns that each added one is made of: one with replacement
    (corrupted), two different ones (second_order), none (random)."""
    if scenario == "random":
        return [()] * n_added
    if scenario == "corrupted":
        return [(int(name_uniform(seed, "src", i) * n_features),) for i in range(n_added)]
    if scenario != "second_order":
        raise ValueError(scenario)
    if n_features < 2:
        raise ValueError("products need two columns")
    out = []
    for i in range(n_added):
        a, b = int(name_uniform(seed, "a", i) * n_features), int(name_uniform(seed, "b", i) * (n_features - 1))
        out.append((a, b + (b >= a)))
    return out


def _shifted(feats: list[str], key: str, scenario: str, n_added: int, seed: int, i: Column, x: Column) -> Column:
    """Value of added column number ``i`` of a row with the column values ``x`` (an array)."""
    made_of = shift_sources(len(feats), scenario, n_added, seed)
    of = [F.get(x, F.get(F.array(*[F.lit(m[at]) for m in made_of]), i)) for at in range(len(made_of[0]) if made_of else 0)]
    noise = keyed_normal(seed, F.col(key), F.concat(F.lit("U "), i.cast("string")))
    return noise if not of else of[0] + 0.5 * noise if len(of) == 1 else of[0] * of[1]


def shift_variants(df: DataFrame, key: str, scenario: str, n_added: int = 100, seed: int = 42) -> DataFrame:
    """Add exactly ``n_added`` columns ``U i`` by scenario random / corrupted / second_order.

    All are computed as one array per row: an expression per column would be too much code."""
    feats = [c for c in df.columns if c != key]
    x = F.array(*[q(f).cast("double") for f in feats])
    values = F.transform(F.sequence(F.lit(0), F.lit(n_added - 1)), lambda i: _shifted(feats, key, scenario, n_added, seed, i, F.col("_x")))
    wide = df.withColumn("_x", x).withColumn("_v", values)
    return wide.select(*[q(c) for c in df.columns], *[F.get("_v", F.lit(i)).alias(f"U {i}") for i in range(n_added)])


def shift_variants_long(df: DataFrame, key: str, scenario: str, n_added: int = 100,
                        seed: int = 42) -> DataFrame:
    """G5 in long layout ``(key, feature, value)``: the same values as ``shift_variants``, one row
    per row and added column."""
    feats = [c for c in df.columns if c != key]
    idx = F.explode(F.sequence(F.lit(0), F.lit(n_added - 1))).alias("_i")
    base = df.select(key, F.array(*[q(f).cast("double") for f in feats]).alias("_x"), idx)
    return base.select(key, F.concat(F.lit("U "), F.col("_i").cast("string")).alias("feature"),
                       _shifted(feats, key, scenario, n_added, seed, F.col("_i"), F.col("_x")).alias("value"))


def added_share(n_original: int, n_added: int) -> float:
    return 100.0 * n_added / (n_original + n_added) if n_original + n_added else math.nan
