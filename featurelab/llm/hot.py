"""Joining rows back to the classes they form, when a few classes hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import free_name

#: Classes with more than one row in so many are dealt out over several tasks.  The class
#: sizes sum to the rows, so at most so many classes are hot and broadcast.
HOT_SHARE = 1000


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], size_col: str, n: int, spread: Column) -> DataFrame:
    """Inner join of ``rows`` (``n`` of them) with ``classes`` (one row per key combination,
    ``size_col`` its number of rows).  A class larger than ``n / HOT_SHARE`` is repeated once
    per share of that size, and its rows are dealt over the repeats by ``spread``, a
    deterministic integer expression on ``rows``.  Keys hold no nulls."""
    share = max(1, n // HOT_SHARE)
    part, parts = free_name(rows, "part"), free_name(rows, "parts")
    sized = classes.withColumn(parts, F.ceil(F.col(size_col) / F.lit(share)).cast("int"))
    hot = sized.filter(F.col(parts) > 1).select(*keys, parts)
    dealt = (rows.join(F.broadcast(hot), keys, "left")
             .withColumn(part, F.pmod(spread, F.coalesce(F.col(parts), F.lit(1))).cast("int")).drop(parts))
    whole = sized.withColumn(part, F.explode(F.sequence(F.lit(0), F.greatest(F.col(parts), F.lit(1)) - 1))).drop(parts)
    return dealt.join(whole, [*keys, part]).drop(part)
