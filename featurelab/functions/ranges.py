"""Running sums over groups of any size, by range partitions.

Rows are dealt by ``repartitionByRange`` on (groups, order), so a group of any size, and a
value of any frequency that further order columns tell apart, is spread over partitions of
about equal size.  Each partition is sorted and takes prefix sums; a small table of
(group, partition) totals gives the offsets.  Sampled range bounds may differ from one
execution to the next, so the partitioned rows are stored before both uses of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurelab.functions.wide import q
from featurelab.session import cut_lineage, ship_package


def _prefix_sums(weights: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        base = [0] * len(weights)
        for batch in batches:
            cols = list(batch.columns)
            for i, name in enumerate(weights):
                total = np.cumsum(batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)) + base[i]
                cols.append(pa.array(np.concatenate(([base[i]], total[:-1])) if len(total) else total))
                base[i] = int(total[-1]) if len(total) else base[i]
            cols.append(pa.array(np.full(batch.num_rows, part, np.int32)))
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, *(f"_range_cum{i}" for i in range(len(weights))), "_range_part"])
    return run


def ranged_sums_before(df: DataFrame, groups: list[str], order: list[str], weights: list[str], out: list[str],
                       parts: int | None = None) -> DataFrame:
    """``df`` with ``out[i]`` = sum of the integer column ``weights[i]`` (not null, not
    negative) over the rows of the same group that stand before the row in ``order``.

    ``order`` should be total within a group: rows equal in it stand in some order.  A null
    group is a group.  ``parts`` range partitions; by default the session's shuffle partitions."""
    spark = df.sparkSession
    ship_package(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*groups, *order]
    sums = [f"_range_cum{i}" for i in range(len(weights))]
    dealt = df.repartitionByRange(parts, *[q(c) for c in keys]).sortWithinPartitions(*[q(c) for c in keys])
    schema = T.StructType([*df.schema.fields, *(T.StructField(s, T.LongType()) for s in sums), T.StructField("_range_part", T.IntegerType())])
    rows = cut_lineage(dealt.mapInArrow(_prefix_sums(weights), schema))
    # one row per group and partition that holds it: groups + parts rows at most
    per = rows.groupBy(*[q(g) for g in groups], "_range_part").agg(
        *[F.min(s).alias(f"_range_first{i}") for i, s in enumerate(sums)], *[F.sum(q(w)).cast("long").alias(f"_range_tot{i}") for i, w in enumerate(weights)])
    before = Window.partitionBy(*[q(g) for g in groups]).orderBy("_range_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(*[q(g).alias(f"_range_g{i}") for i, g in enumerate(groups)], F.col("_range_part").alias("_range_p"), *[
        (F.coalesce(F.sum(f"_range_tot{i}").over(before), F.lit(0)) - F.col(f"_range_first{i}")).alias(f"_range_off{i}") for i in range(len(weights))])
    on = [F.col("_range_part") == F.col("_range_p"), *[q(g).eqNullSafe(F.col(f"_range_g{i}")) for i, g in enumerate(groups)]]
    joined = rows.join(offsets, on)
    return joined.select(*[q(c) for c in df.columns], *[(F.col(s) + F.col(f"_range_off{i}")).alias(o) for i, (s, o) in enumerate(zip(sums, out))])
