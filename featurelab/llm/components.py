"""Connected components of an edge table by rounds of contraction.

Every round each node points to the neighbour of lowest pseudorandom priority (itself, if
none is lower) and edges move to the nodes pointed to.  At least a constant share of the
nodes that still have edges goes each round, so rounds grow with the logarithm of the
input.  Degrees do not matter: the minimum is taken map-side first, and the joins are
plain equi-joins whose hot keys Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import written


def _priority(c: str):
    return F.struct(F.xxhash64(F.col(c)).alias("p"), F.col(c).alias("id"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b: long); root is some node of
    the component.  Loops, repeated and reversed edges and an empty table are fine; rows
    with a null end are ignored."""
    # written once: the edges are often dear to compute and read twice a round
    e = written(edges.select("a", "b").filter("a is not null and b is not null").distinct(), "given", narrow=True)
    steps = []
    while not e.isEmpty():           # loops are in the first round only, so that every node has a step there
        both = e.select(F.col("a").alias("node"), _priority("b").alias("to")).unionByName(
            e.select(F.col("b").alias("node"), _priority("a").alias("to")))
        low = both.groupBy("node").agg(F.min("to").alias("to"))
        step = written(low.select("node", F.least(_priority("node"), F.col("to"))["id"].alias("up")), "step", narrow=True)
        moved = (e.join(step.withColumnsRenamed({"node": "a", "up": "na"}), "a")
                 .join(step.withColumnsRenamed({"node": "b", "up": "nb"}), "b")
                 .filter("na != nb"))
        e = written(moved.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct(),
                    "edges", narrow=True)
        steps.append(step)
    if not steps:
        return e.toDF("node", "root")
    # labels follow the steps of all rounds in one job; steps shrink from round to round
    labels = steps[0].withColumnRenamed("up", "root")
    for step in steps[1:]:
        labels = (labels.join(step.withColumnRenamed("node", "root"), "root", "left")
                  .select("node", F.coalesce("up", "root").alias("root")))
    return written(labels, "labels", narrow=True) if len(steps) > 1 else labels
