"""A grid of experiment cells, run with bounded concurrency into a table keyed by cell.

Every cell has a folder of its own below the ledger, named by a hash of its key values.
Spark's committer writes ``_SUCCESS`` last, so a folder with that mark is a finished cell
and one without it is not read.  Running a cell overwrites its folder: whatever is killed
and started again, each cell's rows are there once.  The cells still to run are the grid
without the finished ones (left-anti join), so grids may grow between runs.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells in flight; each issues Spark jobs from a driver thread.
CELL_THREADS = 4
CELL = "cell_id"


def cell_id(values: dict) -> str:
    """Name of a cell: a hash of its key values, whatever their order."""
    return hashlib.sha256(json.dumps(values, sort_keys=True, default=str).encode()).hexdigest()[:24]


def grid(spark: SparkSession, axes: dict[str, list], skip: Callable[[dict], bool] | None = None) -> DataFrame:
    """All combinations of the axes (lists of equal type, not empty) with their ``cell_id``,
    without those that ``skip``."""
    cells = [dict(zip(axes, values)) for values in itertools.product(*axes.values())]
    rows = [Row(**{CELL: cell_id(c)}, **c) for c in cells if skip is None or not skip(c)]
    first = spark.createDataFrame([Row(**{CELL: ""}, **cells[0])]).schema
    return spark.createDataFrame(rows, first)


def _folder(path: str, cell: str) -> str:
    return f"{path.rstrip('/')}/{CELL}={cell}"


def finished(spark: SparkSession, path: str) -> DataFrame:
    """(cell_id) of the finished cells of a ledger; none if it does not exist yet."""
    jvm = spark.sparkContext._jvm
    marks = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{CELL}=*/_SUCCESS")
    found = marks.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(marks) or []
    names = [s.getPath().getParent().getName().partition("=")[2] for s in found]
    return spark.createDataFrame([(n,) for n in names], f"{CELL} string")


def read_ledger(spark: SparkSession, path: str, cells: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of the finished cells of ``cells``, with the key columns of each."""
    done = cells.join(finished(spark, path), CELL, "left_semi").select(CELL).collect()
    folders = [_folder(path, r[0]) for r in done]
    if not folders:
        return spark.createDataFrame([], T.StructType([*cells.schema.fields, *schema.fields]))
    rows = spark.read.option("basePath", path).schema(T.StructType([*schema.fields, T.StructField(CELL, T.StringType())])).parquet(*folders)
    return cells.join(rows, CELL).select(*cells.columns, *schema.names)


def run_grid(spark: SparkSession, path: str, cells: DataFrame, run_cell: Callable[[dict], DataFrame],
             threads: int = CELL_THREADS) -> DataFrame:
    """Run ``run_cell`` (key values -> rows, the same schema for every cell) for every cell of
    ``cells`` that is not finished, ``threads`` at a time, and return all rows of the grid.

    If a cell fails, no further cell is started, those in flight end, and its error is
    raised; finished cells stay and the next run goes on from there.  A cell without rows
    counts as finished.  Cells that other grids left in the ledger stay and are not read."""
    todo = cells.join(finished(spark, path), CELL, "left_anti").collect()
    schemas: list[T.StructType] = []

    def run(row: Row) -> None:
        values = {k: v for k, v in row.asDict().items() if k != CELL}
        out = run_cell(values)
        schemas.append(out.schema)
        out.write.mode("overwrite").parquet(_folder(path, row[CELL]))

    waiting, failed = iter(todo), None
    with ThreadPoolExecutor(max_workers=max(1, threads)) as pool:
        flying = {pool.submit(run, r) for r in itertools.islice(waiting, threads)}
        while flying:
            over, flying = wait(flying, return_when=FIRST_COMPLETED)
            failed = failed or next((e for f in over if (e := f.exception())), None)
            if failed is None:
                flying |= {pool.submit(run, r) for r in itertools.islice(waiting, len(over))}
    if failed is not None:
        raise failed
    if not schemas:                      # nothing was left to run: the files know their columns
        old = cells.join(finished(spark, path), CELL, "left_semi").select(CELL).first()
        if old is None:
            return cells
        schemas.append(spark.read.parquet(_folder(path, old[0])).schema)
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in schemas[0].fields if f.name not in cells.columns])
    return read_ledger(spark, path, cells, nullable)


def scores_summary(results: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """J10 over a ledger: mean and sample deviation of each metric over folds for every cell,
    and the number of ``folds``.  A slice size among the keys stays a key."""
    aggs = [a for m in metrics for a in (F.avg(m).alias(f"test_{m}_mean"), F.stddev_samp(m).alias(f"test_{m}_std"))]
    return results.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("folds"))
