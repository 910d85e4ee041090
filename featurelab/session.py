"""Spark session helpers.

The library never creates its own cluster configuration in jobs: callers pass a
session.  ``local_session`` exists for tests, benches and the smoke entry.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every session we create shares.  AQE re-plans joins and coalesces
# shuffle partitions at run time; skew join splits hot keys.
_BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Wide feature tables: keep whole-stage codegen on for a few hundred columns.
    "spark.sql.codegen.maxFields": "400",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "featurelab") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in _BASE_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("FEATURELAB_DRIVER_MEMORY", "8g"))
    # Tests only: a scratch checkpoint folder when the environment names none.
    builder = builder.config("spark.checkpoint.dir", os.environ.get(
        "FEATURELAB_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="featurelab-ckpt-"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting points at shared storage and is used as is.  Only
    when it is unset (local tests) a scratch folder is created here.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    current = sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        current = tempfile.mkdtemp(prefix="featurelab-ckpt-")
    sc.setCheckpointDir(current)
    return current


def cut_lineage(df):
    """``df`` written once as Parquet to the shared checkpoint folder (never local) and read
    back: later jobs restart from the files, and read only the columns they need."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tasks per core that rows are dealt to: enough to even out slow ones, few enough that starting them costs little.
TASKS_PER_CORE = 4


def dealt(df):
    """``df`` with its rows dealt evenly over a few tasks per core, whatever the files it comes from."""
    return df.repartition(TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)


_SHIPPED: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Make ``featurelab`` importable on the executors' Python workers (like --py-files).

    Arrow UDFs and ``mapInPandas`` functions are pickled by reference to their module, so
    the workers must be able to import the package.  A zip of the package is built once
    per driver process and added to the SparkContext once.
    """
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="featurelab-pyfiles-"), "featurelab.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for base, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED[key] = out
