"""The driver may import __spark_entry__ from another working directory with its own session."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as E
df = E.entry(spark)
assert df.count() > 0
# a query whose work runs in Arrow UDFs and mapInPandas on the workers
assert E.queries()["i9_double_ml_selector"](spark, "/root/testdata/sf0.001").count() > 0
print("OK")
"""


def test_entry_from_foreign_cwd_with_plain_session():
    cwd = tempfile.mkdtemp(prefix="featurelab-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    res = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True,
                         timeout=600)
    assert "OK" in res.stdout, res.stderr[-3000:]
