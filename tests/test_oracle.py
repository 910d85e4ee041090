"""Every registered query against its DuckDB twin (the driver's correctness gate)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_CHECK
from tools.oracle_check import compare, duck

NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF_CHECK)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_CHECK)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    drows = cur.fetchall()
    dcols = [d[0] for d in cur.description]
    ok, msg = compare(rows, df.columns, drows, dcols)
    assert ok, msg
    assert "hash would differ" not in msg, msg


def test_rows_only_queries_run(spark):
    for name, fn in E.queries().items():
        if name in E.oracle_sql():
            continue
        assert fn(spark, SF_CHECK).count() > 0, name


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["fold", "target", "feature", "n", "score", "kept", "rank"]
