"""Every query outside the training-data subpackage beside its SQL on the smallest data."""

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "scripts")]

from compare import rows  # noqa: E402

from cellarflow import core_queries  # noqa: E402
from cellarflow.plans import queries as plan_queries  # noqa: E402

QUERIES, SQL = core_queries.QUERIES | plan_queries.QUERIES, core_queries.SQL | plan_queries.SQL


@pytest.fixture(scope="module")
def con():
    path = Path("/root/testdata/sf0.001")
    if not path.exists():
        pytest.skip("no test data")
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in path.iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, small, name):
    df = QUERIES[name](spark, small)
    cur = con.execute(SQL[name])
    heads = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(heads)
    assert rows(df.columns, df.collect()) == rows(heads, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"automl_all"}))  # in test_evaluate
def test_runs_without_sql(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
