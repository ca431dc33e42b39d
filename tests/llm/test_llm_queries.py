"""Queries of the subpackage beside their SQL on the smallest data; those without SQL hold their invariants."""

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "scripts")]

from compare import rows  # noqa: E402

from cellarflow.llm.queries import QUERIES, SQL  # noqa: E402


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, small, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(small).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = QUERIES[name](spark, small)
    cur = con.execute(SQL[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in cur.description], cur.fetchall())


def test_whole_tables_come_out(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = docs.where("text is not null").count()
    packed = QUERIES["p6_packed"](spark, small)
    assert packed.select("container_kind", "doc_id").distinct().count() == texts * 4
    assert all(0 < r.fill <= 1 and r.n_containers >= r.least_containers for r in QUERIES["p6_fill"](spark, small).collect())
    assert QUERIES["p7_uses"](spark, small).count() == QUERIES["p8_quality"](spark, small).count() == docs.count()
    shares = QUERIES["p7_shares"](spark, small).collect()
    assert sum(r.real_share for r in shares) == pytest.approx(1)
    assert all(r.most_uses <= r.max_repeats for r in shares)
    found = {r.doc_id for r in QUERIES["p8_found"](spark, small).collect()}
    assert found == {r.doc_id for r in QUERIES["p8_quality"](spark, small).where("kind <> 'prose'").collect()}
