import random
from datetime import UTC, datetime, timedelta

import pytest

from cellarflow.operators.skew import heavy_keys, key_statistics

SCHEMA = "a string, b string, at timestamp, n_rows int, field string"
T0 = datetime(2026, 3, 1, tzinfo=UTC)
WAYS = [("a", "b"), ("b", "a")]


def brute(rows):
    out = {}
    for f, i, j in (("a", 0, 1), ("b", 1, 0)):
        for r in rows:
            if r[i] is None:
                continue
            s = out.setdefault((f, r[i].strip()), [0, set(), []])
            s[0] += 1
            if r[j] is not None:
                s[1].add(r[j].strip())
            if r[2] is not None:
                s[2].append(r[2])
    us = lambda t: round((t - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds() * 1e6)
    return sorted((f, k, n, len(p), us(min(t)) if t else None, us(max(t)) if t else None) for (f, k), (n, p, t) in out.items())


def found(df):
    return sorted((r.field, r.key_value, r.n_rows, r.n_partners, r.first_us, r.last_us) for r in df.collect())


@pytest.mark.parametrize("partitions", [1, 3, 50, None])
def test_against_brute_force(spark, partitions):
    rng = random.Random(1)
    rows = []
    for _ in range(900):
        a = rng.choice(["hot"] * 5 + [f"a{rng.randrange(40)}", " a1 ", "", None])
        b = rng.choice(["big"] * 3 + [f"b{rng.randrange(60)}", None])
        rows.append((a, b, rng.choice([None, T0 + timedelta(seconds=rng.randrange(1000))]), 7, "clash"))
    rows += [("hot", "big", T0, 1, "same")] * 300
    assert found(key_statistics(spark.createDataFrame(rows, SCHEMA), WAYS, time="at", partitions=partitions)) == brute(rows)


def test_batches_smaller_than_a_key(spark):
    rows = [("k", f"p{i % 7}", T0 + timedelta(seconds=i), 0, "") for i in range(100)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert found(key_statistics(spark.createDataFrame(rows, SCHEMA), WAYS, time="at", partitions=4)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found(key_statistics(empty, WAYS, time="at")) == [] and heavy_keys(empty, WAYS, time="at").collect() == []


def test_share_counts_rows_with_nulls(spark):
    rows = [("x", None, None, 0, "")] * 2 + [(None, None, None, 0, "")] * 98
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.key_value for r in heavy_keys(df, WAYS, time="at", share=0.02).collect()] == ["x"]
    assert heavy_keys(df.unionByName(df.where("a is null").limit(1)), WAYS, time="at", share=0.02).collect() == []
