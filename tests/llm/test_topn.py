import math
import random

import pytest

from cellarflow.llm import topn
from cellarflow.llm.topn import top_items

SCHEMA = "user_id string, item_id string, score double, rank int, grp string, bound double, place int"


def brute(rows, n):
    best = {}
    for u, i, s, *_ in rows:
        if u is not None and i is not None and s is not None and not math.isnan(s):
            best.setdefault(u, {})
            best[u][i] = max(best[u].get(i, -math.inf), s)
    return sorted((u, i, p) for u, x in best.items() for p, (i, _) in enumerate(sorted(x.items(), key=lambda y: (-y[1], y[0]))[:n], 1))


def found(df):
    return sorted((r.user_id, r.item_id, r.place) for r in df.collect())


def rows_of(seed, n=1500):
    rng = random.Random(seed)
    return [
        (rng.choice(["hot"] * 6 + [f"u{rng.randrange(60)}", None]), rng.choice([f"i{rng.randrange(400)}", "é", "", None]),
         rng.choice([None, math.nan, 0.0, -0.0, rng.randrange(6) / 4, -rng.random(), math.inf, -math.inf]), 1, "clash", 0.5, 9)
        for _ in range(n)
    ]


@pytest.mark.parametrize("n", [1, 3, 10])
@pytest.mark.parametrize("fold", [200_000, 40])
def test_against_brute_force(spark, monkeypatch, n, fold):
    monkeypatch.setattr(topn, "FOLD_ROWS", fold)
    rows = rows_of(n)
    rows += rows[:200]
    assert found(top_items(spark.createDataFrame(rows, SCHEMA).repartition(6), n)) == brute(rows, n)


def test_small_batches(spark):
    rows = rows_of(7, 400)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert found(top_items(spark.createDataFrame(rows, SCHEMA), 4)) == brute(rows, 4)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_zero_signs_tie(spark):
    rows = [("u", "b", 0.0, 1, "", 0.0, 0), ("u", "a", -0.0, 1, "", 0.0, 0)]
    assert found(top_items(spark.createDataFrame(rows, SCHEMA), 2)) == [("u", "a", 1), ("u", "b", 2)]


def test_empty_and_bad_n(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert top_items(empty).collect() == []
    with pytest.raises(ValueError):
        top_items(empty, 0)
