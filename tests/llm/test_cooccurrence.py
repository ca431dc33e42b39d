import math
import random
from collections import Counter
from datetime import UTC, datetime, timedelta
from itertools import combinations

import pytest

from cellarflow.llm import cooccurrence
from cellarflow.llm.cooccurrence import pairs_together

SCHEMA = "user_id string, item_id string, occurred_at timestamp, code bigint, u string, n_ab int"
T0 = datetime(2026, 3, 1, tzinfo=UTC)


def brute(rows):
    baskets = {}
    for u, i, t, *_ in rows:
        if u is not None and i is not None and t is not None:
            baskets.setdefault((u.strip(), t.date()), set()).add(i.strip())
    items, pairs = Counter(), Counter()
    for b in baskets.values():
        items.update(b)
        pairs.update(combinations(sorted(b), 2))
    return len(baskets), items, pairs


def found(df):
    return sorted((r.item_a, r.item_b, r.n_ab, r.n_a, r.n_b) for r in df.collect())


def rows_of(seed, n=500):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        u = rng.choice(["kiosk"] * 3 + [f"u{rng.randrange(25)}", None])
        i = rng.choice(["hot", " hot", f"i{rng.randrange(30)}", f"i{rng.randrange(5)}", "é", "", None])
        out.append((u, i, rng.choice([None, T0 + timedelta(days=rng.randrange(5), seconds=rng.randrange(86400)), T0 - timedelta(days=30000)]), 1, "x", 2))
    return out


@pytest.mark.parametrize("block,flush,wide", [(2048, 1_000_000, 8192), (2, 7, 2)])
def test_against_brute_force(spark, monkeypatch, block, flush, wide):
    monkeypatch.setattr(cooccurrence, "PIECE", block)
    whole = cooccurrence._stripes
    monkeypatch.setattr(cooccurrence, "_stripes", lambda: whole(flush, wide))
    rows = rows_of(block)
    n, items, pairs = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    got = pairs_together(df)
    assert found(got) == sorted((a, b, c, items[a], items[b]) for (a, b), c in pairs.items())
    assert {r.n_baskets for r in got.collect()} == {n}
    strict = {(a, b) for (a, b), c in pairs.items() if c >= 3 and c * n >= 2 * items[a] * items[b]}
    assert {x[:2] for x in found(pairs_together(df, min_together=3, min_lift=2))} == strict


def test_no_row_holds_a_large_basket(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "PIECE", 64)
    whole = cooccurrence._stripes

    def checked():
        inner = whole()

        def run(batches):
            def small(batches):
                for b in batches:
                    assert all(len(x) <= 128 for c in range(4) for x in b.column(c).to_pylist() if x is not None)
                    yield b

            return inner(small(batches))

        return run

    monkeypatch.setattr(cooccurrence, "_stripes", checked)
    rows = [("big", f"i{i:04d}", T0, 0, "", 0) for i in range(1500)] + [("other", f"i{i:04d}", T0, 0, "", 0) for i in (3, 700, 1499)]
    got = pairs_together(spark.createDataFrame(rows, SCHEMA)).groupBy("n_ab").count().collect()
    assert {r.n_ab: r["count"] for r in got} == {1: 1500 * 1499 // 2 - 3, 2: 3}


def test_a_basket_of_many_items_that_few_share(spark):
    many = spark.range(200_000).selectExpr("'big' user_id", "concat('i', id) item_id", "timestamp'2026-03-01 05:00:00' occurred_at", "1L code", "'' u", "0 n_ab")
    few = spark.range(90).selectExpr("'few' user_id", "concat('i', id * 2000) item_id", "timestamp'2026-03-01 05:00:00' occurred_at", "1L code", "'' u", "0 n_ab")
    assert pairs_together(many.unionByName(few), min_together=2).agg({"n_ab": "sum"}).first()[0] == 2 * 90 * 89 // 2


def test_significant_pairs_leave_out_no_case(spark):
    """n_ab >= 5 and lift >= 10 imply a ratio of at least 14, whatever the margins."""
    rows = [(f"u{i}", x, T0, 0, "", 0) for i in range(600) for x in ((["a", "b"] if i < 5 else ["a"] if i < 8 else ["b"] if i < 42 else ["c"]))]
    r = next(r for r in pairs_together(spark.createDataFrame(rows, SCHEMA)).collect() if r.item_a == "a")
    assert r.lift == pytest.approx(5 * 600 / (8 * 39)) and r.llr >= 2 * 5 * (math.log(r.lift) - 1 + 1 / r.lift)


def test_large_side_joins_without_broadcast(spark, monkeypatch):
    rows = rows_of(3)
    df = spark.createDataFrame(rows, SCHEMA)
    want = found(pairs_together(df))
    monkeypatch.setattr(cooccurrence, "CODE_BYTES", 1 << 40)
    assert found(pairs_together(df)) == want


def test_lift_and_llr(spark):
    rows = [(f"u{i}", x, T0, 0, "", 0) for i in range(20) for x in (["a", "b"] if i < 5 else ["c"] if i < 12 else ["a"] if i < 15 else ["d"])]
    r = next(r for r in pairs_together(spark.createDataFrame(rows, SCHEMA)).collect() if (r.item_a, r.item_b) == ("a", "b"))
    k = [[5, 3], [0, 12]]
    xlx = lambda x: x * math.log(x) if x else 0.0
    cells = sum(map(xlx, k[0] + k[1]))
    want = 2 * (cells + xlx(20) - xlx(8) - xlx(12) - xlx(5) - xlx(15))
    assert r.lift == pytest.approx(5 * 20 / (8 * 5)) and r.llr == pytest.approx(want)
    assert pairs_together(spark.createDataFrame(rows, SCHEMA), min_llr=want + 1).count() == 0


def test_empty_and_single_items(spark):
    assert pairs_together(spark.createDataFrame([], SCHEMA)).collect() == []
    assert pairs_together(spark.createDataFrame([("u", "a", T0, 0, "", 0)] * 3, SCHEMA)).collect() == []
