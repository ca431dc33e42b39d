import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from cellarflow.config import FeatureColumn
from cellarflow.operators import near_items
from cellarflow.operators import strategies as S
from cellarflow.operators.pair_sums import summed


def brute(rows: list[tuple], near: list[tuple], k: int, allowed: set[str] | None = None) -> dict[str, list[tuple[str, float]]]:
    seen, score = defaultdict(set), defaultdict(Counter)
    for u, i, w, _ in rows:
        seen[u].add(i)
        for a, b, s in near:
            if a == i:
                score[u][b] += w * s
    best = lambda u: sorted((-round(s, 9), b) for b, s in score[u].items() if b not in seen[u] and s > 0 and (allowed is None or b in allowed))[:k]
    return {u: [(b, -s) for s, b in best(u)] for u in seen if best(u)}


@pytest.mark.parametrize(("sent", "flush"), [(4_000_000, 2_000_000), (40, 7), (0, 3)])
def test_item_based_sums_within_tasks(spark, monkeypatch, sent, flush):
    """Whether all lists, those of the most used items or none are sent to every task; small portions cut users apart."""
    monkeypatch.setattr(near_items, "SENT", sent)
    monkeypatch.setattr(near_items, "FLUSH", flush)
    rng = random.Random(3)
    rows = {(f"u{u}", f"i{min(rng.randrange(60), rng.randrange(60)):02}"): (rng.randrange(1, 9) * 0.5, u) for u in range(50) for _ in range(rng.randint(1, 12))}
    rows = [(*key, *v) for key, v in rows.items()]
    x = spark.createDataFrame(rows, "user_id string, item_id string, weight double, last_us long")
    near = S.item_neighbours(x, 6)
    lists = [(r.item_id, r.other_id, r.similarity) for r in near.collect()]
    allowed = {f"i{n:02}" for n in range(0, 60, 3)}
    for kept in (near, None):
        df = S.item_based(x, 4, neighbours=6, near=kept)
        assert "MapInArrow" in df._jdf.queryExecution().toString()  # no row per user, item and neighbour is shuffled
        assert grouped(df.collect()) == brute(rows, lists, 4)
    some = spark.createDataFrame([(i,) for i in allowed], "item_id string")
    assert grouped(S.item_based(x, 4, neighbours=6, near=near, allowed=some).collect()) == brute(rows, lists, 4, allowed)


def grouped(rows) -> dict[str, list]:
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        out[r["user_id"]].append((r["item_id"], round(r["score"], 9)))
    return dict(out)


def test_content_lists_are_cut_before_they_are_joined(spark, monkeypatch):
    """Only subsets whose lists can hold one of a set's first items are met: here the whole set, of three."""
    met = []
    real = S._short_lists_met
    monkeypatch.setattr(S, "_short_lists_met", lambda *a: met.append(real(*a)) or met[-1])
    items = spark.createDataFrame([(f"i{i:02}", "k", "v") for i in range(30)] + [("j", "k", "w")], "item_id string, kind string, vessel string")
    x = spark.createDataFrame([(f"u{u}", f"i{u:02}", 1.0, 1) for u in range(4)], "user_id string, item_id string, weight double, last_us long")
    df = S.content_fallback(x, items, [FeatureColumn("kind"), FeatureColumn("vessel")], 5)
    assert "MapInArrow" in df._jdf.queryExecution().toString()
    assert grouped(df.collect()) == {f"u{u}": [(f"i{i:02}", 1.0) for i in range(4, 9)] for u in range(4)}
    assert met[0].count() == 5


def test_summed():
    key, s = summed(np.array([3, 1, 3]), np.array([1.0, 2.0, 4.0]))
    assert list(key) == [1, 3] and list(s) == [2.0, 5.0]
