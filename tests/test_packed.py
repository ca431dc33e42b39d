import random
from dataclasses import replace
from datetime import UTC, datetime

import numpy as np
import pytest

from cellarflow.config import SHOP, BoostRule, JobSettings
from cellarflow.operators import factor_lists
from cellarflow.operators import ranking as R
from cellarflow.operators import strategies as S
from cellarflow.operators.near_items import PACKED, unpacked
from cellarflow.plans import pipeline
from cellarflow.runtime import CLEANUP

NOW = datetime(2026, 4, 1, tzinfo=UTC)


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1), (2,)])
@pytest.mark.parametrize("boosted", [False, True])
def test_packed_lists_combine_as_rows_do(spark, order, boosted):
    rng = random.Random(5)
    users = spark.createDataFrame([(f"u{u}",) for u in range(40)] + [("nobody",)], "user_id string")
    items = spark.createDataFrame([(f"i{i:02}",) for i in range(30)], "item_id string")
    data = S.coded_items(users.limit(0).selectExpr("user_id", "user_id item_id", "1d weight", "1L last_us"), items)
    own = lambda: [(f"u{u}", (c := rng.sample(range(30), rng.randint(1, 6))), [round(rng.uniform(-3, 9), 2) for _ in c]) for u in range(0, 40, rng.randint(1, 2))]
    a, b = (spark.createDataFrame(own(), PACKED) for _ in range(2))
    short = spark.createDataFrame([(f"i{i:02}", n + 1, 7.0 - n) for n, i in enumerate((3, 28, 11, 5))], "item_id string, rank int, score double")
    factors = spark.createDataFrame([(f"i{i:02}", 0.5 + i % 4) for i in range(0, 30, 3)], "item_id string, factor double") if boosted else None
    lists = [("a", a, False), ("b", b, False), ("short", short, True)]
    got = data.with_names(R.combine_packed(users, [lists[i] for i in order], data.codes, 7, factors=factors, top=5))
    rows = [(S.to_users(users, f) if shared else data.named(f)).selectExpr("*", f"'{label}' source") for label, f, shared in (lists[i] for i in order)]
    want = R.combine_priority(rows, 7)
    want = R.apply_factors(want, factors, 5) if boosted else want.where("rank <= 5")
    same = lambda df: sorted((r.user_id, r.rank, r.item_id, round(r.score, 9), r.source) for r in df.collect())
    assert same(got) == same(want) != []
    assert unpacked(a).count() == sum(len(r["items"]) for r in a.collect())


def _shop(spark):
    t = lambda days: datetime.fromtimestamp(NOW.timestamp() - days * 86400, UTC)
    rows = [(f"e{u}-{i}", f"u{u}", f"i{(u + i) % 7}", "purchase", 1, t(3 + i + u)) for u in range(12) for i in range(4)] + [("x", "u3", "i6", "purchase", 1, t(0)), ("y", "new", "i6", "purchase", 1, t(0))]
    events = spark.createDataFrame(rows, "event_id string, user_id string, item_id string, event_type string, quantity int, occurred_at timestamp")
    items = spark.createDataFrame([(f"i{i}", "beer" if i < 4 else "wine", True, True, float(i)) for i in range(9)], "item_id string, category string, published boolean, in_stock boolean, margin double")
    return events, items


def test_shared_lists_are_not_written_per_user(spark, monkeypatch):
    """The run by priority writes lists of numbers, one row per user, and shared ones once."""
    events, items = _shop(spark)
    written = {}
    real = pipeline.materialize
    monkeypatch.setattr(pipeline, "materialize", lambda df, label: written.setdefault(label, real(df, label)))
    job = JobSettings(top_k=2, models=("item_based", "sequential", "popular"), content_fallback=True)
    config = replace(SHOP, boosts=(BoostRule("m", "margin", "numeric", weight=1.0),))
    rows = pipeline.recommend(pipeline.build_dataset(events, None, items, config, int(NOW.timestamp() * 1e6), 90.0), config, job)
    assert rows.count() == 13 * 2
    assert written["popular"].count() == 6 and written["item_based"].count() <= 13


@pytest.mark.parametrize("blocks", [(256, 1024, 8192), (7, 20, 50)])
def test_collaborative_reads_factors_by_length(spark, monkeypatch, blocks):
    """The same items as all products give, ties by id, and not all factors are read; nothing is asked for beyond k."""
    for name, n in zip(("USERS", "FIRST", "ITEMS"), blocks, strict=True):
        monkeypatch.setattr(factor_lists, name, n)
    monkeypatch.setattr(S, "_als_model", lambda *a: 1 / 0)
    rng = np.random.default_rng(4)
    users, items = rng.normal(size=(30, 4)).astype(np.float32), (rng.normal(size=(400, 4)) * rng.pareto(1.5, size=(400, 1))).astype(np.float32)
    items[50:60] = items[5]  # ties
    frame = lambda f, c: spark.createDataFrame([(f"{c}{n:03}", n, [float(x) for x in v]) for n, v in enumerate(f)], f"{c}_id string, no int, features array<float>").withColumnRenamed("u_id", "user_id").withColumnRenamed("i_id", "item_id")
    seen = [(f"u{u:03}", f"i{i:03}", 1.0, 1) for u in range(20) for i in rng.choice(400, u * 3, replace=False)]
    x = spark.createDataFrame(seen, "user_id string, item_id string, weight double, last_us long")
    got = sorted((r.user_id, r["rank"], r.item_id) for r in S.collaborative(x, 5, fitted={"user_factors": frame(users, "u"), "item_factors": frame(items, "i")}).collect())
    known = {(u, i) for u, i, *_ in seen}
    score = users.astype(float) @ items.astype(float).T
    best = lambda u: sorted((-round(score[u, i], 9), f"i{i:03}") for i in range(400) if (f"u{u:03}", f"i{i:03}") not in known)[:5]
    assert got == [(f"u{u:03}", n + 1, i) for u in range(30) for n, (_, i) in enumerate(best(u))]


def test_backtest_scores_only_judged_users(spark, monkeypatch):
    """Users without an event in the fold's test get no list; the metrics are those of all lists, the setting of writes is left as it was."""
    events, items = _shop(spark)
    scored = []
    real = pipeline.S.item_based_lists
    monkeypatch.setattr(pipeline.S, "item_based_lists", lambda *a, **k: scored.append(k["users"]) or real(*a, **k))
    job = JobSettings(top_k=2, folds=1, fold_days=2)
    (_, m), = pipeline.backtest(events, None, items, SHOP, job, [pipeline.E.Candidate(("item_based", "popular"))], int(NOW.timestamp() * 1e6))
    assert [sorted(r.user_id for r in u.collect()) for u in scored] == [["u3"]]  # new has events in the test alone
    assert 0 <= m["MAP@2"] <= 1 and spark.conf.get(CLEANUP, None) is None
