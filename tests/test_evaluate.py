import math

import pytest

from cellarflow.config import ConfigError
from cellarflow.operators import evaluate as E
from cellarflow.operators.strategies import REGISTRY
from cellarflow.plans.queries import QUERIES

DAY = 86_400_000_000


def test_folds(spark):
    days = [0, 1, 4, 9, 16, 25, 36, 49]
    ev = spark.createDataFrame([(f"u{d}", "i", d * DAY) for d in days], "user_id string, item_id string, t bigint")
    folds = E.time_folds(ev, 3, 10)
    assert [f.end_us for f in folds] == [29 * DAY + 1, 39 * DAY + 1, 49 * DAY + 1]
    sizes = [tuple(x.count() for x in E.split(ev, f)) for f in folds]
    assert sizes == [(5, 1), (6, 1), (7, 1)]
    assert [f.end_us for f in E.time_folds(ev, 3, 5)] == [39 * DAY + 1, 49 * DAY + 1]  # nothing between days 40 and 44
    assert E.time_folds(ev.limit(1), 2, 7) == [] and E.time_folds(ev.limit(0), 2, 7) == []
    assert E.time_folds(ev, 1, 10, not_after_us=20 * DAY)[0].end_us == 16 * DAY + 1


def test_metrics_by_hand(spark):
    recs = spark.createDataFrame([("u", "a", 1), ("u", "x", 2), ("u", "b", 3), ("u", "c", 4), ("w", "a", 1)], "user_id string, item_id string, rank int")
    truth = spark.createDataFrame([("u", "a"), ("u", "b"), ("u", "c"), ("u", "a"), ("v", "a")], "user_id string, item_id string")
    m = {r.user_id: r for r in E.user_metrics(recs, truth, 3).collect()}
    assert m["u"].map == pytest.approx((1 + 2 / 3) / 3) and m["u"].recall == pytest.approx(2 / 3) and m["u"].precision == pytest.approx(2 / 3)
    assert m["u"].ndcg == pytest.approx((1 + 1 / 2) / (1 + 1 / math.log2(3) + 1 / 2))
    assert (m["v"].map, m["v"].ndcg) == (0, 0) and set(m) == {"u", "v"}
    assert E.mean_metrics(recs, truth, 3).first().recall == pytest.approx(1 / 3)
    assert E.mean_metrics(recs, truth.limit(0), 3).first().recall is None


def test_candidates():
    c = E.parse_candidates([{"models": ["popular"]}, {"models": ["popular", "latest"], "weights": {"popular": 1, "latest": 0.5}, "rrf_k": 30}])
    assert [x.label for x in c] == ["popular", "fusion(popular=1,latest=0.5;rrf_k=30)"]
    for bad in ([], [{"models": []}], [{"models": ["odd"]}], [{"models": ["popular"], "weights": {}}], [{"models": ["popular"], "rrf_k": 0}], [{"models": ["popular"], "weights": {"popular": -1}}]):
        with pytest.raises(ConfigError):
            E.parse_candidates(bad)
    assert len(E.default_candidates(("popular", "item_based"), ("item_based",))) == 4
    only = [E.Candidate(("sequential",))]
    assert E.without_sequential(only, 5.0) == only
    with pytest.raises(ConfigError):
        E.without_sequential(only, 4.9)


def test_select_best():
    a, b = E.Candidate(("popular",)), E.Candidate(("latest",))
    res = [(a, {"MAP@10": 0.1, "NDCG@10": 0.2}), (b, {"MAP@10": 0.1, "NDCG@10": 0.3})]
    assert E.select_best(res, "MAP") is a and E.select_best(res, "NDCG@10") is b
    for bad in ("odd", "MAP@5"):
        with pytest.raises(ConfigError):
            E.select_best(res, bad)
    with pytest.raises(ConfigError):
        E.select_best([], "MAP")
    with pytest.raises(ConfigError):
        E.select_best([(a, {"MAP@5": 1.0, "MAP@10": 1.0})], "MAP")


def test_trajectory():
    assert E.trajectory_warning([]) is None and E.trajectory_warning([0.5]) is None and E.trajectory_warning([0.1, 0.2, 0.3]) is None
    assert E.trajectory_warning([0.2, 0.8, 0.6]) == "fell" and E.trajectory_warning([0.4, 0.402, 0.401]) == "plateau"
    assert E.trajectory_warning([0.0, 0.0, 0.0]) == "plateau" and E.trajectory_warning([0.4, 0.4]) is None


def test_candidates_are_judged_together_as_alone(spark):
    rows = [(c, f"u{u}", f"i{(u * c + r) % 7}", r) for c in (1, 2, 3) for u in range(5) for r in range(1, 5)]
    recs = spark.createDataFrame(rows, "candidate int, user_id string, item_id string, rank int")
    truth = spark.createDataFrame([(f"u{u}", f"i{(u * 2 + j) % 7}") for u in range(6) for j in range(2)], "user_id string, item_id string")
    got = {r.candidate: r for r in E.metrics_by_candidate(recs, truth, 3).collect()}
    for c in (1, 2, 3):
        want = E.mean_metrics(recs.where(f"candidate = {c}"), truth, 3).first()
        assert all(got[c][m] == pytest.approx(want[m]) for m in ("map", "ndcg", "recall", "precision"))


def test_automl_evaluates_the_whole_registry(spark, small):
    rows = QUERIES["automl_all"](spark, small).collect()
    assert set(REGISTRY) <= {r.candidate for r in rows} and len(rows) == len(REGISTRY) + 2 and sum(r.is_best for r in rows) == 1
