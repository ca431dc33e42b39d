import random

import pytest

from cellarflow.llm.mixing import allocate, largest_total, mix_sources
from cellarflow.llm.tokens import token_count

DOCS = "doc_id bigint, text string, source string, w double, uses int, rate double"
TARGETS = "source string, target_share double, max_repeats int"


def docs_of(seed, n=800):
    rng = random.Random(seed)
    pick = lambda: rng.choice(["big"] * 6 + [" BIG", "mid", "mid", "Mid ", "rare" if rng.random() < 0.1 else "big", "none", None])
    rows = [(i, "malt " * rng.choice([0, 1, 3, 10, 30, 60]), pick(), float(rng.choice([0, 1, 1, 2, 5])), 7, 0.5) for i in range(n)]
    return rows + [(n, None, "big", 1.0, 0, 0.0), (None, "lost", "big", 1.0, 0, 0.0), (n + 1, "malt " * 4000, "rare", 1.0, 0, 0.0)]


GOALS = [("big", 0.5, 1), ("MID", 0.3, 3), ("rare", 0.1, 2), ("absent", 0.1, 4)]


@pytest.mark.parametrize("total", [None, "available", 3000, 20_000, 1])
@pytest.mark.parametrize("weight", [None, "w"])
def test_shares_and_caps(spark, total, weight):
    rows = docs_of(3)
    uses, shares = mix_sources(spark.createDataFrame(rows, DOCS), spark.createDataFrame(GOALS, TARGETS), total_tokens=total, weight=weight)
    got = {r.doc_id: r for r in uses.collect()}
    want = {r[0]: r for r in rows if r[0] is not None}
    assert set(got) == set(want)
    caps = {s.lower(): m for s, _, m in GOALS}
    mixed, have = {}, {}
    for d, r in got.items():
        s = (want[d][2] or "").strip().lower()
        n = token_count(want[d][1]) if want[d][1] is not None else None
        assert r.n_tokens == n and 0 <= r.uses <= caps.get(s, 0)
        if weight and want[d][3] == 0:
            assert r.uses == 0
        if r.uses:
            mixed[s] = mixed.get(s, 0) + r.uses * n
        have.setdefault(s, []).append(n or 0)
    report = {r.source: r for r in shares.collect()}
    whole = sum(mixed.values())
    for s in caps:
        assert report[s].mixed_tokens == mixed.get(s, 0)
        assert report[s].real_share == pytest.approx(mixed.get(s, 0) / whole if whole else 0)
        assert abs(report[s].mixed_tokens - report[s].wanted_tokens) <= max([0, *have.get(s, [])])  # within one text
    if total is None:
        assert all(report[s].wanted_tokens / sum(r.wanted_tokens for r in report.values()) == pytest.approx(w / 0.9) for s, w in (("big", 0.5), ("mid", 0.3), ("rare", 0.1)))
    assert report["absent"].n_docs == 0 and report["absent"].real_share == 0


def test_deterministic(spark):
    rows = docs_of(5)
    run = lambda seed, n: sorted(
        (r.doc_id, r.uses) for r in mix_sources(spark.createDataFrame(rows, DOCS).repartition(n), spark.createDataFrame(GOALS, TARGETS), total_tokens=2500, seed=seed)[0].collect()
    )
    assert run(1, 2) == run(1, 7) and run(1, 2) != run(2, 2)


def test_inclusion_follows_the_odds(spark):
    rows = [(i, "malt", "big", 4.0 if i % 2 else 1.0, 0, 0.0) for i in range(4000)]
    uses = mix_sources(spark.createDataFrame(rows, DOCS), spark.createDataFrame([("big", 1.0, 1)], TARGETS), total_tokens=1000 * token_count("malt"), weight="w")[0].collect()
    odd = sum(r.uses for r in uses if r.doc_id % 2)
    assert sum(r.uses for r in uses) == 1000 and 760 <= odd <= 840  # 0.4 and 0.1 of 2000 each


def test_allocate():
    assert allocate([("a", 0.5, 1), ("b", 0.5, 2)], {"a": 100, "b": 10}, 100) == {"a": 80.0, "b": 20.0}
    assert allocate([("a", 0.5, 1), ("b", 0.5, 9)], {"a": 100}, 60) == {"a": 60.0, "b": 0.0}
    assert allocate([("a", 1.0, 0)], {"a": 100}, 60) == {"a": 0.0}


def test_largest_total():
    assert largest_total([("a", 0.5, 1), ("b", 0.25, 4), ("gone", 0.25, 9)], {"a": 300, "b": 25}) == pytest.approx(300)
    assert largest_total([("a", 0.0, 1), ("gone", 1.0, 9)], {"a": 300}) == 0.0


@pytest.mark.parametrize("query", ["p7_uses", "p7_weighted"])
@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_the_registered_mixes_meet_their_targets(spark, sf, query):
    from cellarflow.llm.queries import QUERIES

    rows = QUERIES[query](spark, f"/root/testdata/{sf}").collect()
    targets = {r.source: (r.target_share, r.max_repeats) for r in spark.read.parquet(f"/root/testdata/{sf}/mix_targets.parquet").collect()}
    whole = sum(r.uses * r.n_tokens for r in rows if r.uses)
    there = {r.source for r in rows} & set(targets)
    given = sum(targets[s][0] for s in there)
    assert given == pytest.approx(0.98) and whole > 0
    for s in there:
        mine = [r for r in rows if r.source == s]
        real = sum(r.uses * r.n_tokens for r in mine if r.uses) / whole
        assert abs(real - targets[s][0] / given) <= max(r.n_tokens for r in mine if r.n_tokens) / whole and max(r.uses for r in mine) <= targets[s][1]
        assert all(r.real_share == pytest.approx(real, abs=1e-8) for r in mine)
    assert {r.uses for r in rows if r.source not in there} == {0}
    scarce = min(there, key=lambda s: sum(r.n_tokens for r in rows if r.source == s and r.n_tokens) * targets[s][1] / targets[s][0])
    assert all(r.uses == targets[scarce][1] for r in rows if r.source == scarce and r.n_tokens)


def test_empty_and_bad_targets(spark):
    empty = spark.createDataFrame([], DOCS)
    uses, shares = mix_sources(empty, spark.createDataFrame(GOALS, TARGETS))
    assert uses.collect() == [] and {r.real_share for r in shares.collect()} == {0.0}
    for bad in ([("a", 0.5, 1), (" A", 0.5, 1)], [("a", None, 1)], [("a", 0.5, -1)]):
        with pytest.raises(ValueError):
            mix_sources(empty, spark.createDataFrame(bad, TARGETS))
