import math
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cellarflow.config import SHOP, Blending, BoostRule, FeatureColumn, FeatureConfig
from cellarflow.functions.values import as_list, as_number, as_time, item_true
from cellarflow.operators import interactions as I
from cellarflow.operators import lookup as L
from cellarflow.operators import ranking as R
from cellarflow.operators import strategies as S
from cellarflow.schemas import nan_to_null, resolve_id

EVENTS = "user_id string, item_id string, event_type string, quantity int, occurred_at timestamp, weight double"
NOW = datetime(2026, 4, 1, tzinfo=UTC)
AS_OF = int(NOW.timestamp() * 1_000_000)
ROWS = "user_id string, item_id string, rank int, score double, source string"
INTER = "user_id string, item_id string, weight double, last_us bigint"


def ev(u, i, kind, q=1, days=0):
    return (u, i, kind, q, None if days is None else NOW - timedelta(days=days), 9.0)


def weights(spark, rows, config=SHOP, half_life=90.0):
    got = I.build_interactions(spark.createDataFrame(rows, EVENTS), config, AS_OF, half_life)
    return {(r.user_id, r.item_id): r.weight for r in got.collect()}


def ranked(df):
    return {u: [r.item_id for r in sorted(rs, key=lambda r: r["rank"])] for u, rs in group(df.collect()).items()}


def group(rows):
    out = {}
    for r in rows:
        out.setdefault(r.user_id, []).append(r)
    return out


def test_weights_by_hand(spark):
    rows = [ev("ada", "stout", "cart_add", 9), ev("ada", "stout", "saved"), ev("bo", "perry", "purchase", 12), ev("bo", "stout", "review_negative"), ev("bo", "stout", "review_positive"), ev("cy", "mead", "view")]
    want = {("ada", "stout"): 3.0, ("bo", "perry"): 4 * math.log(13), ("bo", "stout"): 2.0, ("cy", "mead"): 0.3}
    assert weights(spark, rows) == pytest.approx(want)


def test_caps_decay_and_dropping(spark):
    assert weights(spark, [ev("u", "i", "view", days=d % 3) for d in range(20)], half_life=1e9)[("u", "i")] == pytest.approx(1.5)
    assert weights(spark, [ev("u", "i", "saved", days=90)])[("u", "i")] == pytest.approx(1.0)
    assert weights(spark, [ev("u", "i", "saved", days=-90)])[("u", "i")] == pytest.approx(2.0)
    assert weights(spark, [ev("u", "i", "review_negative"), ev("u", "j", "odd"), ev(None, "i", "saved"), ev("u", None, "saved"), ev("u", "k", "saved", days=None)]) == {}
    assert weights(spark, [ev(" u ", "i", "purchase", None), ev("u", "i", "purchase", -5)])[("u", "i")] == pytest.approx(8 * math.log(2))
    newest = I.cap_events(I.clean_events(spark.createDataFrame([ev("u", "i", "view", days=d) for d in range(10)], EVENTS)), SHOP)
    assert newest.agg(F.min("t")).first()[0] == AS_OF - 4 * 86_400_000_000
    assert weights(spark, []) == {}


def test_features(spark):
    users = spark.createDataFrame([("u1", ["ipa", "stout", None], "lazio"), ("u2", ["lager"], None), ("u3", [], None), (None, None, None)], "user_id string, favorite_styles array<string>, region_slug string")
    got = I.explode_features(users, "user_id", [*SHOP.user_features, FeatureColumn("absent")])
    assert sorted((r.id, r.value) for r in got.collect()) == [("u1", "ipa"), ("u1", "lazio"), ("u1", "stout"), ("u2", "lager")]
    assert I.explode_features(users, "user_id", []).collect() == []
    with pytest.raises(ValueError):
        resolve_id(users, "item_id")


def test_values(spark):
    df = spark.createDataFrame([("yes", 1, "[\"a\", \"b\"]", "2.5", "2026-01-01"), (" TRUE ", 0, "a, ,b", "x", "never"), ("false", None, None, "NaN", None), ("Y", 2, "[a, b", None, "")], "s string, n int, l string, x string, d string")
    got = df.select(item_true(df, "s").alias("s"), item_true(df, "n").alias("n"), as_list(df, "l").alias("l"), as_number(df, "x").alias("x"), as_time(df, "d").isNotNull().alias("d")).collect()
    assert [(r.s, r.n, r.l, r.x, r.d) for r in got] == [(True, True, ["a", "b"], 2.5, True), (True, False, ["a", "b"], None, False), (False, False, [], None, False), (False, True, ["a", "b"], None, False)]
    assert nan_to_null(spark.createDataFrame([(math.nan, 1)], "a double, b int")).first().a is None


def frame(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def test_priority(spark):
    a = frame(spark, [("u", "a", 1, 9.0, "first"), ("u", "b", 2, 8.0, "first"), ("v", "d", 1, 1.0, "first")])
    b = frame(spark, [("u", "c", 1, 99.0, "second"), ("u", "b", 2, 99.0, "second"), ("v", "e", 1, 5.0, "second"), ("v", "d", 2, 5.0, "second")])
    assert ranked(R.combine_priority([a, b], 3)) == {"u": ["a", "b", "c"], "v": ["d", "e"]}
    assert ranked(R.combine_priority([a, b], 1)) == {"u": ["a"], "v": ["d"]}
    assert {r.score for r in R.combine_priority([a, b], 3).where("item_id = 'c'").collect()} == {99.0}


def test_fusion(spark):
    a = frame(spark, [("u", "b", 1, 1.0, "one"), ("u", "x", None, 1.0, "one")])
    b = frame(spark, [("u", "a", 1, 1.0, "two"), ("u", "b", 2, 1.0, "two")])
    got = R.combine_fusion({"m1": a, "m2": b}, {}, 5)
    rows = {r.item_id: r for r in got.collect()}
    assert rows["b"].source == "one+two" and rows["b"].score == pytest.approx(1 / 61 + 1 / 62) and ranked(got) == {"u": ["b", "a"]}
    zero = R.combine_fusion({"m1": a, "m2": b}, {"m1": 0.0, "m2": 0.0}, 5)
    assert ranked(zero) == {"u": ["a", "b"]} and {r.score for r in zero.collect()} == {0.0}


def test_blend_weights(spark):
    counts = spark.createDataFrame([("z", 0), ("five", 5), ("many", 50)], "user_id string, n_items long")
    got = {r.user_id: r for r in R.blend_weights(counts, Blending()).collect()}
    assert got["z"].w_personalized == 0 and got["five"].w_personalized == 0.5 and got["many"].w_personalized > 0.9
    assert got["z"].w_popular == pytest.approx(0.7) and got["z"].w_latest == pytest.approx(0.3)
    line = {r.user_id: r for r in R.blend_weights(counts, Blending(curve="linear"), latest=False).collect()}
    assert line["five"].w_personalized == 0.5 and line["many"].w_personalized == 1 and line["z"].w_popular == 1


def test_cold_blend_and_latest(spark):
    items = spark.createDataFrame([("cask", "2019-06-30"), ("keg", "2022-11-05"), ("can", "2022-11-05"), ("jug", "?"), (None, "2025-05-05")], "item_id string, shown string")
    by_date = R.latest_by_date(items, as_time(items, "shown"), 9)
    assert [(r.item_id, r.score) for r in sorted(by_date.collect(), key=lambda r: r["rank"])] == [("can", 3.0), ("keg", 2.0), ("cask", 1.0)]
    assert R.usable_date_column(items, ["gone", "shown"]) == "shown" and R.usable_date_column(items, ["gone"]) is None
    short = lambda *ids: spark.createDataFrame([(x, i, 10.0 - i) for i, x in enumerate(ids, 1)], "item_id string, rank int, score double")
    before = frame(spark, [("__cold_start__", "stale", 1, 1.0, "popular_fallback"), ("bo", "stale", 1, 1.0, "sequential")])
    got = R.with_cold_start(before, short("ipa", "gose", "bock"), short("gose", "kolsch"), Blending(popular_share=0.8), 3)
    # gose is second and first: 0.8 / 62 + 0.2 / 61; ipa 0.8 / 61; bock 0.8 / 63; kolsch 0.2 / 62
    assert ranked(got) == {"__cold_start__": ["gose", "ipa", "bock"], "bo": ["stale"]}
    assert {r.source for r in got.where("item_id = 'gose'").collect()} == {"blended"}


def test_best_rank(spark):
    got = R.best_rank(frame(spark, [("u", "a", None, 9.0, "x"), ("u", "a", 2, 1.0, "x"), ("u", "a", 2, 5.0, "x")])).collect()
    assert [(r["rank"], r.score) for r in got] == [(2, 5.0)]


def test_boosts(spark):
    items = spark.createDataFrame([("keg", False, "cask", -4.0), ("can", True, "tin", 12.0), ("jug", None, "odd", 0.0), ("vat", True, None, None)], "item_id string, fresh boolean, vessel string, profit double")
    rules = [
        BoostRule("fresh", "fresh", "boolean", factor=1.6), BoostRule("vessel", "vessel", "value_map", value_factors={"cask": 3.0, "tin": 0.5}),
        BoostRule("profit", "profit", "numeric", weight=0.8), BoostRule("gone", "gone", "boolean", factor=7.0),
    ]
    got = {r.item_id: r.factor for r in R.boost_factors(items, rules).collect()}
    assert got == pytest.approx({"keg": 3.0, "can": 1.6 * 0.5 * 1.8, "jug": 1 + 0.8 * 4 / 16, "vat": 1.6})
    rows = frame(spark, [("bo", "jug", 1, 8.0, "s"), ("bo", "keg", 2, 3.0, "s"), ("bo", "elsewhere", 3, 2.0, "s")])
    assert ranked(R.apply_factors(rows, R.boost_factors(items, rules[1:2]), 2)) == {"bo": ["keg", "jug"]}


def inter(spark, rows):
    return spark.createDataFrame(rows, INTER)


def test_popular_and_latest(spark):
    x = inter(spark, [("u1", "a", 1.0, 0), ("u2", "a", 1.0, 0), ("u1", "b", 99.0, AS_OF), ("u3", "c", 1.0, AS_OF), ("u4", "z", 1.0, AS_OF * 2)])
    assert [r.item_id for r in sorted(S.popular(x, 3).collect(), key=lambda r: r["rank"])] == ["a", "b", "c"]
    assert [r.item_id for r in sorted(S.latest(x, 3, not_after_us=AS_OF).collect(), key=lambda r: r["rank"])] == ["b", "c"]
    assert [r.item_id for r in S.popular(x, 3, spark.createDataFrame([("c",)], "item_id string")).collect()] == ["c"]
    users = spark.createDataFrame([("p",), ("q",)], "user_id string")
    assert ranked(S.to_users(users, S.popular(x, 2))) == {"p": ["a", "b"], "q": ["a", "b"]}
    none = x.limit(0)
    assert S.popular(none, 3).collect() == [] and S.latest(none, 3).collect() == [] and S.to_users(users, S.popular(none, 2)).collect() == []


def knn_brute(rows, k):
    items, per = sorted({r[1] for r in rows}), {}
    for r in rows:
        per[r[0]] = per.get(r[0], 0) + 1
    v = {i: {r[0]: math.sqrt(r[2]) * (math.log(len(items)) - math.log1p(per[r[0]])) for r in rows if r[1] == i} for i in items}
    norm = {i: math.sqrt(sum(x * x for x in v[i].values())) for i in items}
    sim = lambda a, b: sum(x * v[b].get(u, 0) for u, x in v[a].items()) / (norm[a] * norm[b])
    return {i: [j for j in sorted((j for j in items if set(v[i]) & set(v[j])), key=lambda j: (-round(sim(i, j), 9), j))[:k]] for i in items}


@pytest.mark.parametrize("piece", [2048, 2])
def test_neighbours_against_brute_force(spark, monkeypatch, piece):
    import random

    monkeypatch.setattr(S, "PIECE", piece)
    rng = random.Random(4)
    rows = sorted({(f"u{rng.randrange(8)}", f"i{rng.randrange(14)}"): (rng.randrange(1, 9) * 1.0, rng.randrange(100)) for _ in range(60)}.items())
    rows = [(*k, *v) for k, v in rows]
    got = {}
    for r in S.item_neighbours(inter(spark, rows), 4).collect():
        got.setdefault(r.item_id, []).append((r.place, r.other_id))
    assert {i: [o for _, o in sorted(x)] for i, x in got.items()} == knn_brute(rows, 4)
    seen = {(r[0], r[1]) for r in rows}
    recs = S.item_based(inter(spark, rows), 3, neighbours=4).collect()
    assert all((r.user_id, r.item_id) not in seen and r.score > 0 and r["rank"] <= 3 for r in recs)


def cosines(rows, sets, k):
    """Of untouched items by the greatest cosine with one of the user's items, by brute force."""
    touched = {i for _, i, *_ in rows}
    out = {}
    for u in {r[0] for r in rows}:
        best = {}
        for _, i, *_ in (r for r in rows if r[0] == u):
            for c, t in sets.items():
                if c not in touched and t & sets.get(i, set()):
                    best[c] = max(best.get(c, 0), round(len(t & sets[i]) / math.sqrt(len(t) * len(sets[i])), 9))
        if best:
            out[u] = sorted(best, key=lambda c: (-best[c], c))[:k]
    return out


@pytest.mark.parametrize("listed", [8, 2])
def test_content_against_brute_force(spark, monkeypatch, listed):
    """Tokens of four columns, one of which nearly all items share; with listed 2 most sets are compared token by token."""
    import random

    monkeypatch.setattr(S, "LISTED_TOKENS", listed)
    rng = random.Random(7)
    pick = lambda *xs: rng.choice([*xs, None])
    table = [(f"x{i:02d}", "drink" if i % 9 else None, pick("oak", "tin"), pick("n", "s", "w"), [f"h{rng.randrange(4)}" for _ in range(rng.randrange(3))]) for i in range(70)]
    items = spark.createDataFrame(table, "item_id string, kind string, vessel string, side string, hops array<string>")
    feats = [FeatureColumn("kind"), FeatureColumn("vessel"), FeatureColumn("side"), FeatureColumn("hops", "list"), FeatureColumn("gone")]
    rows = [(f"u{rng.randrange(6)}", f"x{rng.randrange(35):02d}", 1.0, n) for n in range(40)]
    rows = [(u, i, 1.0, n) for n, (u, i) in enumerate(sorted({r[:2] for r in rows}))] + [("lone", "not there", 1.0, 1)]
    sets = {r[0]: {f"{c}={v}" for c, v in zip(("kind", "vessel", "side"), r[1:4]) if v} | {f"hops={h}" for h in r[4]} for r in table}
    for k in (1, 6):
        assert ranked(S.content_fallback(inter(spark, rows), items, feats, k)) == cosines(rows, sets, k)
    few = spark.createDataFrame([("u1",)], "user_id string")
    assert set(ranked(S.content_fallback(inter(spark, rows), items, feats, 2, users=few))) <= {"u1"}
    assert S.content_fallback(inter(spark, rows).limit(0), items, feats, 5).collect() == []


def test_content_fallback_broadcasts_no_listed_subsets(spark):
    """Written sets of tokens are tiny files; the subsets made of them must not be broadcast for that."""
    items = spark.createDataFrame([(f"i{i}", f"k{i % 7}", f"v{i % 5}") for i in range(60)], "item_id string, kind string, vessel string")
    x = inter(spark, [(f"u{u}", f"i{(u * 3 + j) % 40}", 1.0, j) for u in range(20) for j in range(4)])
    df = S.content_fallback(x, items, [FeatureColumn("kind"), FeatureColumn("vessel")], 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(df.collect()) == 60 and "SortMergeJoin" in plan
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and ("part#" in line or "set#" in line or "set_no#" in line)]


def test_sequential(spark):
    x = inter(spark, [("u1", "a", 1.0, 1), ("u1", "b", 1.0, 2), ("u1", "c", 1.0, 3), ("u2", "a", 1.0, 1), ("u2", "b", 1.0, 2), ("u3", "b", 1.0, 1)])
    assert {(r.from_id, r.to_id): r.n for r in S.transitions(x).collect()} == {("a", "b"): 2, ("b", "c"): 1}
    assert ranked(S.sequential(x, 5)) == {"u2": ["c"], "u3": ["c"]}


def test_sequential_scores_all_next_items(spark):
    rows = [(f"a{i:03}", x, 1.0, t) for i in range(120) for t, x in enumerate(("hot", f"n{i % 60:02}"))]
    rows += [("b", f"n{i:02}", 1.0, i) for i in range(55)] + [("b", "hot", 1.0, 99)]
    x = inter(spark, rows)
    assert ranked(S.sequential(x, 5, last=1))["b"] == ["n55", "n56", "n57", "n58", "n59"]
    assert "b" not in ranked(S.sequential(x, 5, last=1, fan_out=50))


def test_collaborative_invariants(spark):
    x = inter(spark, [(f"u{u}", f"i{i}", 1.0, 1) for u in range(12) for i in range(10) if (u + i) % 3 == 0])
    uf = spark.createDataFrame([("feature_only", "style", "ipa"), ("u1", "style", "ipa")], I.FEATURES)
    got = S.collaborative(x, 3, user_features=uf, rank=4, iterations=2, blocks=2).collect()
    seen = {(r.user_id, r.item_id) for r in x.collect()}
    assert all((r.user_id, r.item_id) not in seen and r.item_id.startswith("i") and 1 <= r["rank"] <= 3 for r in got)
    assert "feature_only" in {r.user_id for r in got}


def test_collaborative_gives_k_rows_to_users_who_saw_much(spark):
    rows = [("much", f"i{i:03}", 1.0, 1) for i in range(240)] + [(f"u{u}", f"i{(u * 7 + j * 13) % 260:03}", 1.0, 1) for u in range(60) for j in range(8)]
    x = inter(spark, rows + [("rest", f"i{i:03}", 1.0, 1) for i in range(240, 260)])
    few = spark.createDataFrame([(f"i{i:03}",) for i in range(230, 260)], "item_id string")
    for allowed in (None, few):
        got = ranked(S.collaborative(x, 5, rank=4, iterations=2, blocks=2, allowed=allowed))
        assert set(got) == {r[0] for r in rows} | {"rest"} and all(len(v) == 5 for v in got.values())
        assert all(int(i[1:]) >= 240 for i in got["much"])


def test_registry():
    with pytest.raises(ValueError):
        S.register("popular", S.popular)


def test_lookup(spark):
    recs = frame(spark, [("u1", "i1", 1, 0.9, "personalized"), ("u1", "i2", 2, 0.5, "personalized"), ("u1", "i3", None, 0.1, "personalized"), ("z", "p", 1, 1.0, "popular_fallback"), ("z", "q", 2, 1.0, "personalized"), ("a", "l", 1, 1.0, "latest")])
    ask = spark.createDataFrame([("u1",), ("nobody",)], "user_id string")
    got = group(L.lookup_or_fallback(recs, ask, 2).collect())
    assert [r.item_id for r in sorted(got["u1"], key=lambda r: r.place)] == ["i1", "i2"] and [(r.item_id, r.is_fallback) for r in got["nobody"]] == [("p", True)]
    cold = recs.unionByName(frame(spark, [("__cold_start__", "c", 1, 1.0, "blended")]))
    assert [r.item_id for r in L.fallback_rows(cold, 5).collect()] == ["c"]
    snap = L.item_snapshot(spark.createDataFrame([("i1", "beer", "yes"), ("i2", "wine", "1"), ("i3", "beer", "no")], "item_id string, category string, in_stock string"), ["in_stock", "absent"])
    kept = group(L.serve(recs, snap, ask, 2, category="beer").collect())
    assert [(r.item_id, r.place) for r in kept["u1"]] == [("i1", 1)] and "nobody" not in kept
    assert L.with_category(recs, snap).where("category is null").count() == 3


def test_request_and_staleness():
    assert L.request_size(None, None, 7) == 7 and L.request_size(3, 3, 7) == 3
    for bad in ((1, 2), (0, None), (None, 1000)):
        with pytest.raises(ValueError):
            L.request_size(*bad, 7)
    t = datetime(2026, 1, 31, 23, 30)
    assert L.next_run("0 3 * * *", t) == datetime(2026, 2, 1, 3) and L.next_run("*/15 * * * *", t) == datetime(2026, 1, 31, 23, 45)
    assert L.next_run("0 0 1 * *", t) == datetime(2026, 2, 1) and L.next_run("30 4 * * 1", t) == datetime(2026, 2, 2, 4, 30)
    assert L.is_stale(t, "0 3 * * *", datetime(2026, 2, 1, 4, tzinfo=UTC)) and not L.is_stale(t, "0 3 * * *", datetime(2026, 2, 1, 2))


def test_users_without_caps(spark):
    c = FeatureConfig(event_weights={"view": 1.0})
    assert weights(spark, [ev("u", "i", "view")] * 7, c)[("u", "i")] == pytest.approx(7.0)
