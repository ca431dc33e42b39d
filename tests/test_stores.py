import threading
import time
from dataclasses import replace
from datetime import UTC, datetime, timedelta

import pytest

from cellarflow.config import SHOP, Blending, BoostRule, ConfigError, JobSettings
from cellarflow.operators import strategies as S
from cellarflow.plans.pipeline import build_dataset, fit, load_artifact, recommend, run_job
from cellarflow.sources import tables as T
from cellarflow.sources.locks import FileLease, RunGuard
from cellarflow.sources.tables import Store

ROWS = "user_id string, item_id string, rank int, score double, source string"
NOW = datetime(2026, 4, 1, tzinfo=UTC)


@pytest.fixture
def store(spark, tmp_path):
    events = [(f"e{u}-{i}", f"u{u}", f"i{i}", "purchase" if i % 2 else "view", 1, NOW - timedelta(days=i)) for u in range(6) for i in range(5) if (u + i) % 4]
    spark.createDataFrame(events, "event_id string, user_id string, item_id string, event_type string, quantity int, occurred_at timestamp").write.parquet(f"{tmp_path}/events.parquet")
    users = [("u1", ["ipa"], "north", NOW), ("u1", ["stout"], "south", NOW - timedelta(days=1)), ("fresh", ["ipa"], None, NOW)]
    spark.createDataFrame(users, "user_id string, favorite_styles array<string>, region_slug string, exported_at timestamp").write.parquet(f"{tmp_path}/users.parquet")
    items = [(f"i{i}", "beer" if i < 4 else "wine", i != 3, "yes", NOW - timedelta(days=i), i % 2 == 0, float("nan") if i == 1 else float(i)) for i in range(7)]
    spark.createDataFrame(items, "item_id string, category string, published boolean, in_stock string, published_at timestamp, paying boolean, margin double").write.parquet(f"{tmp_path}/items.parquet")
    return Store(spark, str(tmp_path))


def test_job_end_to_end(spark, store):
    m = run_job(spark, store, SHOP, JobSettings(top_k=3, models=("item_based", "sequential", "popular"), content_fallback=True), as_of=NOW)
    recs = store.read_recommendations().collect()
    assert m["status"] == "ok" and m["n_rows"] == len(recs) and m["n_users"] == store.count_users() == 7
    assert "i3" not in {r.item_id for r in recs}  # not published
    for u in {r.user_id for r in recs}:
        mine = sorted((r for r in recs if r.user_id == u), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1)) and len({r.item_id for r in mine}) == len(mine) <= 3
    assert store.manifests(1)[0]["status"] == "ok" and store.read_snapshot().count() == 7
    again = recommend(*load_artifact(store)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, recs))
    assert {"neighbours", "transitions", "interactions", "items"} <= set(store.read_artifact()[1])


def test_job_chooses_by_backtesting(spark, store):
    job = JobSettings(top_k=2, automl=True, folds=1, fold_days=2, candidates=({"models": ["popular"]}, {"models": ["item_based", "popular"], "weights": {"item_based": 1, "popular": 0.5}}))
    m = run_job(spark, store, SHOP, job, as_of=NOW)
    auto = store.manifests(1)[0]["automl"]
    assert set(auto["results"]) == {"popular", "fusion(item_based=1,popular=0.5)"} and auto["selected"] in auto["results"]
    assert m["models"] == (["popular"] if auto["selected"] == "popular" else ["item_based", "popular"])
    with pytest.raises(ConfigError):
        run_job(spark, store, SHOP, replace(job, candidates=()), as_of=NOW)
    with pytest.raises(ConfigError):
        run_job(spark, store, SHOP, replace(job, candidates=({"models": ["sequential"]},), sequential_least=99.0), as_of=NOW)


def test_factors_of_the_artifact_recommend_the_same(spark, store):
    m = run_job(spark, store, SHOP, JobSettings(top_k=2, models=("collaborative",), epochs=(1, 3)), as_of=NOW)
    assert [e for e, _ in m["epochs"]["values"]] == [1, 3] and all(0 < v["Recall@2"] <= 1 for _, v in m["epochs"]["values"])
    assert set(m["epochs"]["warnings"]) == {"Precision@2", "Recall@2"}
    got = lambda rows: {(r.user_id, r.item_id, round(r.score, 5)) for r in rows.collect()}
    assert got(recommend(*load_artifact(store))) == got(store.read_recommendations()) != set()


def test_strategies_without_a_user_to_score_do_nothing(spark, store, monkeypatch):
    events, users, items = store.read_input()
    data = build_dataset(events.where("event_type = 'odd'"), users.drop("favorite_styles", "region_slug"), items, SHOP, int(NOW.timestamp() * 1e6), 90.0)
    for name in ("item_neighbours", "item_based", "transitions", "sequential", "fit_collaborative", "collaborative", "content_fallback"):
        monkeypatch.setattr(S, name, lambda *a, **k: 1 / 0)
    job = JobSettings(top_k=2, models=("collaborative", "item_based", "sequential", "popular"), content_fallback=True)
    assert recommend(fit(data, job.models, job), SHOP, job).collect() == []


def test_job_with_blend_fusion_and_boosts(spark, store):
    blend = replace(SHOP, blending=Blending(enabled=True), boosts=(BoostRule("p", "paying", "boolean", factor=2.0), BoostRule("m", "margin", "numeric", weight=1.0)))
    run_job(spark, store, blend, JobSettings(top_k=3, models=("item_based", "popular")), as_of=NOW)
    assert store.read_recommendations().where("user_id = '__cold_start__'").count() == 3
    run_job(spark, store, SHOP, JobSettings(top_k=2, models=("item_based", "latest", "popular"), model_weights={"item_based": 1.0, "popular": 0.2}), as_of=NOW)
    assert any("+" in r.source for r in store.read_recommendations().collect())
    assert len(store.manifests(10)) == 2


def test_failed_job_leaves_a_manifest(spark, store):
    with pytest.raises(Exception):
        run_job(spark, store, SHOP, JobSettings(models=("popular",), model_weights={"latest": 1.0}), as_of=NOW)
    m = store.manifests(1)[0]
    assert m["status"] == "failed" and "model_weights" in m["error"] and store.read_recommendations().collect() == []
    with pytest.raises(FileNotFoundError):
        Store(spark, store.root + "/nowhere").read_input()
    with pytest.raises(FileNotFoundError):
        store.read_artifact()


def test_replacing_users(spark, store):
    row = lambda u, i: (u, i, 1, 1.0, "s")
    store.write_recommendations(spark.createDataFrame([row("a", "x"), row("b", "x"), row("b", "y")], ROWS))
    ids = spark.createDataFrame([("b",), ("c",), (None,)], "user_id string")
    assert store.replace_for_users(ids, spark.createDataFrame([row("c", "z")], ROWS)) == 2
    assert sorted((r.user_id, r.item_id) for r in store.read_recommendations().collect()) == [("a", "x"), ("c", "z")]
    assert store.read_recommendations(ids).count() == 1
    with pytest.raises(ValueError):
        store.replace_for_users(ids, spark.createDataFrame([row("other", "z")], ROWS))
    assert store.changed_at() > 0 and Store(spark, store.root + "/nowhere").changed_at() is None


def test_only_buckets_of_replaced_users_are_written(spark, store):
    row = lambda u, i: (u, i, 1, 1.0, "s")
    store.write_recommendations(spark.createDataFrame([row(f"u{i}", "x") for i in range(400)], ROWS))
    before = store.version("recommendations")[1]["buckets"]
    rows = spark.createDataFrame([row(f"u{i}", "y") for i in range(10)], ROWS)
    assert store.replace_for_users(rows, rows) == store.count_users() == 400
    after = store.version("recommendations")[1]["buckets"]
    touched = {r[0] for r in rows.select(store._bucket()).distinct().collect()}
    assert {int(b) for b in after if after[b] != before[b]} == touched and len(touched) <= 10 < len(after)
    assert store.read_recommendations().where("item_id = 'y'").count() == 10 and store.read_recommendations().count() == 400
    assert store.replace_for_users(rows, rows.limit(0)) == 390


def test_a_reader_sees_whole_versions_and_old_frames_stay_readable(spark, store):
    rows = lambda x: spark.createDataFrame([(f"u{i}", x, 1, 1.0, "s") for i in range(30)], ROWS)
    store.write_recommendations(rows("v0"))
    old, stop, seen = store.read_recommendations(), threading.Event(), []

    def look():
        while not stop.is_set():
            seen.append(sorted(r.item_id for r in Store(spark, store.root).read_recommendations().collect()))

    reader = threading.Thread(target=look)
    reader.start()
    for i in range(1, 5):
        store.write_recommendations(rows(f"v{i}"))
    stop.set()
    reader.join()
    assert seen and all(len(x) == 30 and len(set(x)) == 1 for x in seen)
    assert old.where("item_id = 'v0'").count() == 30
    assert store.vacuum(keep=2) == 3 and store.read_recommendations().where("item_id = 'v4'").count() == 30


def test_replacements_that_overlap_lose_nothing(spark, store, monkeypatch):
    rows = lambda u: spark.createDataFrame([(u, "x", 1, 1.0, "s")], ROWS)
    other, real, late = Store(spark, store.root), Store._write_buckets, []

    def write(self, df):
        if self is store and not late:
            late.append(other.replace_for_users(rows("b"), rows("b"), batch=7))
        return real(self, df)

    monkeypatch.setattr(Store, "_write_buckets", write)
    assert store.replace_for_users(rows("a"), rows("a")) == 2 and store.last_batch() == 7
    assert {r.user_id for r in store.read_recommendations().collect()} == {"a", "b"}


def test_manifests_by_name(spark, store):
    for i in range(1005):
        if i < 1 or i > 1000:
            store.write_manifest({"generated_at": f"2026-03-01T10:{i // 60:02d}:{i % 60:02d}+01:00", "mode": "incremental" if not i else "full", "i": i})
    assert [m["i"] for m in store.manifests(2)] == [1004, 1003] and store.newest_incremental()["i"] == 0
    assert [m["i"] for m in store.manifests(9, "full")] == [1004, 1003, 1002, 1001]


def test_database_users_are_replaced_in_one_transaction(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    types = "user_id VARCHAR(64), item_id VARCHAR(64), source VARCHAR(64)"
    row = lambda u, i: (u, i, 1, 1.0, "s")
    frame = lambda rows: spark.createDataFrame(rows, ROWS)
    T.write_jdbc(frame([row("a", "x"), row("b", "x"), row("b", "y")]), url, "recs", createTableColumnTypes=types)
    got = lambda: sorted((r.user_id, r.item_id) for r in T.read_jdbc(spark, url, table="recs").collect())
    T.replace_users_jdbc(frame([row("b", "z"), row("c", "w")]), spark.createDataFrame([("b",), ("c",), (None,)], "user_id string"), url, "recs", createTableColumnTypes=types)
    assert got() == [("a", "x"), ("b", "z"), ("c", "w")]
    with pytest.raises(Exception):  # the insert fails, so the delete must not stay
        T.replace_users_jdbc(frame([("b", "z", 1, 1.0, "s" * 65)]), spark.createDataFrame([("b",)], "user_id string"), url, "recs", createTableColumnTypes=types.replace("source VARCHAR(64)", "source VARCHAR(99)"))
    assert got() == [("a", "x"), ("b", "z"), ("c", "w")]
    T.write_jdbc(frame([row("d", "x")]), url, "recs", append=True)
    assert T.read_jdbc(spark, url, query="select \"user_id\" from recs where \"item_id\" = 'x'").count() == 2
    T.write_jdbc(frame([row("only", "x")]), url, "recs")
    assert got() == [("only", "x")]


def test_keyset_pages(spark):
    ev = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (None, "d"), (3, None)], "t bigint, event_id string")
    page = lambda c, n: [(r.t, r.event_id) for r in T.keyset_page(ev, c, n).collect()]
    assert page(None, 1) == [(1, "a")] and page((1, "a"), 5) == [(1, "b"), (2, "c")] and page((2, "c"), 5) == []
    assert T.count_after(ev, (1, "a")) == 2 and T.count_after(ev, None, 2) == 2


def test_names_and_queries():
    assert T.table_name("a.b_1") == "a.b_1" and T.read_only(" select 1; ") == "select 1"
    for bad in ("a;b", "1a", "", "a.b.c", "a b"):
        with pytest.raises(ValueError):
            T.table_name(bad)
    for bad in ("delete from x", "select 1; select 2", "select 1 -- x", "with x as (select 1) insert into y select 1"):
        with pytest.raises(ValueError):
            T.read_only(bad)


def test_pushdown(spark, store):
    from pyspark.sql import functions as F

    plan = T.read_parquet(spark, f"{store.root}/events.parquet", ["item_id"], F.col("user_id") == "u1")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,u1)]" in plan and "ReadSchema: struct<user_id:string,item_id:string>" in plan


def test_lease(spark, tmp_path):
    now = [0.0]
    a, b = (FileLease(spark, f"{tmp_path}/lease", 10, lambda: now[0]) for _ in range(2))
    assert a.acquire() and not b.acquire() and a.acquire() and not a.lost()
    now[0] = 11
    assert a.lost() and b.acquire() and a.lost() and not a.acquire()
    b.release()
    assert a.acquire()


def test_run_guard():
    runs, now = [], [0.0]
    guard = RunGuard(lambda: runs.append(1), debounce=5, clock=lambda: now[0])
    assert guard.trigger() and not guard.trigger()
    now[0] = 6
    assert guard.trigger() and len(runs) == 2
    bad = RunGuard(lambda: 1 / 0)
    assert bad.trigger() and isinstance(bad.last_error, ZeroDivisionError) and time.time() > 0


def test_command_line(spark, store, tmp_path, capsys):
    import json

    from cellarflow.__main__ import main

    (tmp_path / "job.toml").write_text('[job]\ntop_k = 2\nmodels = ["popular"]\n')
    assert main(["run", store.root, "--job", str(tmp_path / "job.toml"), "--as-of", "2026-04-01T00:00:00+00:00"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["status"] == "ok"
    assert main(["lookup", store.root, "u1"]) == 0
    assert [r["place"] for r in json.loads(capsys.readouterr().out.splitlines()[-1])] == [1, 2]
    (tmp_path / "job.toml").write_text('[job]\nmodels = ["odd"]\n')
    assert main(["run", store.root, "--job", str(tmp_path / "job.toml")]) == 2
