import json
import time
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from cellarflow.config import SHOP
from cellarflow.sources import streams
from cellarflow.sources.locks import FileLease
from cellarflow.sources.tables import Store
from cellarflow.streaming import intake as N
from cellarflow.streaming.metrics import Metrics

ROWS = "user_id string, item_id string, rank int, score double, source string"
EVENTS = "event_id string, user_id string, item_id string, event_type string, quantity int, t bigint"


def raw(spark, rows):
    return spark.createDataFrame(rows, streams.RAW_EVENTS)


def test_normalise(spark):
    good = ("e1", None, " u ", "i", "view", None, "2026-03-01T10:00:00Z")
    rows = [good, (None, "k", "u", "i", "view", "2", "2026-03-01T10:00:00+01:00"), (" ", "", "u", "i", "view", "1", "2026-03-01 10:00:00Z")]
    bad = [("b", None, "", "i", "view", "1", "2026-03-01T10:00:00Z"), ("b", None, "u", "i", "view", "0", "2026-03-01T10:00:00Z"), ("b", None, "u", "i", "view", "x", "2026-03-01T10:00:00Z"),
           ("b", None, "u", "i", "view", "1", "2026-03-01T10:00:00"), ("b", None, "u", "i", "view", "1.5", "2026-03-01T10:00:00Z"), (None,) * 7]
    events, rejected = N.normalise(raw(spark, rows + bad))
    got = sorted(events.collect(), key=lambda r: r.event_id)
    assert rejected.count() == len(bad) and [r.event_id for r in got][:2] == ["e1", "k"] and got[2].event_id.startswith("u|i|view|1|")
    t = int(datetime(2026, 3, 1, 10, tzinfo=UTC).timestamp() * 1e6)
    assert (got[0].user_id, got[0].quantity, got[0].t) == ("u", 1, t) and (got[1].quantity, got[1].t) == (2, t - 3600 * 1_000_000)


def test_dedupe(spark):
    x = spark.createDataFrame([("a", "u", "i", "view", 1, 5), ("a", "u", "j", "view", 1, 4), ("b", "u", "j", "view", 1, 4), ("c", "u", "j", "view", 2, 4)], EVENTS)
    assert sorted(r.event_id for r in N.dedupe_batch(x).collect()) == ["a", "c"]
    assert N.dedupe_batch(x.limit(0)).collect() == []


def events(spark, rows):
    return spark.createDataFrame([(f"e{i}", *r) for i, r in enumerate(rows)], EVENTS)


def test_slices(spark):
    x = events(spark, [("u", "a", "purchase", 3, 1), ("u", "b", "view", 1, 9), ("v", "b", "view", 1, 2), ("v", "c", "odd", 1, 99), ("v", "d", "review_negative", 1, 3)])
    pop = {r.item_id: r.score for r in N.popular_slice(x, SHOP, 5).collect()}
    assert pop == pytest.approx({"a": 5.545177, "b": 0.6, "d": -3.0})
    assert [(r.item_id, r.score) for r in sorted(N.latest_slice(x, SHOP, 2).collect(), key=lambda r: r.place)] == [("b", 2.0), ("d", 1.0)]
    assert N.popular_slice(x, None, 1).first().item_id == "a"


def merged(spark, prior, batch, k):
    got = {}
    for r in N.merge_batch(spark.createDataFrame(prior, ROWS), events(spark, batch), SHOP, k).collect():
        got.setdefault(r.user_id, []).append((r["rank"], r.item_id, r.source))
    return {u: [(i, s) for _, i, s in sorted(x)] for u, x in got.items()}


def test_merge(spark):
    prior = [("u1", "old", 1, 1.0, "personalized"), ("u1", "gone", 2, 1.0, "incremental"), ("u2", "x", 1, 1.0, "personalized"), ("__cold_start__", "keep", 1, 1.0, "popular_fallback")]
    got = merged(spark, prior, [("u1", "i9", "purchase", 1, 2), ("u1", "i8", "view", 1, 1)], 5)
    assert got["u1"] == [("i9", "incremental"), ("old", "personalized"), ("i8", "popular_fallback")]
    assert set(got) == {"u1", "__cold_start__"} and got["__cold_start__"] == [("i9", "popular_fallback"), ("i8", "popular_fallback"), ("keep", "popular_fallback")]


def test_merge_slots_and_labels(spark):
    prior = [("u1", f"b{i}", i, 1.0, "blended") for i in range(1, 6)]
    got = merged(spark, prior, [("u1", "boosted", "purchase", 1, 2)], 5)["u1"]
    assert len(got) == 5 and got[0] == ("boosted", "incremental") and [i for i, _ in got[1:]] == ["b1", "b2", "b3", "b4"]
    keep = merged(spark, [("u1", "old", None, float("nan"), "personalized+popular_fallback")], [("u1", "new", "purchase", 1, 2)], 5)["u1"]
    assert ("old", "personalized+popular_fallback") in keep
    assert merged(spark, prior, [], 5) == {}


def drop(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text(json.dumps(rows))


def event(i, user="u1", item="i1", **more):
    return {"event_id": f"e{i}", "user_id": user, "item_id": item, "event_type": "purchase", "quantity": "1", "occurred_at": f"2026-03-01T10:00:{i:02d}Z"} | more


def test_stream_equals_batches_and_replays(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    store.write_recommendations(spark.createDataFrame([("u1", "old", 1, 1.0, "personalized")], ROWS))
    apply = N.MicroBatches(store, SHOP, 5)
    drop(tmp_path / "in", "1.json", [event(1), event(1), event(2, "u2", "i2"), {"user_id": "broken"}])

    def run():
        q = N.start(streams.open_source(spark, "files", path=f"{tmp_path}/in"), apply, f"{tmp_path}/check", seconds=None)
        q.awaitTermination()
        assert N.health(q)["active"] is False

    run()
    rows = {(r.user_id, r["rank"]): r.item_id for r in store.read_recommendations().collect()}
    assert rows[("u1", 1)] == "i1" and rows[("u1", 2)] == "old" and rows[("u2", 1)] == "i2" and ("__cold_start__", 1) in rows
    first = next(o for o in apply.outcomes if o["n_events"])
    assert first["n_events"] == 2 and first["n_rejected"] == 1
    before = sorted(map(tuple, store.read_recommendations().collect()))
    apply(raw(spark, [("e9", None, "u1", "zzz", "purchase", "1", "2026-03-01T11:00:00Z")]), 0)  # a replay of a number applied
    assert sorted(map(tuple, store.read_recommendations().collect())) == before
    drop(tmp_path / "in", "2.json", [event(3, "u1", "i3")])
    run()
    assert store.read_recommendations().where("user_id = 'u1' and rank = 1").first().item_id == "i3"


def test_busy_store_makes_the_batch_come_again(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    batch = raw(spark, [("e", None, "u", "i", "purchase", "1", "2026-03-01T11:00:00Z")])
    with pytest.raises(RuntimeError):
        N.MicroBatches(store, SHOP, busy=lambda: True)(batch, 0)
    with pytest.raises(RuntimeError):
        N.MicroBatches(store, SHOP, fenced=lambda: True)(batch, 0)
    assert store.newest_incremental() is None
    N.MicroBatches(store, SHOP)(batch, 0)
    assert store.newest_incremental()["n_events"] == 1 and store.last_batch() == 0
    lease = FileLease(spark, f"{tmp_path}/lease")
    assert lease.acquire()
    N.MicroBatches(store, SHOP, fenced=lease.lost)(batch, 1)
    lease.release()
    with pytest.raises(RuntimeError):
        N.MicroBatches(store, SHOP, fenced=lease.lost)(batch, 2)
    assert store.last_batch() == 1


def test_cursor_source(spark, tmp_path):
    rows = [(f"e{i:02d}", "u", "i", "view", 1, datetime(2026, 3, 1, 10, i // 3, tzinfo=UTC)) for i in range(10)] + [(None, "u", "i", "view", 1, datetime(2026, 3, 1, tzinfo=UTC))]
    spark.createDataFrame(rows, "event_id string, user_id string, item_id string, event_type string, quantity int, occurred_at timestamp").write.parquet(f"{tmp_path}/ev")
    out, sizes = [], []

    def take(df, n):
        got = [r.event_id for r in df.collect()]
        out.extend(got)
        sizes.append(len(got))

    q = streams.open_source(spark, "cursor", path=f"{tmp_path}/ev", page=4).writeStream.foreachBatch(take).option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(out) == [f"e{i:02d}" for i in range(10)] and max(sizes) <= 4


def test_a_page_waits_for_its_window(spark, tmp_path):
    t = lambda i: datetime(2026, 3, 1, 10, i, tzinfo=UTC)
    schema = "event_id string, user_id string, item_id string, event_type string, quantity int, occurred_at timestamp"
    spark.createDataFrame([(f"e{i}", "u", "i", "view", 1, t(i)) for i in range(5)], schema).repartition(3).write.parquet(f"{tmp_path}/ev")
    reader, now = streams._CursorReader({"path": f"{tmp_path}/ev", "page": 2, "window": 60}, spark.createDataFrame([], schema).schema), [0.0]
    reader.clock = lambda: now[0]
    ends = [json.loads(reader.latestOffset()["at"])[1] for _ in range(4)]
    assert ends == ["e1", "e3", "e3", "e3"]  # two full pages at once, then the rest waits
    now[0] = 61
    assert json.loads(reader.latestOffset()["at"])[1] == "e4"
    rows = [r[0] for p in reader.partitions(reader.initialOffset(), {"at": json.dumps(reader.now)}) for r in reader.read(p)]
    assert sorted(rows) == [f"e{i}" for i in range(5)]


def test_a_batch_that_keeps_failing_is_passed_over(spark, tmp_path):
    store, metrics = Store(spark, f"{tmp_path}/store"), Metrics()
    batch = raw(spark, [("e", None, "u", "i", "view", "1", "2026-03-01T11:00:00Z")])
    broken = batch.withColumn("quantity", F.raise_error(F.lit("unreadable")))
    apply = N.MicroBatches(store, SHOP, give_up=3, metrics=metrics)
    for _ in range(2):
        with pytest.raises(Exception, match="unreadable"):
            N.MicroBatches(store, SHOP, give_up=3)(broken, 0)  # failures count across runs
    apply(broken, 0)
    assert store.newest_incremental()["status"] == "skipped" and "unreadable" in store.newest_incremental()["error"]
    apply(batch, 1)
    assert store.last_batch() == 1 and metrics.counters["batches_ok"] == metrics.counters["batches_skipped"] == 1


def test_drain_and_metrics(spark, tmp_path):
    metrics, seen = Metrics(), []
    spark.streams.addListener(metrics)
    try:
        drop(tmp_path / "in", "1.json", [event(1), event(2)])
        q = streams.open_source(spark, "files", path=f"{tmp_path}/in").writeStream.foreachBatch(lambda df, n: seen.append(df.count())).option("checkpointLocation", f"{tmp_path}/c").start()
        N.drain(q)
        assert sum(seen) == 2 and not q.isActive
        for _ in range(50):
            if metrics.counters["streams_ended"]:
                break
            time.sleep(0.2)
        assert metrics.counters["stream_rows"] == 2 and metrics.counters["streams_ended"] == 1
        text = metrics.text()
        assert "cellarflow_stream_rows 2\n" in text and 'cellarflow_stream_batch_seconds_bucket{le="+Inf"}' in text
    finally:
        spark.streams.removeListener(metrics)


def test_registry(spark):
    with pytest.raises(ValueError):
        streams.open_source(spark, "odd")
    with pytest.raises(ValueError):
        streams.register("files", streams.files)
