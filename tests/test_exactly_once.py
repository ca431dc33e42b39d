import random
from datetime import UTC, datetime, timedelta

import pytest

from cellarflow.operators import exactly_once
from cellarflow.operators.exactly_once import ExactlyOnce
from cellarflow.runtime import fresh_path, hadoop_path

SCHEMA = "delivery_id bigint, event_id string, idempotency_key string, received_at timestamp, delivery string, code int, shard string"
T0 = datetime(2026, 3, 1, tzinfo=UTC)


def row(d, e=None, k=None, at=0):
    return (d, e, k, None if at is None else T0 + timedelta(seconds=at), "clash", 1, "clash")


def ids(df):
    return sorted(r.delivery_id for r in df.collect())


def test_smallest_arrival_stays(spark):
    rows = [row(3, "a", at=5), row(2, " a ", at=1), row(1, "a", at=1), row(4, "", "a", at=0), row(5, None, "k"), row(6, "  ", "k"), row(7), row(8, "", " "), row(9, "b", at=None), row(10, "b", at=9)]
    x = spark.createDataFrame(rows, SCHEMA)
    e = ExactlyOnce(spark, fresh_path(spark, "t"))
    assert ids(e.copies(x)) == [1, 2, 3, 6, 9]
    assert ids(e.kept(x)) == [4, 5, 7, 8, 10]


def test_empty_batch(spark):
    e = ExactlyOnce(spark, fresh_path(spark, "t"))
    empty = spark.createDataFrame([], SCHEMA)
    assert ids(e.kept(empty)) == [] and ids(e.copies(empty)) == []
    assert ids(e.kept(spark.createDataFrame([row(1, "a")], SCHEMA), 1)) == [1]


def test_later_batches_and_replays(spark):
    e = ExactlyOnce(spark, fresh_path(spark, "t"))
    rng = random.Random(5)
    seen, total = set(), 0
    for b in range(3):
        rows = [row(b * 1000 + i, f"m{rng.randrange(150)}", at=rng.randrange(50)) for i in range(100)]
        x = spark.createDataFrame(rows, SCHEMA)
        fresh = {r[1] for r in rows} - seen
        kept = e.kept(x, b).collect()
        assert len(kept) == len(fresh) and {r.event_id for r in kept} == fresh
        assert ids(e.kept(x, b)) == sorted(r.delivery_id for r in kept)  # a replay gives the same
        seen |= fresh
        total += len(kept)
    assert total == len(seen)


def test_crash_before_commit_leaves_no_trace(spark, monkeypatch):
    e = ExactlyOnce(spark, fresh_path(spark, "t"))
    x = spark.createDataFrame([row(1, "a"), row(2, "a")], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(ExactlyOnce, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        try:
            e.apply(x)
        except OSError:
            pass
    assert ids(e.kept(x)) == [1]


def test_a_stray_file_of_a_crashed_commit_is_no_commit(spark):
    path = fresh_path(spark, "t")
    e = ExactlyOnce(spark, path)
    assert ids(e.kept(spark.createDataFrame([row(1, "a")], SCHEMA), 0)) == [1]
    fs, at = hadoop_path(spark, f"{path}/log/2.json.half.tmp")
    fs.create(at, True).close()  # written beside, never renamed
    assert e.state_now()[0] == 1
    assert ids(e.kept(spark.createDataFrame([row(2, "a"), row(3, "b")], SCHEMA), 1)) == [3]


def test_two_writers_give_no_code_and_no_message_twice(spark, monkeypatch):
    path = fresh_path(spark, "t")
    one, two = ExactlyOnce(spark, path), ExactlyOnce(spark, path)
    x = spark.createDataFrame([row(i, f"m{i}") for i in range(40)], SCHEMA)
    y = spark.createDataFrame([row(100 + i, f"m{i}") for i in range(20, 60)], SCHEMA)
    real, late = ExactlyOnce._commit, []

    def commit(self, n, entry):
        if self is one and not late:  # the other writer commits between this one's reading and its commit
            late.append(ids(two.kept(y, 1)))
        return real(self, n, entry)

    monkeypatch.setattr(ExactlyOnce, "_commit", commit)
    first = ids(one.kept(x, 0))
    assert len(late) == 1 and late[0] == list(range(120, 160)) and first == list(range(20))
    state = one.state_now()[1]
    codes = one._read([p for p, _ in state["dictionary"]], exactly_once._DICTIONARY).collect()
    assert sorted(r.code for r in codes) == list(range(60)) and len({r.ident for r in codes}) == 60
    assert ids(one.kept(x, 0)) == first and ids(two.kept(y, 1)) == late[0]


def test_tables_of_the_state_stay_few(spark, monkeypatch):
    monkeypatch.setattr(exactly_once, "FAN", 2)
    e = ExactlyOnce(spark, fresh_path(spark, "t"))
    sizes, total = [], 0
    for b in range(5):
        x = spark.createDataFrame([row(b * 100 + i, f"m{(b * 7 + i) % 90}") for i in range(12)], SCHEMA)
        total += len(ids(e.kept(x, b)))
        state = e.state_now()[1]
        sizes.append((len(state["dictionary"]), len(state["bitmaps"])))
    assert max(d for d, _ in sizes) <= 3 and max(m for _, m in sizes) <= 3 and state["applied"] == [[0, 4]]
    assert total == len({f"m{(b * 7 + i) % 90}" for b in range(5) for i in range(12)}) == state["codes"]


@pytest.mark.parametrize("batches", [1, 4])
def test_a_past_table_in_batches_keeps_the_first_delivery(spark, batches):
    rng = random.Random(batches)
    rows = [row(i, f"m{rng.randrange(60)}", at=rng.choice([None, *range(9)])) for i in range(200)] + [row(1000 + i, at=i) for i in range(3)]
    x = spark.createDataFrame(rows, SCHEMA)
    e = ExactlyOnce(spark, fresh_path(spark, "t"))
    through = e.apply_past(x, batches)
    first = {}
    for r in sorted((r for r in rows if r[1]), key=lambda r: (r[3] is None, r[3] or T0, r[0])):
        first.setdefault(r[1], r[0])
    assert ids(e.only(x, through)) == sorted([*first.values(), 1000, 1001, 1002])
    assert ids(e.without(x, through)) == sorted(r[0] for r in rows if r[1] and r[0] not in first.values())


def test_codes_fill_containers(spark, monkeypatch):
    monkeypatch.setattr(exactly_once, "CONTAINER", 64)
    e = ExactlyOnce(spark, fresh_path(spark, "t"))
    for b in range(2):
        x = spark.createDataFrame([row(b * 500 + i, f"m{b * 100 + i}") for i in range(200)], SCHEMA)
        assert len(ids(e.kept(x, b))) == (200 if b == 0 else 100)


def test_stream_sink(spark, tmp_path):
    spark.createDataFrame([row(i, f"m{i % 5}", at=i) for i in range(20)], SCHEMA).write.parquet(f"{tmp_path}/in/1")
    e = ExactlyOnce(spark, f"{tmp_path}/state")
    out = {}
    for add in (None, 2):
        if add:
            spark.createDataFrame([row(100 + i, f"m{i}", at=i) for i in range(8)], SCHEMA).write.parquet(f"{tmp_path}/in/2")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        write = e.sink(lambda df, n: out.__setitem__(n, [r.event_id for r in df.collect()]))
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted(x for rows in out.values() for x in rows) == [f"m{i}" for i in range(8)]
