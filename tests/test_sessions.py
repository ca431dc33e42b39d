import random
from datetime import UTC, datetime, timedelta

import pytest

from cellarflow.operators.sessions import sessions

SCHEMA = "event_id string, user_id string, item_id string, occurred_at timestamp, _u string, start_us int"
T0 = datetime(2026, 3, 1, tzinfo=UTC)
US = 1_000_000


def brute(rows, gap):
    seen, by_user = set(), {}
    for e, u, _, t, *_ in rows:
        if u is None or t is None:
            continue
        u = u.strip()
        if e is not None and (u, e) in seen:
            continue
        seen.add((u, e))
        by_user.setdefault(u, []).append(round((t - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds() * US))
    out = []
    for u, ts in by_user.items():
        ts.sort()
        run = [ts[0]]
        for t in ts[1:]:
            if t - run[-1] > gap * US:
                out.append((u, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        out.append((u, run[0], run[-1], len(run)))
    return sorted(out)


def found(df):
    return sorted((r.user_id, r.start_us, r.end_us, r.n_events) for r in df.collect())


def test_gap_of_exactly_the_limit_belongs(spark):
    rows = [("a", "u", "i", T0, "x", 1), ("b", "u", "i", T0 + timedelta(minutes=30), "x", 1), ("c", "u", "i", T0 + timedelta(minutes=60, microseconds=1), "x", 1)]
    assert [n for *_, n in found(sessions(spark.createDataFrame(rows, SCHEMA)))] == [2, 1]


def test_nulls_copies_and_spaces(spark):
    rows = [
        ("a", " u　", "i", T0, None, None), ("a", "u", None, T0, None, None), ("b", "u", "i", None, None, None), ("c", None, "i", T0, None, None),
        ("d", "", "i", T0, None, None), (None, "u", "i", T0, None, None), (None, "u", "i", T0, None, None),
    ]
    t = int(T0.timestamp() * US)
    assert found(sessions(spark.createDataFrame(rows, SCHEMA))) == [("", t, t, 1), ("u", t, t, 3)]


def test_empty(spark):
    assert sessions(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("gap", [0, 1, 60, 1800])
def test_against_brute_force(spark, gap):
    rng = random.Random(gap)
    rows = []
    for i in range(600):
        u = rng.choice(["hot"] * 4 + [f"u{rng.randrange(20)}"])
        t = T0 + timedelta(seconds=rng.choice([rng.randrange(-3_000_000_000, 0), rng.randrange(20_000), gap * rng.randrange(9)]), microseconds=rng.randrange(3))
        rows += [(f"e{i}", u, "i", t, "x", 0)] * rng.choice([1, 1, 1, 2])
    assert found(sessions(spark.createDataFrame(rows, SCHEMA), gap_seconds=gap)) == brute(rows, gap)


def test_numbers_and_durations(spark):
    rows = [(f"e{i}", "u", "i", T0 + timedelta(hours=i // 2, seconds=i % 2), "x", 0) for i in range(6)]
    got = sorted((r.session_no, r.duration_us) for r in sessions(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, US), (2, US), (3, US)]


def test_negative_gap(spark):
    with pytest.raises(ValueError):
        sessions(spark.createDataFrame([], SCHEMA), gap_seconds=-1)
