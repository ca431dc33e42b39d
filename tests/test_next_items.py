import random
from collections import Counter, defaultdict

import numpy as np

from cellarflow.operators import next_items
from cellarflow.operators import strategies as S


def brute(rows: list[tuple], k: int, last: int = 3, fade: float = 0.5) -> dict[str, list[tuple[str, float]]]:
    seen = defaultdict(list)
    for user, item, t in rows:
        seen[user].append((t, item))
    moves = Counter((a[1], b[1]) for own in seen.values() for a, b in zip(sorted(own), sorted(own)[1:], strict=False))
    total = Counter()
    for (a, _), n in moves.items():
        total[a] += n
    out = {}
    for user, own in seen.items():
        score = Counter()
        for at, (_, a) in enumerate(sorted(own, reverse=True)[:last]):
            for (x, b), n in moves.items():
                if x == a:
                    score[b] += fade**at * n / total[a]
        best = sorted((-round(s, 9), b) for b, s in score.items() if b not in {i for _, i in own})[:k]
        if best:
            out[user] = [(b, -s) for s, b in best]
    return out


def hub_rows() -> list[tuple]:
    """Two items that half of all users come through, with hundreds of next items each, most of them once."""
    rng = random.Random(7)
    rows = {}
    for u in range(900):
        for t in range(rng.randint(2, 6)):
            rows[f"u{u}", rng.choice(("hub1", "hub2")) if rng.random() < 0.4 else f"i{min(rng.randrange(400), rng.randrange(400)):03}"] = t
    return [(u, i, t) for (u, i), t in rows.items()]


def test_sequential_reads_long_lists_only_as_far_as_needed(spark, monkeypatch):
    rows = hub_rows()
    x = spark.createDataFrame([(u, i, 1.0, t) for u, i, t in rows], "user_id string, item_id string, weight double, last_us long")
    got = lambda df: {u: [(i, round(s, 9)) for _, i, s in sorted(r)] for u, r in grouped(df.collect()).items()}
    want = brute(rows, 5)
    df = S.sequential(x, 5)
    assert "MapInArrow" in df._jdf.queryExecution().toString()  # no join of users' last items with all of their next items
    assert got(df) == want
    monkeypatch.setattr(next_items, "SENT", 0)
    assert got(S.sequential(x, 5)) == want  # lists too large to be sent are joined, with the same result


def grouped(rows) -> dict[str, list]:
    out = defaultdict(list)
    for r in rows:
        out[r["user_id"]].append((r["rank"], r["item_id"], r["score"]))
    return out


def test_best_of_is_whole_at_any_depth():
    rng = np.random.default_rng(3)
    for n, kinds in ((40, 2), (200, 3), (200, 50)):
        for _ in range(30):
            lists = []
            for at in range(3):
                item = np.sort(rng.choice(300, size=rng.integers(1, n), replace=False)).astype(np.int32)
                p = rng.integers(1, kinds, size=len(item), endpoint=True) / 97
                by = np.lexsort((item, -p))
                lists.append((0.5**at, (item[by], p[by], item, p)))
            seen = rng.choice(300, size=30, replace=False).astype(np.int32)
            score = Counter()
            for f, (_, _, item, p) in lists:
                for i, w in zip(item.tolist(), p.tolist(), strict=True):
                    score[i] += f * w
            want = sorted((-round(s, 9), i) for i, s in score.items() if i not in set(seen.tolist()))[:10]
            for depth in (1, 4, 1000):
                found, s = next_items.best_of(lists, seen, 10, depth)
                assert [(-round(v, 9), i) for v, i in zip(s.tolist(), found.tolist(), strict=True)] == want
