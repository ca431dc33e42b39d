"""Best next items of users from lists of weighted items: numpy within a task, deep lists read only as far as they matter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarflow.operators.near_items import PACKED, packed_lists

#: Entries of a list up to which it travels with each user that it is for; longer lists are sent to every task once.
SHORT = 32
#: Entries of all longer lists together up to which they are sent so, 24 bytes each; beyond that the caller joins.
SENT = 6_000_000
#: Entries of a longer list that are looked at first.
DEPTH = 64
_UNIT = 1e9  # scores are compared after rounding to 9 decimals, halves away from 0


class Longer:
    """The longer lists: of each the entries by weight, greatest first, then item, and the same by item."""

    def __init__(self, key: np.ndarray, item: np.ndarray, p: np.ndarray) -> None:
        best, named = np.lexsort((item, -p, key)), np.lexsort((item, key))
        self.keys, begin = np.unique(key, return_index=True)
        begin = np.searchsorted(key[best], self.keys)
        self.bounds = np.append(begin, len(key))
        self.best_item, self.best_p, self.item, self.p = item[best], p[best], item[named], p[named]

    def get(self, key: int) -> tuple[np.ndarray, ...] | None:
        """(items, p) by weight, (items, p) by item."""
        at = int(np.searchsorted(self.keys, key))
        if at == len(self.keys) or self.keys[at] != key:
            return None
        part = slice(self.bounds[at], self.bounds[at + 1])
        return self.best_item[part], self.best_p[part], self.item[part], self.p[part]


def best_of(lists: list[tuple[float, tuple[np.ndarray, ...]]], seen: np.ndarray, k: int, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The k items with the greatest sums of factor * p over the lists (factor, (items and p by weight, items and p by item)),
    ties by item, without those seen: (items, scores).

    The lists are read from their heads, every item found there is scored over whole lists, and reading ends where the sum of
    the next weights is below the k-th score: no item that was not met can have more. Else it goes on four times as deep.
    """
    longest = max(len(x[0]) for _, x in lists)
    while True:
        found = np.unique(np.concatenate([x[0][:depth] for _, x in lists]))
        if len(seen):
            found = np.setdiff1d(found, seen, assume_unique=False)
        score = np.zeros(len(found))
        for factor, (_, _, item, p) in lists:
            at = np.minimum(np.searchsorted(item, found), len(item) - 1)
            score += np.where(item[at] == found, factor * p[at], 0.0)
        key = np.floor(score * _UNIT + 0.5)
        order = np.argsort(-key, kind="stable")[:k]  # found is in the order of items
        rest = sum(factor * x[1][depth] for factor, x in lists if len(x[0]) > depth)
        if depth >= longest or len(order) == k and key[order[-1]] > np.floor(rest * _UNIT + 0.5) + 1:
            return found[order], score[order]
        depth *= 4


def _kernel(sent: Broadcast[Longer], fade: float, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            x = batch.column(1)
            s, at = x.flatten(), x.offsets.to_numpy() - x.offsets[0].as_py()
            place, item = s.field("place").to_numpy(), s.field("item").to_numpy()
            short = s.field("short")
            lengths = np.where(short.is_null().to_numpy(zero_copy_only=False), 0, np.diff(short.offsets.to_numpy()))
            ends = np.cumsum(lengths)
            inner = short.flatten()
            items, p = inner.field("item").to_numpy(), inner.field("p").to_numpy()
            users, found, scores = [], [], []
            for u in range(batch.num_rows):
                own = slice(at[u], at[u + 1])
                lists = []
                for r in np.flatnonzero(place[own]) + at[u]:
                    if lengths[r]:
                        i, w = items[ends[r] - lengths[r] : ends[r]], p[ends[r] - lengths[r] : ends[r]]
                        by = np.lexsort((i, -w))
                        lists.append((place[r], (i[by], w[by], i, w)))
                    elif (one := known.get(item[r])) is not None:
                        lists.append((place[r], one))
                if not lists:
                    continue
                lists = [(fade ** (float(n) - 1), one) for n, one in sorted(lists, key=lambda z: z[0])]
                got, score = best_of(lists, item[own][place[own] == 0], k)
                users.append(np.full(len(got), u))
                found.append(got)
                scores.append(score)
            if users:
                yield packed_lists(batch.column(0), *map(np.concatenate, (users, found, scores)))

    return run


def best_next(own: DataFrame, ends: DataFrame, odds: DataFrame, sizes: DataFrame, k: int, fade: float) -> DataFrame | None:
    """PACKED lists: the k items with the greatest sums of fade^(place - 1) * p over the lists of the user's ends,
    ties by item, without those in own. None where the longer lists have more than SENT entries.

    own has user_id, item; ends user_id, place (from 1), item; odds has key, item, p: the list of the end of that number; sizes
    key, size. Items are whole numbers in the order of ties. A user is one row, with their items and short lists.
    """
    spark = own.sparkSession
    long = sizes.where(F.col("size") > SHORT)
    if (long.agg(F.sum("size")).first()[0] or 0) > SENT:
        return None
    rows = odds.join(long.select("key"), "key", "left_semi").select("key", "item", "p").toArrow()
    sent = spark.sparkContext.broadcast(Longer(*(rows.column(c).to_numpy() for c in ("key", "item", "p"))))  # in order once, not in each task
    short = odds.join(sizes.where(F.col("size") <= SHORT).select("key"), "key", "left_semi").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("item", "p"))).alias("short"))
    none = F.lit(None).cast("array<struct<item:int,p:double>>")
    parts = ends.join(short, ends["item"] == short["key"], "left").select("user_id", "place", "item", "short")
    parts = parts.unionByName(own.select("user_id", F.lit(0).alias("place"), "item", none.alias("short")))
    packed = parts.groupBy("user_id").agg(F.collect_list(F.struct("place", "item", "short")).alias("x"))
    return packed.mapInArrow(_kernel(sent, fade, k), PACKED)
