"""Best items of users from the lists of near items of what they touched: numpy within a task, so that only users' own rows are shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarflow.operators.pair_sums import summed
from cellarflow.runtime import cleaned

#: Entries of all lists together that are sent to every task, 12 bytes each, those of the items of most users first; the
#: other lists travel with the rows that they are for.
SENT = 4_000_000
#: Products held before they are summed.
FLUSH = 2_000_000
#: One row per user: numbers of items by rank, and their scores.
PACKED = "user_id string, items array<int>, scores array<double>"
_UNIT = 1e9  # scores are compared after rounding to 9 decimals, halves away from 0


class Lists:
    """Lists (item, s) by key."""

    def __init__(self, key: np.ndarray, item: np.ndarray, s: np.ndarray) -> None:
        order = np.argsort(key, kind="stable")
        self.keys, begin = np.unique(key[order], return_index=True)
        self.bounds = np.append(begin, len(key))
        self.item, self.s = item[order], s[order]
        self.least = np.minimum.reduceat(self.s, begin) if len(key) else np.empty(0)

    def places(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each item's list begins, and its length; 0 for an item without a list here."""
        if not len(self.keys):
            return np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
        at = np.minimum(np.searchsorted(self.keys, items), len(self.keys) - 1)
        return self.bounds[at], np.where(self.keys[at] == items, self.bounds[at + 1] - self.bounds[at], 0)

    def ends(self, items: np.ndarray, k: int) -> np.ndarray:
        """The least s of each item's list, where that has k entries or more; else 0."""
        if not len(self.keys):
            return np.zeros(len(items))
        at = np.minimum(np.searchsorted(self.keys, items), len(self.keys) - 1)
        return np.where((self.keys[at] == items) & (self.bounds[at + 1] - self.bounds[at] >= k), self.least[at], 0.0)


def _products(row: np.ndarray, weight: np.ndarray, at: np.ndarray, size: np.ndarray, item: np.ndarray, s: np.ndarray, flush: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row << 32 | item, weight * s) for each entry of each row's lists, about flush of them at a time."""
    until = np.cumsum(size)
    begin = 0
    while begin < len(row):
        stop = max(begin + 1, int(np.searchsorted(until, until[begin] - size[begin] + flush, side="right")))
        n = size[begin:stop]
        of = np.repeat(np.arange(begin, stop), n)
        entry = np.arange(n.sum()) + np.repeat(at[begin:stop] - (np.cumsum(n) - n), n)
        yield row[of].astype(np.int64) << 32 | item[entry], weight[of] * s[entry]
        begin = stop


def best_of_rows(row: np.ndarray, own: np.ndarray, parts: list[tuple[np.ndarray, ...]], k: int, flush: int = FLUSH, most: bool = False, floor: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """The k items of each row with the greatest sums above 0, ties by item, without the row's own: (row, item, rank, score).

    most takes an item's greatest product instead of the sum, and leaves out nothing; floor is then what k items of each row have at least. parts are (row, weight, begin, size, items, s): the lists of a row's items, as slices of items and s.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, by = 0, np.maximum if most else np.add
    for part in parts:
        for key, s in _products(*part, flush):
            if floor is not None:
                near = s >= floor[key >> 32] - 2 / _UNIT  # what is below the first k is not worth sorting
                key, s = key[near], s[near]
            held.append((key, s))
            size += len(key)
            if size >= flush:
                held[:] = [summed(*map(np.concatenate, zip(*held, strict=True)), by)]
                size = 0
    if not held or not sum(len(key) for key, _ in held):
        return tuple(np.empty(0, kind) for kind in (np.int64, np.int64, np.int64, np.float64))
    key, score = summed(*map(np.concatenate, zip(*held, strict=True)), by)
    seen = np.sort(row.astype(np.int64) << 32 | own)
    fresh = (score > 0) & (most or seen[np.minimum(np.searchsorted(seen, key), len(seen) - 1)] != key)
    key, score = key[fresh], score[fresh]
    of, item = key >> 32, key & 0xFFFFFFFF
    order = np.lexsort((item, -np.floor(score * _UNIT + 0.5), of))
    of, item, score = of[order], item[order], score[order]
    rank = np.arange(len(of)) - np.searchsorted(of, of) + 1
    first = rank <= k
    return of[first], item[first], rank[first], score[first]


def packed_lists(users: pa.Array, of: np.ndarray, items: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    """PACKED rows of the users with entries; entries come by user, then rank."""
    rows, begin = np.unique(of, return_index=True)
    offsets = pa.array(np.append(begin, len(of)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (items.astype(np.int32), scores.astype(np.float64))]
    return pa.RecordBatch.from_arrays([users.take(pa.array(rows.astype(np.int64))), *lists], names=["user_id", "items", "scores"])


def unpacked(lists: DataFrame) -> DataFrame:
    """PACKED lists as rows (user_id, item, rank, score)."""
    each = lists.select("user_id", F.posexplode(F.arrays_zip("items", "scores")).alias("_at", "_one"))
    return each.select("user_id", F.col("_one.items").alias("item"), (F.col("_at") + 1).alias("rank"), F.col("_one.scores").alias("score"))


def _kernel(sent: Broadcast[Lists], k: int, flush: int, most: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            x = batch.column(1)
            offsets = x.offsets.to_numpy().astype(np.int64)
            entries = x.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            item, weight = entries.field("item").to_numpy(), entries.field("weight").to_numpy()
            at, size = known.places(item)
            near = entries.field("near")
            inner = near.flatten()
            other, s = inner.field("item").to_numpy(), inner.field("s").to_numpy()
            sizes = np.where(near.is_null().to_numpy(zero_copy_only=False), 0, np.diff(near.offsets.to_numpy())).astype(np.int64)
            begins = np.cumsum(sizes) - sizes
            floor = None
            if most:
                ends, there = known.ends(item, k), np.flatnonzero(sizes)
                ends[there] = np.where(sizes[there] >= k, np.minimum.reduceat(s, begins[there]), 0.0) if len(there) else 0.0
                floor = np.zeros(batch.num_rows)
                np.maximum.at(floor, row, weight * ends)
            until = np.append(0, np.cumsum(size + sizes))[offsets - offsets[0]]  # entries of the lists of the rows before each row
            begin = 0
            while begin < batch.num_rows:
                stop = max(begin + 1, int(np.searchsorted(until, until[begin] + flush, side="right")) - 1)
                p = slice(offsets[begin] - offsets[0], offsets[stop] - offsets[0])
                parts = [(row[p], weight[p], at[p], size[p], known.item, known.s), (row[p], weight[p], begins[p], sizes[p], other, s)]
                of, found, _, score = best_of_rows(row[p], item[p], parts, k, flush, most, floor)
                yield packed_lists(batch.column(0), of, found, score)
                begin = stop

    return run


def best_near(own: DataFrame, near: DataFrame, k: int, *, most: bool = False) -> DataFrame:
    """PACKED lists: the k items with the greatest sums above 0 of weight * s over the lists of the user's items,
    ties by item, without the user's own; most takes an item's greatest product instead of the sum, and leaves out nothing.

    own has user_id, item, weight; near has key, item, s: the list of the item of that number. Items are whole numbers in the
    order of ties. The lists of the items of most users, up to SENT entries, are sent to every task once; the others are joined
    with the users' items as one row per item. A user is one row, and sums are made within tasks, so what is shuffled
    grows with the users' items and not with their items times the lists.
    """
    spark = own.sparkSession
    uses = own.groupBy("item").agg(F.floor(F.log2(F.count(F.lit(1)).cast("double"))).alias("bin"))
    sizes = near.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    bins = uses.join(sizes, uses["item"] == sizes["key"]).groupBy("bin").agg(F.sum("size").alias("n")).orderBy(F.desc("bin"))
    with cleaned(spark):
        bins = bins.collect()  # 64 rows at most
    least, total = None, 0
    for r in bins:
        total += r["n"]
        if total > SENT:
            break
        least = r["bin"]
    whole = total <= SENT
    hot = near if whole else near.join(uses.where(F.col("bin") >= F.lit(least if least is not None else 64)).select(F.col("item").alias("key")), "key", "left_semi")
    rows = hot.select("key", "item", "s").toArrow()
    sent = spark.sparkContext.broadcast(Lists(*(rows.column(c).to_numpy() for c in ("key", "item", "s"))))  # in order once, not in each task
    if whole:
        parts = own.withColumn("near", F.lit(None).cast("array<struct<item:int,s:double>>"))
    else:
        cold = uses.where(F.col("bin") < F.lit(least if least is not None else 64)).select(F.col("item").alias("key"))
        lists = near.join(cold, "key", "left_semi").groupBy("key").agg(F.collect_list(F.struct("item", "s")).alias("near"))
        parts = own.join(lists, own["item"] == lists["key"], "left").select("user_id", "item", "weight", "near")
    packed = parts.groupBy("user_id").agg(F.collect_list(F.struct("item", "weight", "near")).alias("x"))
    return packed.mapInArrow(_kernel(sent, k, FLUSH, most), PACKED)
