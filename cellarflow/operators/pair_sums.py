"""Sums of products over pairs of entries of one row: numpy within a task, merged there before anything is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarflow.runtime import materialize

#: Pairs held before a task sends its sums on.
FLUSH_PAIRS = 2_000_000


def summed(key: np.ndarray, s: np.ndarray, by: np.ufunc = np.add) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and the sum of each, or what else by makes of its values."""
    order = np.argsort(key)
    key, s = key[order], s[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[at], by.reduceat(s, at)


def _sums(flush: int = FLUSH_PAIRS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (items, values, others, other_values) to (a, b, s) with a < b: pairs of items, or, where others is not null, of each
    item with each other one."""

    def within(items: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        left = np.arange(len(items))
        later = np.repeat(np.cumsum(sizes), sizes) - left - 1
        begin = 0
        while begin < len(left):
            stop = begin + max(1, int(np.searchsorted(np.cumsum(later[begin:]), flush, side="right")))
            reps = later[begin:stop]
            i = np.repeat(left[begin:stop], reps)
            j = i + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + 1
            yield items[i], items[j], values[i] * values[j]
            begin = stop

    def between(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        step = max(1, flush // max(1, len(b)))
        for i in range(0, len(a), step):
            yield np.repeat(a[i : i + step], len(b)), np.tile(b, len(a[i : i + step])), np.outer(x[i : i + step], y).ravel()

    def portions(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        alone, met = batch.filter(batch.column(2).is_null()), batch.filter(batch.column(2).is_valid())
        items = alone.column(0)
        yield from within(items.flatten().to_numpy(), alone.column(1).flatten().to_numpy(), np.diff(items.offsets.to_numpy()).astype(np.int64))
        for r in range(met.num_rows):
            yield from between(*(met.column(c)[r].values.to_numpy() for c in range(4)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def drain() -> pa.RecordBatch:
            key, s = summed(*map(np.concatenate, zip(*held, strict=True)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array((key >> 32).astype(np.int32)), pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.array(s)], names=["a", "b", "s"])

        for batch in batches:
            for a, b, s in portions(batch):
                if len(a):
                    held.append((np.minimum(a, b).astype(np.int64) << 32 | np.maximum(a, b), s))
                    size += len(a)
                if size >= flush:
                    held[:] = [summed(*map(np.concatenate, zip(*held, strict=True)))]
                    size = len(held[0][0])
                    if size >= flush // 2:
                        yield drain()
                        size = 0
        if held:
            yield drain()

    return run


def pair_sums(entries: DataFrame, piece: int, largest: int) -> DataFrame:
    """(a, b, s) with a < b: over all groups, the sum of the products of the values of two different items of a group.

    entries has group, item (whole numbers from 0), v and n_group, how many items the group has, at most largest; an item at most
    once a group. Pairs are made once, not twice. A group of more than piece items is cut into pieces by a hash of the item
    before it is gathered, and each piece meets each later one in a row of its own, so no row holds more than two pieces and one
    group is spread over many tasks. Each task sums its pairs before they are shuffled. Empty entries give an empty result.
    """
    none = lambda kind: F.lit(None).cast(f"array<{kind}>")
    packed = entries.withColumn("pieces", F.ceil(F.col("n_group") / F.lit(piece)).cast("int")) if largest > piece else entries.withColumn("pieces", F.lit(1))
    piece_no = F.pmod(F.xxhash64("item"), F.col("pieces")).cast("int")
    packed = packed.groupBy("group", "pieces", piece_no.alias("piece")).agg(F.collect_list(F.struct("item", "v")).alias("x"))  # about piece at most
    if largest > piece:
        packed = materialize(packed, "packed")
    rows = packed.where(F.size("x") > 1).select(F.col("x.item").alias("items"), F.col("x.v").alias("values"), none("int").alias("others"), none("double").alias("other_values"))
    if largest > piece:
        large = packed.where("pieces > 1")
        left = large.where("piece < pieces - 1").select("group", F.col("piece").alias("p"), F.explode(F.expr("sequence(piece + 1, pieces - 1)")).alias("q"), "x")
        right = large.where("piece > 0").select("group", F.col("piece").alias("q"), F.explode(F.expr("sequence(0, piece - 1)")).alias("p"), F.col("x").alias("y"))
        met = left.join(right, ["group", "p", "q"])
        rows = rows.unionByName(met.select(F.col("x.item").alias("items"), F.col("x.v").alias("values"), F.col("y.item").alias("others"), F.col("y.v").alias("other_values")))
    return rows.mapInArrow(_sums(), "a int, b int, s double").groupBy("a", "b").agg(F.sum("s").alias("s"))
