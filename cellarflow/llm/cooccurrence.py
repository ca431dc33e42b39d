"""Items that appear together: stripes of neighbours per item, merged by key, with lift and log-likelihood ratio."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellarflow.functions.strings import strip
from cellarflow.functions.times import DAY_US, micros
from cellarflow.runtime import broadcast_if_small, materialize

#: Items of a basket that one row holds, about; larger baskets are cut into pieces by a hash of the item.
PIECE = 2048
#: Baskets of an item for which one stripe bucket is enough.
STRIPE_BASKETS = 8192
#: Pairs held before a task sends its merged stripes on.
FLUSH_PAIRS = 1_000_000
#: Bytes of a row of the code table in a broadcast, rounded up.
CODE_BYTES = 200
_STRIPE = "a bigint, bucket int, b array<bigint>, n array<bigint>"


def _merged(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The arrays summed by (a, b), in that order."""
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    first = np.ones(len(a), dtype=bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(first)
    return a[at], b[at], np.add.reduceat(n, at)


def _stripes(flush: int = FLUSH_PAIRS, wide: int = STRIPE_BASKETS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (items, counts, others, other_counts) to stripes, merged within the task: the pairs of items, or, where others is not
    null, of each item with each other one. The smaller code of a pair has the stripe."""

    def emit(a: np.ndarray, b: np.ndarray, n: np.ndarray, parts: np.ndarray) -> pa.RecordBatch:
        bucket = np.where(parts > 1, b % np.maximum(parts, 1), 0)
        order = np.lexsort((b, bucket, a))
        a, b, n, bucket = a[order], b[order], n[order], bucket[order]
        first = np.ones(len(a), dtype=bool)
        first[1:] = (a[1:] != a[:-1]) | (bucket[1:] != bucket[:-1])
        at = np.flatnonzero(first)
        offsets = pa.array(np.append(at, len(a)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (b, n)]
        return pa.RecordBatch.from_arrays([pa.array(a[at], pa.int64()), pa.array(bucket[at], pa.int32()), *lists], names=["a", "bucket", "b", "n"])

    def within(items: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of each of several rows of the sizes given, in portions of about flush pairs."""
        starts = np.cumsum(sizes) - sizes
        left = np.arange(len(items))
        later = np.repeat(sizes + starts, sizes) - left - 1
        begin = 0
        while begin < len(left):
            ends = np.cumsum(later[begin:])
            stop = begin + max(1, int(np.searchsorted(ends, flush, side="right")))
            reps = later[begin:stop]
            at = np.repeat(left[begin:stop], reps)
            step = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + 1
            yield items[at], items[at + step]
            begin = stop

    def between(items: np.ndarray, others: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(1, flush // max(1, len(others)))
        for i in range(0, len(items), step):
            part = items[i : i + step]
            yield np.repeat(part, len(others)), np.tile(others, len(part))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        widths: dict[int, int] = {}
        size = 0

        def drain() -> pa.RecordBatch:
            a, b, n = _merged(*(np.concatenate(x) for x in zip(*held, strict=True)))
            parts = np.fromiter((widths.get(int(x), 1) for x in a), np.int64, len(a)) if widths else np.ones(len(a), np.int64)
            held.clear()
            return emit(a, b, n, parts)

        def portions(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            alone = batch.filter(batch.column(2).is_null())
            met = batch.filter(batch.column(2).is_valid())
            for lists, counts in ((x.column(i), x.column(i + 1)) for x, i in ((alone, 0), (met, 0), (met, 2))):
                items, freq = lists.flatten().to_numpy(), counts.flatten().to_numpy()
                for x, c in zip(items[freq > wide], freq[freq > wide], strict=True):
                    widths[int(x)] = int(-(-c // wide))
            lists = alone.column(0)
            yield from within(lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()).astype(np.int64))
            for i in range(met.num_rows):
                yield from between(met.column(0)[i].values.to_numpy(), met.column(2)[i].values.to_numpy())

        for batch in batches:
            for x, y in portions(batch):
                if not len(x):
                    continue
                held.append((np.minimum(x, y), np.maximum(x, y), np.ones(len(x), np.int64)))
                size += len(x)
                if size >= flush:
                    held[:] = [_merged(*(np.concatenate(z) for z in zip(*held, strict=True)))]
                    size = len(held[0][0])
                    if size >= flush // 2:
                        yield drain()
                        size = 0
        if held:
            yield drain()

    return run


def llr(n_ab: Column, n_a: Column, n_b: Column, total: Column) -> Column:
    """Dunning's log-likelihood ratio of the 2x2 table of baskets with a and with b."""

    def part(k: Column, row: Column, col: Column) -> Column:
        return F.when(k > 0, k * F.log(k * total / (row * col))).otherwise(F.lit(0.0))

    without = total - n_a - n_b + n_ab
    return 2 * (
        part(n_ab, n_a, n_b) + part(n_a - n_ab, n_a, total - n_b) + part(n_b - n_ab, total - n_a, n_b) + part(without, total - n_a, total - n_b)
    )


def pairs_together(
    events: DataFrame,
    *,
    user: str = "user_id",
    item: str = "item_id",
    time: str = "occurred_at",
    min_together: int = 1,
    min_lift: int = 0,
    min_llr: float | None = None,
) -> DataFrame:
    """One row per pair of different items of a common basket: item_a < item_b, n_ab, n_a, n_b, n_baskets, lift, llr.

    A basket is the set of different items of one user on one UTC date. Ids are stripped; rows with a null user, item or
    time are left out; an empty id is an id. n_baskets counts all baskets, those of one item too. lift is
    n_ab * n_baskets / (n_a * n_b); llr is the log-likelihood ratio. Kept are pairs with n_ab >= min_together,
    n_ab * n_baskets >= min_lift * n_a * n_b (in whole numbers) and llr >= min_llr. With the defaults nothing is left out.
    Repeated rows count once, other columns are ignored, empty input gives an empty result.

    Items that no kept pair can contain are pruned before any pair is made: those in fewer than min_together baskets, and,
    since n_ab is at most the smaller count, those in more than n_baskets / min_lift. Baskets travel as arrays of codes. One of
    more than PIECE items is cut into pieces by a hash of the item before anything is gathered, and each piece meets each
    other one in a row of its own: no row holds more than two pieces, a large basket is spread over many tasks, and a code of
    it travels as often as it has pieces. Each task merges the stripes of its rows, and the stripe of a frequent item is
    split by neighbour before it is shuffled, so neither a basket nor an item is ever gathered whole.
    """
    base = materialize(
        events.select(strip(user).alias("u"), micros(events, time).alias("t"), strip(item).alias("item"))
        .where("u is not null and item is not null and t is not null")
        .select("u", F.expr(f"t div {DAY_US} - if(t % {DAY_US} < 0, 1, 0)").cast("int").alias("day"), "item")
        .distinct(),
        "baskets",
    )
    sizes = base.groupBy("u", "day").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > PIECE)
    n_baskets, n_large = sizes.agg(F.count(F.lit(1)), F.count_if(F.col("n") > PIECE)).first()
    counts = base.groupBy("item").agg(F.count(F.lit(1)).alias("n_item"))
    kept = counts.where((F.col("n_item") >= F.lit(min_together)) & (F.col("n_item") * F.lit(min_lift) <= F.lit(n_baskets)))
    # codes follow the order of the items: range partitions in order, rows sorted in each
    codes = materialize(
        kept.repartitionByRange("item").sortWithinPartitions("item").select("item", "n_item", F.monotonically_increasing_id().alias("code")),
        "codes",
    )
    n_codes = codes.count()
    coded = base.join(broadcast_if_small(codes, n_codes, CODE_BYTES), "item").select("u", "day", "code", "n_item")
    if n_large:
        coded = coded.join(broadcast_if_small(large, n_large, CODE_BYTES), ["u", "day"], "left")
        pieces = F.ceil(F.coalesce("n", F.lit(1)) / F.lit(PIECE)).cast("int")
        coded = coded.withColumn("pieces", pieces).withColumn("piece", F.pmod(F.xxhash64("code"), F.col("pieces")).cast("int"))
    else:
        coded = coded.withColumns({"pieces": F.lit(1), "piece": F.lit(0)})
    packed = coded.groupBy("u", "day", "pieces", "piece").agg(F.collect_list(F.struct("code", "n_item")).alias("xs"))  # about PIECE at most
    nothing = F.lit(None).cast("array<bigint>")
    rows = packed.where(F.size("xs") > 1).select(F.col("xs.code").alias("items"), F.col("xs.n_item").alias("counts"), nothing.alias("others"), nothing.alias("other_counts"))
    if n_large:
        packed = materialize(packed.where("pieces > 1"), "pieces")
        left = packed.where("piece < pieces - 1").select("u", "day", F.col("piece").alias("p"), F.explode(F.expr("sequence(piece + 1, pieces - 1)")).alias("q"), F.col("xs").alias("x"))
        right = packed.where("piece > 0").select("u", "day", F.col("piece").alias("q"), F.explode(F.expr("sequence(0, piece - 1)")).alias("p"), F.col("xs").alias("y"))
        rows = rows.unionByName(left.join(right, ["u", "day", "p", "q"]).select(F.col("x.code").alias("items"), F.col("x.n_item").alias("counts"), F.col("y.code").alias("others"), F.col("y.n_item").alias("other_counts")))
    stripes = rows.mapInArrow(_stripes(), _STRIPE)
    merged = (
        stripes.repartition("a", "bucket")
        .select("a", "bucket", F.inline(F.arrays_zip("b", "n")).alias("b", "n"))
        .groupBy("a", "bucket", "b")
        .agg(F.sum("n").alias("n_ab"))
        .where(F.col("n_ab") >= F.lit(min_together))
    )
    side = lambda s: codes.select(F.col("code").alias(s), F.col("item").alias(f"item_{s}"), F.col("n_item").alias(f"n_{s}"))
    named = merged.join(broadcast_if_small(side("a"), n_codes, CODE_BYTES), "a").join(broadcast_if_small(side("b"), n_codes, CODE_BYTES), "b")
    total = F.lit(n_baskets).cast("bigint")
    rated = (
        named.select("item_a", "item_b", "n_ab", "n_a", "n_b", total.alias("n_baskets"))
        .where(F.col("n_ab").cast("decimal(38,0)") * total >= F.col("n_a").cast("decimal(38,0)") * F.col("n_b") * F.lit(min_lift))
        .withColumn("lift", F.col("n_ab").cast("double") * total / (F.col("n_a").cast("double") * F.col("n_b")))
        .withColumn("llr", llr(*(F.col(c).cast("double") for c in ("n_ab", "n_a", "n_b", "n_baskets"))))
    )
    return rated if min_llr is None else rated.where(F.col("llr") >= F.lit(float(min_llr)))
