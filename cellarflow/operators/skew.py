"""Per-key results when a few keys hold most records: composite range partitions and stitched partial states."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarflow.functions.strings import strip
from cellarflow.functions.times import micros

_STATE = "pid int, field string, key_value string, n bigint, partners bigint, first_us bigint, last_us bigint, edge boolean, head string, tail string"
#: Parts that rows alike in field, key, partner and time can be split into.
SALTS = 1024
_NEVER, _LATEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _changes(column: pa.Array) -> np.ndarray:
    """True where a value differs from the one before; null equals null. The first is True."""
    out = np.ones(len(column), dtype=bool)
    if len(column) > 1:
        here, before = column.slice(1), column.slice(0, len(column) - 1)
        same = pc.or_kleene(pc.equal(here, before), pc.and_(pc.is_null(here), pc.is_null(before)))
        out[1:] = ~pc.fill_null(same, False).to_numpy(zero_copy_only=False)
    return out


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (field, key, partner, time) of one partition to one partial state per key; the first and last are edges."""
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    opened: list | None = None  # field, key, n, partners, first, last, head, tail
    first_key = True

    def pack(states: list[list], edges: list[bool]) -> pa.RecordBatch:
        cols = list(zip(*states, strict=True))
        bound = lambda values, none: pa.array([None if v == none else v for v in values], pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([pid] * len(states), pa.int32()), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()),
                pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), bound(cols[4], _LATEST), bound(cols[5], _NEVER),
                pa.array(edges, pa.bool_()), pa.array(cols[6], pa.string()), pa.array(cols[7], pa.string()),
            ],
            names=["pid", "field", "key_value", "n", "partners", "first_us", "last_us", "edge", "head", "tail"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        field, key, partner, time = (batch.column(i) for i in range(4))
        new_key = _changes(field) | _changes(key)
        valid = pc.is_valid(partner).to_numpy(zero_copy_only=False)
        new_partner = (new_key | _changes(partner)) & valid
        starts = np.flatnonzero(new_key)
        ends = np.append(starts[1:], batch.num_rows)
        missing = np.asarray(pc.is_null(time).to_numpy(zero_copy_only=False))
        at = pc.fill_null(time, 0).to_numpy(zero_copy_only=False)
        least = np.minimum.reduceat(np.where(missing, _LATEST, at), starts)
        most = np.maximum.reduceat(np.where(missing, _NEVER, at), starts)
        partners = np.add.reduceat(new_partner.astype(np.int64), starts)
        nulls = np.add.reduceat((~valid).astype(np.int64), starts)  # nulls come first in a key
        heads = partner.take(pa.array(np.minimum(starts + nulls, ends - 1))).to_pylist()
        tails = partner.take(pa.array(ends - 1)).to_pylist()
        runs = [
            list(x)
            for x in zip(
                field.take(pa.array(starts)).to_pylist(), key.take(pa.array(starts)).to_pylist(), (ends - starts).tolist(),
                partners.tolist(), least.tolist(), most.tolist(), heads, tails, strict=True,
            )
        ]
        if opened is not None and opened[:2] == runs[0][:2]:
            run = runs[0]
            both = opened[7] is not None and opened[7] == run[6]
            runs[0] = [
                *run[:2], opened[2] + run[2], opened[3] + run[3] - both, min(opened[4], run[4]), max(opened[5], run[5]),
                run[6] if opened[6] is None else opened[6], opened[7] if run[7] is None else run[7],
            ]
        elif opened is not None:
            runs.insert(0, opened)
        opened = runs.pop()
        if runs:
            yield pack(runs, [first_key, *[False] * (len(runs) - 1)])
            first_key = False
    if opened is not None:
        yield pack([opened], [True])


def key_statistics(
    records: DataFrame, fields: Sequence[tuple[str, str]], *, time: str, partitions: int | None = None
) -> DataFrame:
    """For every value of each field: field, key_value, n_rows, n_partners, first_us, last_us.

    fields are (key column, partner column) pairs. Keys and partners are stripped; a row whose key is null counts for no
    key of that field. n_rows counts all rows of the key, n_partners the different non-null partners, first_us and
    last_us are the earliest and latest non-null time in microseconds, null where there is none. Empty input gives an
    empty result; other columns are ignored.

    Rows are range-partitioned on (field, key, partner, time) with sampled quantiles, so a key of any weight is spread
    over as many partitions as its share of the rows calls for. Rows alike in all four are told apart by a salt, the row's number
    within its input partition modulo SALTS, so even one row repeated without end is split. Each partition folds its sorted rows into one state per
    key in Arrow batches; only a partition's first and last key can continue elsewhere. Stitching sums the states of a
    key and takes off one partner for each partition boundary that the same partner spans: at most two edges a partition.
    """
    at = micros(records, time)
    pairs = F.array(
        *(
            F.struct(F.lit(k).alias("field"), strip(k).alias("key_value"), strip(p).alias("partner"))
            for k, p in fields
        )
    )
    rows = (
        records.select(F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("short").alias("salt"), F.inline(pairs), at.alias("t"))
        .where("key_value is not null")
        .select("field", "key_value", "partner", "t", "salt")
    )
    order = ["field", "key_value", "partner", "t"]
    ranges = [*order, "salt"]
    spread = rows.repartitionByRange(partitions, *ranges) if partitions else rows.repartitionByRange(*ranges)
    states = spread.drop("salt").sortWithinPartitions(*order).mapInArrow(_states, _STATE)
    edge = F.when(F.col("edge"), F.struct("pid", "head", "tail"))
    stitched = states.groupBy("field", "key_value").agg(
        F.sum("n").alias("n_rows"),
        F.sum("partners").alias("_partners"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.array_sort(F.collect_list(edge)).alias("_edges"),
    )
    spans = F.expr(
        "aggregate(_edges, named_struct('before', cast(null as string), 'n', 0L), "
        "(a, x) -> named_struct('before', coalesce(x.tail, a.before), 'n', a.n + if(x.head = a.before, 1L, 0L)), a -> a.n)"
    )
    return stitched.select(
        "field", "key_value", "n_rows", (F.col("_partners") - F.when(F.size("_edges") > 1, spans).otherwise(F.lit(0))).alias("n_partners"), "first_us", "last_us"
    )


def heavy_keys(
    records: DataFrame, fields: Sequence[tuple[str, str]], *, time: str, share: float = 0.02, partitions: int | None = None
) -> DataFrame:
    """The keys of key_statistics that hold at least the given share of all rows, nulls included in the total."""
    total = records.agg(F.count(F.lit(1)))
    found = key_statistics(records, fields, time=time, partitions=partitions)
    return found.where(F.col("n_rows") / total.scalar() >= F.lit(float(share)))
