"""Messages delivered more than once: exact dictionary codes and sharded, compressed bitmaps of what was seen.

State folder of an intake:

    batches/<batch>-<run>/dictionary   code, ident of the identifiers first met in the batch
    batches/<batch>-<run>/union        what the bitmaps let through (container, code, delivery) and the containers that
                                       changed (container, bits: zlib-compressed bit sets)
    batches/<batch>-<run>/merged-...   older dictionaries or containers put together
    log/<n>.json                       commits, numbered without gaps: the batch of the commit, and every live table

A commit is one file that appears whole or not at all, and only under the number after the one its batch was computed
from. Codes are whole numbers without gaps; a shard of the bitmaps, called container, holds 65,536 of them.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellarflow.functions.strings import strip_to_null
from cellarflow.functions.times import micros
from cellarflow.runtime import broadcast_if_small, newest_number, put_new, read_text

CONTAINER = 65_536
#: Tables of one level that are put together into one of the next.
FAN = 8
#: Bytes of an identifier in a broadcast, rounded up.
IDENT_BYTES = 200
_LAST = 9_223_372_036_854_775_807
_DICTIONARY = "code bigint, ident string"
_UNION = "container bigint, code bigint, delivery bigint, bits binary"
_LOW = (1 << 33) - 1  # the lower bits of monotonically_increasing_id count rows of a partition


def identifier(columns: Sequence[str]) -> Column:
    """The first of the columns that is neither null nor blank, stripped; null where none is."""
    return F.coalesce(*(strip_to_null(c) for c in columns))


def _union_of(blobs: Sequence[bytes]) -> np.ndarray:
    bits = np.zeros(CONTAINER, dtype=np.uint8)
    for blob in blobs:
        bits |= np.unpackbits(np.frombuffer(zlib.decompress(blob), dtype=np.uint8))
    return bits


def _test_and_set(key: tuple, arrivals: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
    """One container: the arrivals whose bit was unset, and one row with the union of bits. At most 65,536 codes."""
    bits = _union_of(seen["bits"])
    at = (arrivals["code"].to_numpy(dtype=np.int64) % CONTAINER).astype(np.int64)
    fresh = arrivals[bits[at] == 0]
    if fresh.empty:
        return pd.DataFrame({"container": [], "code": [], "delivery": [], "bits": []})
    bits[at] = 1
    return pd.DataFrame(
        {
            "container": key[0],
            "code": [*fresh["code"], -1],
            "delivery": [*fresh["delivery"], -1],
            "bits": [*[None] * len(fresh), zlib.compress(np.packbits(bits).tobytes())],
        }
    )


def _merge_bits(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    bits = zlib.compress(np.packbits(_union_of(rows["bits"])).tobytes())
    return pd.DataFrame({"container": [key[0]], "code": [-1], "delivery": [-1], "bits": [bits]})


def _covers(applied: list[list[int]], batch: int) -> bool:
    return any(lo <= batch <= hi for lo, hi in applied)


def _with(applied: list[list[int]], batch: int) -> list[list[int]]:
    """The ranges of applied batch numbers with one more in them."""
    out: list[list[int]] = []
    for lo, hi in sorted([*applied, [batch, batch]]):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


class ExactlyOnce:
    """An intake that lets exactly one delivery of each message through, over any number of batches.

    The identifier of a delivery is the first non-blank of id_columns, stripped. Of the deliveries of an identifier in
    one batch the one with the smallest (order columns, key) is let through, unless an earlier batch already let one
    through. Deliveries without an identifier are all let through. A null in an order column comes last. key must be unique
    and not null. Codes are exact: identifiers are compared as whole strings and never by a hash alone.

    A batch number is applied once: a retried or replayed batch gives the result of the first run. A batch is computed from
    one commit and counts only as the commit after it; where another writer was faster it is computed anew from that
    writer's commit, so no identifier or code is ever given twice, however many writers there are.

    A new identifier's code is the number of codes so far, the counts of the partitions before its own and its place there,
    so nothing is sorted and no task holds a shard. FAN dictionaries (and changed containers) of one level are merged
    into one of the next, so a batch reads few tables, and no superseded container for long. The identifiers of a small
    batch are broadcast to the dictionary, which then is scanned without a shuffle; a large batch joins it by shuffle.
    """

    def __init__(
        self,
        spark: SparkSession,
        state: str,
        *,
        id_columns: Sequence[str] = ("event_id", "idempotency_key"),
        key: str = "delivery_id",
        order: Sequence[str] = ("received_at",),
        attempts: int = 20,
    ) -> None:
        self.spark, self.state, self.attempts = spark, state.rstrip("/"), attempts
        self.id_columns, self.key, self.order = tuple(id_columns), key, (order,) if isinstance(order, str) else tuple(order)

    def state_now(self) -> tuple[int, dict]:
        """The number and content of the newest commit."""
        n = newest_number(self.spark, f"{self.state}/log")
        return n, json.loads(read_text(self.spark, f"{self.state}/log/{n}.json")) if n else {"codes": 0, "applied": [], "dictionary": [], "bitmaps": []}

    def _commit(self, n: int, entry: dict) -> bool:
        """False if another run made this commit first."""
        return put_new(self.spark, f"{self.state}/log/{n}.json", json.dumps(entry))

    def _read(self, paths: Sequence[str], schema: str) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.state}/{p}" for p in paths))

    def _write(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(f"{self.state}/{path}")
        return self.spark.read.schema(df.schema).parquet(f"{self.state}/{path}")

    def _arrivals(self, deliveries: DataFrame) -> DataFrame:
        """ident, delivery: the candidate of each identifier of a batch, its smallest (order, key). Each task combines its
        rows before the shuffle, so an identifier that holds a third of all rows sends one row per task."""
        at = [F.coalesce(self._ordinal(deliveries, c), F.lit(_LAST)).alias(f"at{i}") for i, c in enumerate(self.order)]
        rows = deliveries.select(identifier(self.id_columns).alias("ident"), *at, F.col(self.key).cast("bigint").alias("delivery")).where("ident is not null")
        names = [f"at{i}" for i in range(len(at))]
        return rows.groupBy("ident").agg(F.min(F.struct(*names, "delivery")).alias("_x")).select("ident", F.col("_x.delivery").alias("delivery"))

    @staticmethod
    def _ordinal(df: DataFrame, name: str) -> Column:
        return F.col(name).cast("bigint") if df.schema[name].dataType.typeName() in ("byte", "short", "integer", "long") else micros(df, name)

    def _encode(self, arrivals: DataFrame, state: dict, at: str) -> tuple[DataFrame, int]:
        """(code, delivery) of every arrival, and how many codes there are then; new identifiers go into a dictionary."""
        known_codes = None
        if state["dictionary"]:
            arrivals = self._write(arrivals, f"{at}/arrivals")
            known = self._read([p for p, _ in state["dictionary"]], _DICTIONARY)
            few = broadcast_if_small(arrivals, arrivals.count(), IDENT_BYTES)
            known_codes = self._write(known.join(few, "ident").select("ident", "code", "delivery"), f"{at}/met")
            arrivals = arrivals.join(known_codes.select("ident"), "ident", "left_anti")
        fresh = self._write(arrivals.withColumn("n", F.monotonically_increasing_id()), f"{at}/fresh")
        part = F.shiftright("n", 33)
        per = fresh.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))
        before = F.sum("rows").over(Window.orderBy("part")) - F.col("rows")  # one row per partition of the batch
        base = per.select("part", before.alias("base"))
        coded = fresh.join(F.broadcast(base), part == F.col("part")).select(
            (F.lit(state["codes"]) + F.col("base") + F.col("n").bitwiseAND(F.lit(_LOW))).alias("code"), "ident", "delivery"
        )
        coded = self._write(coded, f"{at}/dictionary")
        codes = state["codes"] + coded.count()
        coded = coded.select("code", "delivery")
        return coded if known_codes is None else coded.unionByName(known_codes.select("code", "delivery")), codes

    def _levelled(self, tables: list[list], new: str, at: str, merge: Callable[[DataFrame], DataFrame], schema: str) -> list[list]:
        """The live tables with a new one; FAN of a level are put together."""
        tables, level = [*tables, [new, 0]], 0
        while sum(x == level for _, x in tables) >= FAN:
            path = f"{at}/merged-{schema.split()[0]}-{level}"
            self._write(merge(self._read([p for p, x in tables if x == level], schema)), path)
            tables = [[p, x] for p, x in tables if x != level] + [[path, level + 1]]
            level += 1
        return tables

    def apply(self, deliveries: DataFrame, batch: int = 0) -> DataFrame:
        """Applies one batch and returns the keys (column `delivery`) of the identified deliveries let through."""
        for _ in range(self.attempts):
            n, state = self.state_now()
            if _covers(state["applied"], batch):
                while state["batch"] != batch:  # the newest commits first: a replay is nearly always of the last batch
                    n -= 1
                    state = json.loads(read_text(self.spark, f"{self.state}/log/{n}.json"))
                return self._through(state["path"])
            at = f"batches/{batch}-{uuid.uuid4().hex}"
            coded, codes = self._encode(self._arrivals(deliveries), state, at)
            container = F.expr(f"code div {CONTAINER}").alias("container")
            seen = self._read([p for p, _ in state["bitmaps"]], _UNION).where("bits is not null")
            tested = (
                coded.select(container, "code", "delivery").groupBy("container")
                .cogroup(seen.select("container", "bits").groupBy("container"))
                .applyInPandas(_test_and_set, _UNION)
            )
            self._write(tested, f"{at}/union")
            entry = {
                "batch": batch, "path": at, "codes": codes, "applied": _with(state["applied"], batch),
                "dictionary": self._levelled(state["dictionary"], f"{at}/dictionary", at, lambda df: df, _DICTIONARY),
                "bitmaps": self._levelled(
                    state["bitmaps"], f"{at}/union", at, lambda df: df.where("bits is not null").groupBy("container").applyInPandas(_merge_bits, _UNION), _UNION
                ),
            }
            if self._commit(n + 1, entry):
                return self._through(at)
        raise RuntimeError(f"batch {batch}: other writers were faster {self.attempts} times")

    def _through(self, path: str) -> DataFrame:
        return self._read([f"{path}/union"], _UNION).where("bits is null").select("delivery")

    def apply_past(self, deliveries: DataFrame, batches: int = 4) -> DataFrame:
        """Applies a table of past deliveries as batches 0, 1, .. in the intake's order; the keys let through by all.

        Batches are ranges of the first order column, cut at sampled quantiles; equal values stay together and nulls come
        last. Any cut gives the same rows: a message's first delivery is in the earliest batch that holds one of it, and in
        the later ones its bit is set.
        """
        first = self.order[0]
        at = self._ordinal(deliveries, first)
        cuts = deliveries.agg(F.percentile_approx(at, [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else None
        cuts = sorted(set(cuts or []))
        plain = deliveries.schema[first].dataType.typeName()
        value = lambda us: F.timestamp_micros(F.lit(us)) if plain == "timestamp" else F.lit(us)
        column = F.col(first) if plain == "timestamp" else at  # a plain comparison reaches the scan
        parts = []
        for i, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
            rows = deliveries if low is None else deliveries.where((column > value(low)) | (column.isNull() if high is None else F.lit(False)))
            rows = rows if high is None else rows.where(column <= value(high))
            parts.append(self.apply(rows, i))
        return reduce(DataFrame.unionByName, parts)

    def kept(self, deliveries: DataFrame, batch: int = 0) -> DataFrame:
        """The batch with exactly one delivery of each message not let through before; columns as they came."""
        return self.only(deliveries, self.apply(deliveries, batch))

    def copies(self, deliveries: DataFrame, batch: int = 0) -> DataFrame:
        """The deliveries of the batch that were held back; joined on the unique key, so no identifier is ever hot."""
        return self.without(deliveries, self.apply(deliveries, batch))

    def only(self, deliveries: DataFrame, through: DataFrame) -> DataFrame:
        """The deliveries let through, and all without an identifier."""
        named = identifier(self.id_columns)
        first = deliveries.where(named.isNotNull()).join(through, deliveries[self.key] == through["delivery"], "left_semi")
        return first.unionByName(deliveries.where(named.isNull()))

    def without(self, deliveries: DataFrame, through: DataFrame) -> DataFrame:
        """The identified deliveries that were not let through."""
        return deliveries.where(identifier(self.id_columns).isNotNull()).join(through, deliveries[self.key] == through["delivery"], "left_anti")

    def sink(self, write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function: write gets what each batch of a stream lets through. A batch that comes again gives the
        same rows, so a write that replaces by batch number is applied exactly once."""
        return lambda batch, number: write(self.kept(batch, number), number)
