"""Events as they come: normalising, duplicates within a batch, slices of a batch, the merge into stored rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cellarflow.config import FeatureConfig
from cellarflow.functions.strings import strip, strip_to_null
from cellarflow.functions.times import micros
from cellarflow.operators.interactions import base_weight, quantity_factor
from cellarflow.runtime import materialize
from cellarflow.schemas import COLD_START_USER, nan_to_null

#: Decimals that a batch's sums are rounded to before they order items.
SUM_DECIMALS = 6
#: The part of a user's places that just-touched items may take.
BOOST_SHARE = 0.3
# Sources of rows that a batch keeps.
PRESERVED = ("personalized", "item_based", "sequential", "content_fallback", "blended")
_ROWS = ("user_id", "item_id", "rank", "score", "source")


def event_time(df: DataFrame, name: str) -> Column:
    """Microseconds: of timestamps, of epoch seconds, of ISO texts with an offset or Z; a text without one is null."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        text = strip(name)
        return F.when(text.rlike(r"(?i)(z|[+-]\d\d(:?\d\d)?)$"), F.unix_micros(F.expr(f"try_cast(trim(`{name}`) as timestamp)")))
    if isinstance(kind, T.NumericType):
        return F.round(F.col(name).cast("double") * 1_000_000).cast("bigint")
    return micros(df, name)


def fingerprint() -> Column:
    return F.concat_ws("|", "user_id", "item_id", "event_type", F.col("quantity").cast("string"), F.col("t").cast("string"))


def normalise(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejected). Events: event_id, user_id, item_id, event_type (stripped), quantity, t; rejected: raw rows.

    An event needs a user, item and type that are not blank and a time that can be read. Quantity is 1 where it is null or
    missing; one that is no whole number or below 1 is rejected. event_id is the event's, else its idempotency_key, else
    its fingerprint, so that a delivery without ids is recognised when it comes again.
    """
    has = lambda c: c in raw.columns
    quantity = F.expr("try_cast(quantity as double)") if has("quantity") else F.lit(None).cast("double")
    missing = F.col("quantity").isNull() if has("quantity") else F.lit(True)
    whole = F.when(missing, F.lit(1.0)).otherwise(quantity)
    columns = {f"_{c}": strip_to_null(F.col(c).cast("string")) if has(c) else F.lit(None).cast("string") for c in ("user_id", "item_id", "event_type", "event_id", "idempotency_key")}
    ready = raw.withColumns(columns | {"_q": whole, "_t": event_time(raw, "occurred_at")})
    valid = F.coalesce(
        F.col("_user_id").isNotNull() & F.col("_item_id").isNotNull() & F.col("_event_type").isNotNull() & F.col("_t").isNotNull()
        & (F.col("_q") >= 1) & (F.col("_q") == F.floor("_q")) & (F.col("_q") <= 2_147_483_647), F.lit(False),
    )
    good = ready.where(valid).select(
        F.col("_user_id").alias("user_id"), F.col("_item_id").alias("item_id"), F.col("_event_type").alias("event_type"), F.col("_q").cast("int").alias("quantity"),
        F.col("_t").alias("t"), F.coalesce("_event_id", "_idempotency_key").alias("given"),
    )
    events = good.select(F.coalesce("given", fingerprint()).alias("event_id"), "user_id", "item_id", "event_type", "quantity", "t")
    return events, ready.where(~valid).drop(*columns, "_q", "_t")


def dedupe_batch(events: DataFrame) -> DataFrame:
    """One event per event_id, then one per fingerprint; the earliest t stays, ties by the other columns."""
    order = (F.asc("t"), F.asc("user_id"), F.asc("item_id"), F.asc("event_type"), F.asc("quantity"))
    first = lambda key, *o: F.row_number().over(Window.partitionBy(*key).orderBy(*o))
    once = events.withColumn("_n", first(["event_id"], *order)).where("_n = 1").drop("_n")
    same = ["user_id", "item_id", "event_type", "quantity", "t"]
    return once.withColumn("_n", first(same, F.asc("event_id"))).where("_n = 1").drop("_n")


def known(events: DataFrame, config: FeatureConfig | None) -> DataFrame:
    return events if config is None else events.where(base_weight(config).isNotNull())


def popular_slice(events: DataFrame, config: FeatureConfig | None, k: int) -> DataFrame:
    """(item_id, score, place): summed weights of the batch, without caps or decay; events of weight 0 have no part.
    Without a configuration an event weighs its quantity."""
    weight = F.col("quantity").cast("double") if config is None else base_weight(config) * quantity_factor(config)
    sums = events.withColumn("w", weight).where("w <> 0").groupBy("item_id").agg(F.round(F.sum("w"), SUM_DECIMALS).alias("score"))
    best = sums.orderBy(F.desc("score"), "item_id").limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "item_id")))


def latest_slice(events: DataFrame, config: FeatureConfig | None, k: int) -> DataFrame:
    """(item_id, score, place): the items of the newest events of known types; the score falls from k by 1."""
    newest = known(events, config).groupBy("item_id").agg(F.max("t").alias("t")).orderBy(F.desc("t"), "item_id").limit(k)
    placed = newest.withColumn("place", F.row_number().over(Window.orderBy(F.desc("t"), "item_id")))
    return placed.select("item_id", (F.lit(k) - F.col("place") + 1).cast("double").alias("score"), "place")


def is_preserved(source: str = "source") -> Column:
    return F.exists(F.split(F.coalesce(F.col(source), F.lit("")), r"\+"), lambda x: x.isin(*PRESERVED))


def merge_batch(prior: DataFrame, events: DataFrame, config: FeatureConfig | None, k: int) -> DataFrame:
    """The new rows of every user of the batch and of the cold-start user: user_id, item_id, rank, score, source.

    A user's places go to the items just touched (newest first, at most max(1, 30 % of k), label incremental), then to prior
    rows of a preserved source by rank (as many as are left), then to the batch's popular and latest items. An item
    stays in its first tier. The cold-start user gets popular, latest, then its prior rows. Null ranks come last.
    Events need to be normalised; an empty batch gives no rows.
    """
    pop, new = popular_slice(events, config, k), latest_slice(events, config, k)
    users = events.select("user_id").distinct()
    slots = max(1, int(k * BOOST_SHARE))
    touched = known(events, config).groupBy("user_id", "item_id").agg(F.max("t").alias("t"))
    per_user = touched.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_touched"))
    newest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("t"), "item_id"))
    boost = touched.withColumn("place", newest).where(F.col("place") <= slots).join(per_user, "user_id")
    boost = boost.select("user_id", "item_id", (F.col("n_touched") - F.col("place") + 1).cast("double").alias("score"), F.lit("incremental").alias("source"), F.lit(0).alias("tier"), "place")
    order = (F.asc_nulls_last("rank"), F.desc_nulls_last("score"), F.asc("item_id"), F.asc_nulls_last("source"))
    old = nan_to_null(prior).withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)))
    keep = nan_to_null(prior).where(is_preserved()).join(users, "user_id", "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)))
    room = F.lit(k) - F.when(F.col("n_touched").isNotNull(), F.lit(slots)).otherwise(F.lit(0))
    keep = keep.where(F.col("place") <= k).join(per_user, "user_id", "left").where(F.col("place") <= room)
    keep = keep.select("user_id", "item_id", "score", "source", F.lit(1).alias("tier"), "place")

    def spread(ranking: DataFrame, to: DataFrame, source: str, tier: int) -> DataFrame:
        packed = ranking.agg(F.collect_list(F.struct("item_id", "score", "place")))  # k rows
        return to.select("user_id", F.inline(packed.scalar())).select("user_id", "item_id", "score", F.lit(source).alias("source"), F.lit(tier).alias("tier"), "place")

    cold = events.sparkSession.createDataFrame([(COLD_START_USER,)], "user_id string").join(events.limit(1).select(F.lit(COLD_START_USER).alias("user_id")), "user_id", "left_semi")
    fill = users.where(F.col("user_id") != COLD_START_USER).unionByName(cold)
    prior_cold = old.where(F.col("user_id") == COLD_START_USER).join(cold, "user_id", "left_semi").select("user_id", "item_id", "score", "source", F.lit(4).alias("tier"), "place")
    personal = boost.unionByName(keep).where(F.col("user_id") != COLD_START_USER)
    rows = personal.unionByName(spread(pop, fill, "popular_fallback", 2)).unionByName(spread(new, fill, "latest", 3)).unionByName(prior_cold)
    first = F.row_number().over(Window.partitionBy("user_id", "item_id").orderBy("tier", "place"))
    once = rows.withColumn("_n", first).where("_n = 1")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("tier", "place", "item_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select(*_ROWS)


class MicroBatches:
    """foreachBatch target that merges batches into a Store; a batch number is applied once, replays are passed over.

    The number of the last batch is part of the table's version, so that it counts as applied exactly when its rows do. A batch
    reads and writes the buckets of its users only.
    busy and fenced are asked before the work and before the write: a busy store raises, so that the batch comes again. A batch
    that failed give_up times, in whatever run, is passed over: its number is put on record with the error, and the stream
    goes on behind it. None never gives up.
    """

    def __init__(
        self, store, config: FeatureConfig | None, k: int = 10, *, busy: Callable[[], bool] = lambda: False, fenced: Callable[[], bool] = lambda: False,
        give_up: int | None = None, metrics=None,
    ) -> None:
        self.store, self.config, self.k, self.busy, self.fenced, self.give_up, self.metrics = store, config, k, busy, fenced, give_up, metrics
        self.outcomes: list[dict] = []

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        done = self.store.last_batch()
        if done is not None and done >= batch_id:
            return
        if self.busy():
            raise RuntimeError("the store is being rebuilt")
        try:
            self._report(self._apply(batch, batch_id))
        except Exception as e:
            if self.give_up is None or self.fenced() or self.store.failed(batch_id, str(e)) < self.give_up:
                raise
            self._report({"generated_at": datetime.now(UTC).isoformat(), "mode": "incremental", "batch_id": batch_id, "status": "skipped", "error": f"{type(e).__name__}: {e}"[:500], "n_events": 0, "n_rejected": 0})

    def _report(self, report: dict) -> None:
        self.store.write_manifest(report)
        self.outcomes.append(report)
        if self.metrics is not None:
            self.metrics.count(f"batches_{report['status']}")
            self.metrics.count("events_applied", report["n_events"])
            self.metrics.count("events_rejected", report["n_rejected"])

    def _apply(self, batch: DataFrame, batch_id: int) -> dict:
        events, rejected = normalise(batch)
        events = dedupe_batch(events).persist()
        try:
            n = events.count()
            report = {"generated_at": datetime.now(UTC).isoformat(), "mode": "incremental", "batch_id": batch_id, "status": "ok", "n_events": n, "n_rejected": rejected.count()}
            if n:
                users = events.select("user_id").distinct().unionByName(self.store.spark.createDataFrame([(COLD_START_USER,)], "user_id string")).distinct()
                rows = materialize(merge_batch(self.store.read_recommendations(users), events, self.config, self.k), "merged")
                if self.fenced():
                    raise RuntimeError("another writer took over")
                report["n_users"] = self.store.replace_for_users(rows.select("user_id"), rows, batch=batch_id)
            return report
        finally:
            events.unpersist()


def start(source: DataFrame, apply: MicroBatches, checkpoint: str, *, seconds: int | None = 60, within: str | None = None) -> StreamingQuery:
    """Runs a stream of raw events into apply. seconds None works off what is there and stops.

    within, such as '1 hour', also drops an event_id that was seen in an earlier batch so recently; such rows need an
    event_id and a timestamp in occurred_at.
    """
    if within:
        source = source.withWatermark("occurred_at", within).dropDuplicatesWithinWatermark(["event_id"])
    writer = source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def drain(query: StreamingQuery) -> None:
    """Works off what has arrived and stops; an error of the stream comes out, and it is stopped all the same."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def health(query: StreamingQuery) -> dict:
    """Whether the stream runs, what it waits for, and how far it is behind."""
    last = query.lastProgress
    return {"active": query.isActive, "message": query.status["message"], "batch_id": last["batchId"] if last else None, "input_rows": last["numInputRows"] if last else 0}
