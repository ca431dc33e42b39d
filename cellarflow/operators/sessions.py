"""Grouping activity into sessions: each user's events split at pauses longer than a gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarflow.functions.strings import strip
from cellarflow.functions.times import micros

GAP_SECONDS = 1800


def sessions(
    events: DataFrame,
    *,
    gap_seconds: int = GAP_SECONDS,
    user: str = "user_id",
    time: str = "occurred_at",
    event_id: str = "event_id",
) -> DataFrame:
    """One row per session: user_id, session_no (from 1), start_us, end_us, duration_us, n_events.

    A session is a longest run of a user's events in which none comes more than gap_seconds after the one before.
    Events are told apart by event_id; copies count once (at their earliest time where they disagree, and once for
    each user where they disagree on the user). A null event_id makes a row an event of its own.
    Users are stripped; rows with a null user or time belong to no session. An empty user id is a user like any other.
    Other columns are ignored, whatever their names; empty input gives an empty result.

    Two events in one time slot as wide as the gap always share a session, so rows are first folded into
    (user, slot) states by a hash aggregation that combines before its shuffle. The lag window then runs over at most
    one state per user and slot: a user holding a third of all rows is bounded by the time span, not by the rows.
    """
    gap = int(gap_seconds * 1_000_000)
    if gap < 0:
        raise ValueError("gap_seconds must not be negative")
    rows = events.select(strip(user).alias("_u"), micros(events, time).alias("_t"), F.col(event_id).alias("_e")).where(
        "_u is not null and _t is not null"
    )
    alone: Column = F.when(F.col("_e").isNull(), F.col("_t"))
    once = (
        rows.groupBy("_u", "_e", alone.alias("_alone"))
        .agg(F.min("_t").alias("_t"), F.count(F.lit(1)).alias("_c"))
        .select("_u", "_t", F.when(F.col("_e").isNull(), F.col("_c")).otherwise(F.lit(1)).cast("bigint").alias("_n"))
    )
    width = max(gap, 1)
    slot = F.expr(f"_t div {width} - if(_t % {width} < 0, 1, 0)")
    slots = once.groupBy("_u", slot.alias("_slot")).agg(
        F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.sum("_n").alias("_n")
    )
    by_user = Window.partitionBy("_u").orderBy("_slot")
    opens = F.coalesce(F.col("_first") - F.lag("_last").over(by_user) > F.lit(gap), F.lit(True))
    numbered = slots.withColumn("_opens", opens.cast("bigint")).withColumn("_no", F.sum("_opens").over(by_user))
    return numbered.groupBy("_u", "_no").agg(
        F.min("_first").alias("start_us"), F.max("_last").alias("end_us"), F.sum("_n").alias("n_events")
    ).select(
        F.col("_u").alias("user_id"),
        F.col("_no").alias("session_no"),
        "start_us",
        "end_us",
        (F.col("end_us") - F.col("start_us")).alias("duration_us"),
        "n_events",
    )
