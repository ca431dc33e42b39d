"""Queries p2, p3 and p5 with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellarflow.functions.strings import duckdb_strip
from cellarflow.operators.exactly_once import ExactlyOnce
from cellarflow.operators.sessions import sessions
from cellarflow.operators.skew import heavy_keys, key_statistics
from cellarflow.runtime import fresh_path

BOTH_WAYS = [("item_id", "user_id"), ("user_id", "item_id")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(_read(spark, sf_dir, "shop_events")).select("user_id", "start_us", "end_us", "n_events")


def p2_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(_read(spark, sf_dir, "shop_events"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as four batches in order of arrival: what the bitmaps of the earlier ones, and each batch's own, hold back."""
    rows, intake = _read(spark, sf_dir, "stream_deliveries"), ExactlyOnce(spark, fresh_path(spark, "intake"))
    return intake.without(rows, intake.apply_past(rows)).select("delivery_id")


def p3_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream with exactly one delivery of each message."""
    rows, intake = _read(spark, sf_dir, "stream_deliveries"), ExactlyOnce(spark, fresh_path(spark, "intake"))
    return intake.only(rows, intake.apply_past(rows)).select("delivery_id", "event_id", "idempotency_key", "batch_no", "transport")


def p3_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies when batches are applied by their number: the first batch with a message lets it through, whatever its
    time. Ranges of numbers are applied one after the other, and within a range the number comes first in the order."""
    rows, intake = _read(spark, sf_dir, "stream_deliveries"), ExactlyOnce(spark, fresh_path(spark, "intake"), order=("batch_no", "received_at"))
    return intake.without(rows, intake.apply_past(rows, 6)).select("delivery_id", "batch_no")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys(_read(spark, sf_dir, "shop_events"), BOTH_WAYS, time="occurred_at").select("field", "key_value")


def p5_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_statistics(_read(spark, sf_dir, "shop_events"), BOTH_WAYS, time="occurred_at")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p2_sessions, p3_found, p3_stream, p3_batches, p5_found, p5_keys)
}

_U, _I = duckdb_strip("user_id"), duckdb_strip("item_id")
_SESSIONS = f"""
WITH once AS (
  SELECT event_id, any_value({_U}) AS u, any_value(epoch_us(occurred_at)) AS t FROM shop_events
  WHERE user_id IS NOT NULL AND occurred_at IS NOT NULL GROUP BY event_id),
flagged AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY u ORDER BY t) <= 1800000000 THEN 0 ELSE 1 END AS opens FROM once),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY u ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS no FROM flagged),
visits AS (SELECT u AS user_id, CAST(no AS BIGINT) AS session_no, min(t) AS start_us, max(t) AS end_us, count(*) AS n_events FROM numbered GROUP BY u, no)
"""
_IDENT = f"coalesce(nullif({duckdb_strip('event_id')}, ''), nullif({duckdb_strip('idempotency_key')}, ''))"
_PLACED = f"""
WITH placed AS (
  SELECT *, {_IDENT} AS ident, row_number() OVER (PARTITION BY {_IDENT} ORDER BY received_at NULLS LAST, delivery_id) AS place,
         row_number() OVER (PARTITION BY {_IDENT} ORDER BY batch_no NULLS LAST, received_at NULLS LAST, delivery_id) AS by_batch FROM stream_deliveries)
"""
_KEYS = f"""
WITH keys AS (
  SELECT 'item_id' AS field, {_I} AS key_value, count(*) AS n_rows, count(DISTINCT {_U}) AS n_partners, min(epoch_us(occurred_at)) AS first_us, max(epoch_us(occurred_at)) AS last_us
  FROM shop_events WHERE item_id IS NOT NULL GROUP BY 2
  UNION ALL
  SELECT 'user_id', {_U}, count(*), count(DISTINCT {_I}), min(epoch_us(occurred_at)), max(epoch_us(occurred_at))
  FROM shop_events WHERE user_id IS NOT NULL GROUP BY 2)
"""
SQL: dict[str, str] = {
    "p2_found": _SESSIONS + "SELECT user_id, start_us, end_us, n_events FROM visits",
    "p2_sessions": _SESSIONS + "SELECT user_id, session_no, start_us, end_us, end_us - start_us AS duration_us, n_events FROM visits",
    "p3_found": _PLACED + "SELECT delivery_id FROM placed WHERE ident IS NOT NULL AND place > 1",
    "p3_stream": _PLACED + "SELECT delivery_id, event_id, idempotency_key, batch_no, transport FROM placed WHERE ident IS NULL OR place = 1",
    "p3_batches": _PLACED + "SELECT delivery_id, batch_no FROM placed WHERE ident IS NOT NULL AND by_batch > 1",
    "p5_found": _KEYS + "SELECT field, key_value FROM keys WHERE n_rows * 100 >= 2 * (SELECT count(*) FROM shop_events)",
    "p5_keys": _KEYS + "SELECT * FROM keys",
}
