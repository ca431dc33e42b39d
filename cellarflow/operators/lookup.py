"""Reading recommendations back: top rows of users, cold-start fallback, catalogue filters, status."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarflow.functions.strings import strip
from cellarflow.functions.values import item_true
from cellarflow.schemas import COLD_START_USER, newest_rows, resolve_id

#: Sources that a row for strangers may have, best first.
FALLBACK_SOURCES = ("popular_fallback", "latest")
OVERFETCH = 5


def _by_rank(rows: DataFrame, k: int, name: str = "rank") -> DataFrame:
    order = (F.asc_nulls_last("rank"), F.desc_nulls_last("score"), F.asc("item_id"), F.asc_nulls_last("source"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= k).withColumn(name, F.col("_place")).drop("_place")


def lookup(recommendations: DataFrame, users: DataFrame, k: int) -> DataFrame:
    """The first k rows by rank (nulls last, then score, item, source) of each user in users."""
    return _by_rank(recommendations.join(users.select("user_id").distinct(), "user_id", "left_semi"), k, "place")


def fallback_rows(recommendations: DataFrame, k: int) -> DataFrame:
    """What a stranger gets: the cold-start user's rows, else the popular or latest rows of one donor.

    The donor is the user with a row of the best fallback source, then the smallest id; only rows of fallback sources
    are lent.
    """
    cold = recommendations.where(F.col("user_id") == COLD_START_USER)
    priority: Column = F.lit(None).cast("int")
    for i, s in reversed(list(enumerate(FALLBACK_SOURCES))):
        priority = F.when(F.col("source") == s, F.lit(i)).otherwise(priority)
    lent = recommendations.where(F.col("source").isin(*FALLBACK_SOURCES) & (F.col("user_id") != COLD_START_USER)).withColumn("_p", priority)
    donor = lent.groupBy("user_id").agg(F.min("_p").alias("_p")).orderBy("_p", "user_id").limit(1)
    none_cold = cold.limit(1).groupBy().agg((F.count(F.lit(1)) == 0).alias("none"))
    rows = lent.drop("_p").join(F.broadcast(donor.select("user_id")), "user_id", "left_semi").where(none_cold.scalar())  # one row
    return _by_rank(cold.unionByName(rows), k, "place")


def lookup_or_fallback(recommendations: DataFrame, users: DataFrame, k: int) -> DataFrame:
    """lookup, with the fallback rows (is_fallback true) for users without any row of their own."""
    wanted = users.select("user_id").distinct()
    own = lookup(recommendations, wanted, k).withColumn("is_fallback", F.lit(False))
    missing = wanted.join(recommendations.select("user_id").distinct(), "user_id", "left_anti")
    lent = fallback_rows(recommendations, k).agg(F.sort_array(F.collect_list(F.struct("place", "item_id", "score", "source"))).alias("r"))  # k rows
    strangers = missing.select("user_id", F.inline(lent.scalar())).withColumn("is_fallback", F.lit(True))
    columns = ["user_id", "item_id", "place", "score", "source", "is_fallback"]
    return own.select(*columns).unionByName(strangers.select(*columns))


def item_snapshot(items: DataFrame, availability: Sequence[str], *, newest: Sequence[Column] = ()) -> DataFrame:
    """item_id, category and is_available (all flag columns true; a missing column is passed over); one row per item."""
    key = resolve_id(items, "item_id")
    one = newest_rows(items, key, newest) if newest else items.where(F.col(key).isNotNull()).dropDuplicates([key])
    flag = F.lit(True)
    for c in availability:
        if c in items.columns:
            flag = flag & item_true(items, c)
    category = F.col("category").cast("string") if "category" in items.columns else F.lit(None).cast("string")
    return one.select(F.col(key).cast("string").alias("item_id"), category.alias("category"), flag.alias("is_available"))


def filter_rows(rows: DataFrame, snapshot: DataFrame, k: int, *, category: str | None = None, available: bool = False) -> DataFrame:
    """Rows whose item is of the category and available; items absent from the snapshot go. Places run from 1 again."""
    allowed = snapshot
    if category is not None:
        allowed = allowed.where(strip("category") == F.lit(category.strip()))
    if available:
        allowed = allowed.where("is_available")
    kept = rows.join(allowed.select("item_id"), "item_id", "left_semi") if category is not None or available else rows
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("place"))
    return kept.withColumn("_new", place).where(F.col("_new") <= k).withColumn("place", F.col("_new")).drop("_new")


def with_category(rows: DataFrame, snapshot: DataFrame) -> DataFrame:
    return rows.join(snapshot.select("item_id", "category"), "item_id", "left")


def cell(column: str) -> Column:
    """A number as a table shows it: four decimals, empty for null."""
    return F.when(F.col(column).isNull(), F.lit("")).otherwise(F.format_string("%.4f", F.round(column, 4)))


def request_size(limit: int | None, k: int | None, default: int, most: int = 100) -> int:
    """The number of rows asked for; two different numbers, or one outside 1..most, raise."""
    if limit is not None and k is not None and limit != k:
        raise ValueError("limit and k differ")
    n = limit if limit is not None else k if k is not None else default
    if not 1 <= n <= most:
        raise ValueError(f"between 1 and {most} rows can be asked for")
    return n


def serve(recommendations: DataFrame, snapshot: DataFrame, users: DataFrame, k: int, *, category: str | None = None, available: bool = True) -> DataFrame:
    """The whole read path: OVERFETCH times k rows, or the fallback, filtered and cut to k."""
    filtered = category is not None or available
    rows = lookup_or_fallback(recommendations, users, k * OVERFETCH if filtered else k)
    return filter_rows(rows, snapshot, k, category=category, available=available)


def next_run(cron: str, after: datetime) -> datetime:
    """The first minute after a time that fits five cron fields (*, n, a-b, */n and lists)."""

    def fits(field: str, value: int, low: int, high: int) -> bool:
        for part in field.split(","):
            span, _, step = part.partition("/")
            a, b = (low, high) if span == "*" else (int(span), int(span)) if "-" not in span else map(int, span.split("-"))
            if step and "-" not in span and span != "*":
                b = high
            if a <= value <= b and (value - a) % int(step or 1) == 0:
                return True
        return False

    minute, hour, day, month, weekday = cron.split()
    at = after.replace(second=0, microsecond=0) + timedelta(minutes=1)
    for _ in range(366 * 24 * 60 * 4):
        dow = (at.weekday() + 1) % 7
        if not fits(month, at.month, 1, 12):
            at = (at.replace(day=1, hour=0, minute=0) + timedelta(days=32)).replace(day=1)
            continue
        on_day, on_dow = fits(day, at.day, 1, 31), fits(weekday, dow, 0, 7) or dow == 0 and fits(weekday, 7, 0, 7)
        if not (on_day and on_dow if "*" in (day, weekday) else on_day or on_dow):
            at = at.replace(hour=0, minute=0) + timedelta(days=1)
            continue
        if fits(hour, at.hour, 0, 23) and fits(minute, at.minute, 0, 59):
            return at
        at += timedelta(minutes=1)
    raise ValueError(f"{cron!r} never comes")


def is_stale(last_run: datetime, cron: str, now: datetime | None = None) -> bool:
    """Whether the run after last_run is overdue; times without a zone are UTC."""
    aware = lambda t: t if t.tzinfo else t.replace(tzinfo=UTC)
    return aware(now or datetime.now(UTC)) > next_run(cron, aware(last_run))
