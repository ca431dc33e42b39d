"""From events to weighted interactions, features and the sets of users and items that they imply."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarflow.config import FeatureColumn, FeatureConfig
from cellarflow.functions.strings import strip
from cellarflow.functions.times import DAY_US, micros
from cellarflow.functions.values import as_list
from cellarflow.schemas import empty, resolve_id

FEATURES = "id string, feature string, value string"


def clean_events(events: DataFrame) -> DataFrame:
    """user_id, item_id (stripped), event_type, quantity (at least 1), t (microseconds), event_id; rows with a null id or
    time are left out, a missing or null quantity is 1. Other columns are dropped."""
    quantity = F.col("quantity").cast("double") if "quantity" in events.columns else F.lit(None).cast("double")
    event_id = F.col("event_id").cast("string") if "event_id" in events.columns else F.lit(None).cast("string")
    return events.select(
        strip(F.col(resolve_id(events, "user_id")).cast("string")).alias("user_id"),
        strip(F.col(resolve_id(events, "item_id")).cast("string")).alias("item_id"),
        F.col("event_type").cast("string").alias("event_type"),
        F.greatest(F.coalesce(quantity, F.lit(1.0)), F.lit(1.0)).alias("quantity"),
        micros(events, "occurred_at").alias("t"),
        event_id.alias("event_id"),
    ).where("user_id is not null and item_id is not null and t is not null")


def base_weight(config: FeatureConfig, column: str = "event_type") -> Column:
    """The weight of an event type; null for an unknown one."""
    case: Column | None = None
    for name, w in config.event_weights.items():
        hit = F.col(column) == F.lit(name)
        case = F.when(hit, F.lit(float(w))) if case is None else case.when(hit, F.lit(float(w)))
    return F.lit(None).cast("double") if case is None else case


def quantity_factor(config: FeatureConfig) -> Column:
    """log1p(quantity) for types whose weight scales with quantity, else 1."""
    if not config.quantity_scaled:
        return F.lit(1.0)
    return F.when(F.col("event_type").isin(*config.quantity_scaled), F.log1p(F.col("quantity"))).otherwise(F.lit(1.0))


def decay(t: Column, as_of_us: int, half_life_days: float) -> Column:
    """0.5 to the power of age / half-life; events after as_of are not older than new."""
    age = F.greatest(F.lit(as_of_us) - t, F.lit(0)).cast("double") / F.lit(float(DAY_US))
    return F.pow(F.lit(0.5), age / F.lit(float(half_life_days)))


def cap_events(events: DataFrame, config: FeatureConfig) -> DataFrame:
    """Of each (user, item, type) only the newest so many events of a capped type; ties by event_id, then quantity."""
    if not config.event_caps:
        return events
    capped = F.col("event_type").isin(*config.event_caps)
    newest = Window.partitionBy("user_id", "item_id", "event_type").orderBy(F.desc("t"), "event_id", F.desc("quantity"))
    parts = [events.where(~F.coalesce(capped, F.lit(False)))]
    for limit in sorted(set(config.event_caps.values())):  # one rank filter per limit, which Spark applies before the shuffle
        types = [k for k, v in config.event_caps.items() if v == limit]
        ranked = events.where(F.col("event_type").isin(*types)).withColumn("_place", F.row_number().over(newest))
        parts.append(ranked.where(F.col("_place") <= limit).drop("_place"))
    return reduce(DataFrame.unionByName, parts)


def weigh_events(events: DataFrame, config: FeatureConfig, as_of_us: int, half_life_days: float) -> DataFrame:
    """Cleaned events of known types, capped, with their weight."""
    known = events.where(base_weight(config).isNotNull())
    return cap_events(known, config).withColumn(
        "weight", base_weight(config) * quantity_factor(config) * decay(F.col("t"), as_of_us, half_life_days)
    )


def build_interactions(events: DataFrame, config: FeatureConfig, as_of_us: int, half_life_days: float = 90.0) -> DataFrame:
    """One row per (user, item) of positive total weight: user_id, item_id, weight, last_us.

    Weights are summed after caps and decay as of as_of_us; last_us is the newest event. Events of unknown type, null ids or
    null times have no part. Repeated events count each, as they come. Empty events give an empty result.
    """
    weighed = weigh_events(clean_events(events), config, as_of_us, half_life_days)
    return weighed.groupBy("user_id", "item_id").agg(F.sum("weight").alias("weight"), F.max("t").alias("last_us")).where("weight > 0")


def _named(name: str) -> Callable[[Column], Column]:
    return lambda v: F.struct(F.lit(name).alias("feature"), v.alias("value"))


def explode_features(df: DataFrame, id_column: str, features: Sequence[FeatureColumn]) -> DataFrame:
    """(id, feature, value), one row per value; list columns entry by entry, nulls and missing columns passed over."""
    key = F.col(resolve_id(df, id_column)).cast("string").alias("id")
    parts = []
    for f in features:
        if f.column not in df.columns:
            continue
        values = as_list(df, f.column) if f.type == "list" else F.array_compact(F.array(F.col(f.column).cast("string")))
        parts.append(F.transform(values, _named(f.column)))
    if not parts:
        return empty(df, FEATURES)
    return df.select(key, F.inline(F.concat(*parts)).alias("feature", "value"))


def target_users(events: DataFrame, users: DataFrame | None) -> DataFrame:
    """The different non-null user ids of cleaned events and of the users table."""
    ids = events.select("user_id")
    if users is not None:
        ids = ids.unionByName(users.select(F.col(resolve_id(users, "user_id")).cast("string").alias("user_id")))
    return ids.where("user_id is not null").distinct()


def known_users(interactions: DataFrame, user_features: DataFrame) -> DataFrame:
    """Users with an interaction or a feature value."""
    return interactions.select("user_id").unionByName(user_features.select(F.col("id").alias("user_id"))).distinct()


def catalog(interactions: DataFrame, item_features: DataFrame) -> DataFrame:
    """Items with an interaction or a feature value."""
    return interactions.select("item_id").unionByName(item_features.select(F.col("id").alias("item_id"))).distinct()


def warm_or_cold(targets: DataFrame, known: DataFrame) -> DataFrame:
    """user_id and whether the models know the user."""
    return targets.join(known.withColumn("is_warm", F.lit(True)), "user_id", "left").withColumn("is_warm", F.coalesce("is_warm", F.lit(False)))


def interaction_counts(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_items"))


def median_items_per_user(events: DataFrame) -> DataFrame:
    """One row: the median, over users of cleaned events, of their number of different items; null without users."""
    return events.groupBy("user_id").agg(F.countDistinct("item_id").alias("n")).agg(F.median("n").alias("median_items"))
