"""Fixed schemas of events and recommendations, id aliases, and frames made ready at the edge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLD_START_USER = "__cold_start__"

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("item_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("occurred_at", T.TimestampType()),
    ]
)
RECOMMENDATIONS = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("item_id", T.StringType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("source", T.StringType()),
    ]
)
ID_ALIASES = {"user_id": ("user_id", "user", "uid", "external_user_id"), "item_id": ("item_id", "item", "iid", "external_item_id")}


def resolve_id(df: DataFrame, name: str) -> str:
    """The column that holds the id: its own name or an alias; a missing one raises."""
    for alias in ID_ALIASES.get(name, (name,)):
        if alias in df.columns:
            return alias
    raise ValueError(f"no column {name} among {', '.join(df.columns)}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column, so that orders and sums treat it as missing."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floating}) if floating else df


def newest_rows(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """One row per non-null key: the first in the given order. A rank filter, which Spark limits before the shuffle."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.where(F.col(key).isNotNull()).withColumn("_place", place).where("_place = 1").drop("_place")


def empty(df_like: DataFrame, schema: str | T.StructType) -> DataFrame:
    return df_like.sparkSession.createDataFrame([], schema)
