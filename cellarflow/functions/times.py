"""Time columns as microseconds, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970-01-01 UTC of a timestamp or timestamp_ntz column (read as UTC); null stays null."""
    kind = df.schema[name].dataType.typeName()
    if kind == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{name}`)")
    if kind == "date":
        return F.unix_date(F.col(name)).cast("bigint") * F.lit(DAY_US)
    return F.unix_micros(F.col(name))
