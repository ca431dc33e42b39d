"""Flags, lists and numbers that come in several spellings, as Column expressions chosen by the column's type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellarflow.functions.strings import strip

# The only texts that count as true.
TRUE_TOKENS = ("1", "true", "True", "TRUE", "yes", "Yes", "YES")


def item_true(df: DataFrame, name: str) -> Column:
    """Booleans as they are, numbers if not 0, texts if a true token when stripped; all else, and null, is false."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.BooleanType):
        found = c
    elif isinstance(kind, T.NumericType):
        found = (c != 0) & ~F.isnan(c.cast("double"))
    elif isinstance(kind, T.StringType):
        found = strip(c).isin(*TRUE_TOKENS)
    else:
        found = F.lit(False)
    return F.coalesce(found, F.lit(False))


def as_list(df: DataFrame, name: str) -> Column:
    """An array of text without nulls: of an array column its entries; of a text its JSON array, its parts between
    commas, or itself; of anything else its one value. Null gives an empty array."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.ArrayType):
        entries = F.transform(c, lambda x: x.cast("string"))
    elif isinstance(kind, T.StringType):
        text = strip(c)
        bare = F.regexp_replace(text, r"^\[|\]$", "")
        parts = F.filter(F.transform(F.split(bare, ","), lambda x: strip(x)), lambda x: x != "")
        entries = (
            F.when(text.startswith("[") & text.endswith("]"), F.coalesce(F.from_json(text, "array<string>"), parts))
            .when(text.contains(","), parts)
            .otherwise(F.array(c))
        )
    else:
        entries = F.array(c.cast("string"))
    return F.coalesce(F.filter(entries, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def as_number(df: DataFrame, name: str) -> Column:
    """A double; null where a text is no number or the number is NaN."""
    value = F.expr(f"try_cast(`{name}` as double)")
    return F.when(~F.isnan(value), value)


def as_time(df: DataFrame, name: str) -> Column:
    """A timestamp; null where a text cannot be read as one."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.try_to_timestamp(name)
    return F.col(name).cast("timestamp")
