"""Column helpers for ids: stripping and blank handling, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space for Unicode-aware stripping.
WHITESPACE = "".join(
    map(
        chr,
        [
            0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680,
            0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A,
            0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
        ],
    )
)


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """The text without surrounding Unicode white space; null stays null, blank becomes empty."""
    return F.trim(_column(value), F.lit(WHITESPACE))


def strip_to_null(value: Column | str) -> Column:
    """As strip, but an empty result is null."""
    return F.nullif(strip(value), F.lit(""))


def duckdb_whitespace() -> str:
    """The same characters as a DuckDB string expression, for oracle SQL."""
    return "||".join(f"chr({ord(c)})" for c in WHITESPACE)


def duckdb_strip(column: str) -> str:
    return f"trim({column}, {duckdb_whitespace()})"
