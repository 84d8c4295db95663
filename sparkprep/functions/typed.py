"""Tolerant casts: bad input becomes null, never an error (ANSI mode stays on)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.functions.text import name_sql

# --- fixed values: accepted non-ISO date formats, with the shape each one is tried on ---
DATE_FORMATS = {
    r"^\d{1,2}/\d{1,2}/\d{4}$": "M/d/yyyy",
    r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$": "M/d/yyyy H:mm:ss",
    r"^\d{8}$": "yyyyMMdd",
    r"^\d{1,2}-[A-Za-z]{3}-\d{4}$": "d-MMM-yyyy",
    r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$": "MMM d, yyyy",
}
_ISO = r"^\s*\d{4}-\d{1,2}-\d{1,2}"


def double_sql(e: str) -> str:
    """Number or null. The text `NaN` is null too: Spark sorts NaN above every number."""
    return f"nanvl(try_cast({e} AS DOUBLE), CAST(NULL AS DOUBLE))"


def timestamp_sql(e: str, kind: T.DataType) -> str:
    """Timestamp or null. Text is read as ISO, else by the formats above, each row for itself."""
    if not isinstance(kind, T.StringType):
        is_time = isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))
        return f"CAST({e if is_time else 'NULL'} AS TIMESTAMP)"
    others = " ".join(
        f"WHEN {e} RLIKE r'{shape}' THEN try_to_timestamp({e}, '{fmt}')" for shape, fmt in DATE_FORMATS.items()
    )
    return f"CASE WHEN {e} RLIKE r'{_ISO}' THEN try_cast({e} AS TIMESTAMP) {others} END"


def to_double(column: str) -> Column:
    return F.expr(double_sql(name_sql(column)))


def to_timestamp(column: str, kind: T.DataType) -> Column:
    return F.expr(timestamp_sql(name_sql(column), kind))


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def one_zero(c: Column, kind: T.DataType) -> Column:
    """Negative zero as zero: SQL holds the two equal, their texts differ."""
    return c + F.lit(0.0).cast(kind) if isinstance(kind, (T.DoubleType, T.FloatType)) else c


def mark_of(df: DataFrame, watermark: str) -> Column:
    """A watermark in its own order: text is read as a time, else as a number, never compared as text."""
    kind = df.schema[watermark].dataType
    if not isinstance(kind, T.StringType):
        return F.col(name_sql(watermark))
    return F.coalesce(F.unix_micros(to_timestamp(watermark, kind)).cast("double"), to_double(watermark))
