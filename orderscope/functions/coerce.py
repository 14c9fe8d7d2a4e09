"""Null-safe coercion expressions (all JVM-side, no Python UDFs).

Spark 4 runs with ANSI mode on: a plain ``cast`` throws on a bad cell, so
every coercion here is the ``try_`` form. Spark also treats a float NaN as a
value (it sorts highest and poisons ``sum``/``avg``); the pandas model treats
it as missing, so NaN is turned into NULL once, at ingest.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed pattern: text accepted as a number (what a decimal-point float parser
# takes: optional sign, digits with optional fraction and exponent, inf, nan;
# surrounding blanks allowed). Anything else ("1,5", "1d", "abc", "") is NULL.
# The guard matters because Spark's own cast accepts Java suffixes like "1d".
NUMERIC_TEXT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"


def nan_to_null(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def to_double(c: Column, source_type: T.DataType | None = None) -> Column:
    """Numeric coercion: numbers pass, parseable text is parsed, the rest is
    NULL; NaN becomes NULL. Infinities are kept (they are real values)."""
    if isinstance(source_type, (T.NumericType, T.BooleanType)):
        return nan_to_null(c.cast("double"))
    text = F.trim(c.cast("string"))
    parsed = F.when(text.rlike(NUMERIC_TEXT), text.try_cast("double"))
    return nan_to_null(parsed)


def to_decimal(c: Column, source_type: T.DataType | None, target: T.DecimalType) -> Column:
    """Exact numeric coercion: as ``to_double``, but text and exact numbers go
    straight to the decimal type (half a unit rounds up); infinities, NaN and
    values too large are NULL."""
    if isinstance(source_type, (T.NumericType, T.BooleanType)):
        return c.try_cast(target)
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(NUMERIC_TEXT), text.try_cast(target))


def to_timestamp_ntz(c: Column, source_type: T.DataType | None = None, fmt: str | None = None) -> Column:
    """Datetime coercion to ``timestamp_ntz`` (wall-clock, no session zone
    shift, so a bucket label never moves across midnight). Each row is parsed
    on its own; unparseable text is NULL. ``fmt`` forces one pattern."""
    if isinstance(source_type, T.TimestampNTZType):
        return c
    if isinstance(source_type, (T.TimestampType, T.DateType)):
        return c.cast("timestamp_ntz")
    text = F.trim(c.cast("string"))
    if fmt:
        return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")
    return text.try_cast("timestamp_ntz")
