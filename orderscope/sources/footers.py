"""Counts and bounds of a Parquet table from its file footers.

Parquet footers hold row counts, null counts and, per column, least and greatest
values. With aggregate push-down into Spark's V2 Parquet scan the aggregate is
answered from them and no row group is read. What footers can't tell exactly
comes from a normal scan of those columns alone: counts of nested columns;
bounds of texts (cut off in footers), timestamps and floating-point numbers
(NaN is left out there). If some file lacks the bounds of a column, as it does
when all its cells are NULL, the scan reports an error and bounds are scanned too,
and if it lacks null counts, the whole table is. All ways give the same rows.

The session's own settings stay as they are: the reads run in a sibling session.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COUNTED = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)
BOUNDED = (T.IntegralType, T.DateType)
ORDERED = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _session(spark: SparkSession, push: bool) -> SparkSession:
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    if push:
        listed = spark.conf.get("spark.sql.sources.useV1SourceList").split(",")
        own.conf.set("spark.sql.sources.useV1SourceList", ",".join(s for s in listed if s.strip() != "parquet"))
        own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own


def footer_aggregate(spark: SparkSession, path: str, bounds: bool = True) -> tuple[DataFrame, DataFrame]:
    """(pushed, scanned): one row each, of the aggregates that footers answer
    (without ``bounds``, counts alone) and of those that need the data."""
    pushed = _session(spark, True).read.parquet(path)
    plain = _session(spark, False).read.parquet(path)
    from_footers, from_data = [F.count(F.lit(1)).alias("rows")], [F.lit(0).alias("none")]
    for i, f in enumerate(plain.schema.fields):
        c = F.col(f"`{f.name}`")
        (from_footers if isinstance(f.dataType, COUNTED) else from_data).append(F.count(c).alias(f"n{i}"))
        if isinstance(f.dataType, ORDERED):
            to = from_footers if bounds and isinstance(f.dataType, BOUNDED) else from_data
            to += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
    # An aggregate is pushed as a whole or not at all, hence two.
    return pushed.agg(*from_footers), plain.agg(*from_data)


def table_summary(spark: SparkSession, path: str) -> DataFrame:
    """column, dtype, non_null, rows, least, greatest (as text, NULL for types
    without an order) of the Parquet table at ``path``."""
    schema = _session(spark, False).read.parquet(path).schema
    values = None
    for bounds in (True, False):
        pushed, scanned = footer_aggregate(spark, path, bounds)
        try:
            values = pushed.first().asDict()
            break
        except (PySparkException, Py4JJavaError):
            continue  # some file lacks a statistic, as it does for bounds of a column of nulls
    if values is None:
        values = _session(spark, False).read.parquet(path).agg(*_same(pushed, schema)).first().asDict()
    if len(scanned.columns) > 1:
        values |= scanned.first().asDict()
    # Pushed counts are sums over files: NULL without a file.
    values = {k: 0 if v is None and not k.startswith(("lo", "hi")) else v for k, v in values.items()}
    rows = [
        (f.name, f.dataType.simpleString(), values[f"n{i}"], values["rows"], _text(values.get(f"lo{i}")), _text(values.get(f"hi{i}")))
        for i, f in enumerate(schema.fields)
    ]  # one row per column
    return spark.createDataFrame(rows, "column string, dtype string, non_null bigint, rows bigint, least string, greatest string")


def _same(pushed: DataFrame, schema: T.StructType) -> list[Column]:
    """The aggregates of ``pushed`` for a normal scan."""
    made = [F.count(F.lit(1)).alias("rows")]
    for name in pushed.columns[1:]:
        kind, i = name.rstrip("0123456789"), int(name.lstrip("nlohi"))
        c = F.col(f"`{schema.fields[i].name}`")
        made.append({"n": F.count, "lo": F.min, "hi": F.max}[kind](c).alias(name))
    return made


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return str(value).lower()
    return str(value)
