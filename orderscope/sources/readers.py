"""Readers for the raw order table, ending in the canonical fact.

Parquet is the default (columnar, predicate pushdown). CSV is read with
every column as text and no schema inference (inference is an extra full
pass and guesses per file); ``canonicalise`` then parses each role with the
null-safe coercions. JSON takes an optional schema for the same reason.
A catalogue table is read by name. There is no spreadsheet reader: convert
workbooks to CSV/Parquet upstream.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderscope.sources.columns import canonicalise, role_expressions

FORMATS = ("parquet", "csv", "json", "table")


def read_raw(
    spark: SparkSession,
    source: str,
    fmt: str = "parquet",
    schema: str | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """The table as stored (header names as found)."""
    opts = dict(options or {})
    if fmt == "parquet":
        return spark.read.options(**opts).parquet(source)
    if fmt == "csv":
        reader = spark.read.option("header", "true").option("inferSchema", "false").options(**opts)
        return (reader.schema(schema) if schema else reader).csv(source)
    if fmt == "json":
        reader = spark.read.options(**opts)
        return (reader.schema(schema) if schema else reader).json(source)
    if fmt == "table":
        return spark.table(source)
    raise ValueError(f"format must be one of {FORMATS}")


def read_orders(
    spark: SparkSession,
    source: str,
    fmt: str = "parquet",
    overrides: Mapping[str, str] | None = None,
    datetime_format: str | None = None,
    schema: str | None = None,
    options: Mapping[str, str] | None = None,
    extra: Sequence[str] = (),
    money: T.DecimalType | None = None,
) -> DataFrame:
    """Raw order table → canonical fact (aliases resolved, types coerced)."""
    return canonicalise(read_raw(spark, source, fmt, schema, options), overrides, datetime_format, extra, money)


def coercion_report(
    raw: DataFrame,
    overrides: Mapping[str, str] | None = None,
    datetime_format: str | None = None,
) -> DataFrame:
    """role, column, present, coerced_to_null: for every resolved role, how
    many raw cells were non-null and how many of those the coercion turned
    into NULL (unparseable numbers, NaN, bad dates). One aggregate pass over
    the raw table (partial aggregation); its single row is unpivoted to one
    row per role."""
    roles = role_expressions(raw, overrides, datetime_format)
    aggs = []
    for i, (phys, expr) in enumerate(roles.values()):
        present = F.col(f"`{phys}`").isNotNull()
        aggs += [F.count_if(present).alias(f"p{i}"), F.count_if(present & expr.isNull()).alias(f"n{i}")]
    row = raw.agg(*aggs)
    names = list(roles)
    stacked = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(role).alias("role"),
                    F.lit(roles[role][0]).alias("column"),
                    F.col(f"p{i}").alias("present"),
                    F.col(f"n{i}").alias("coerced_to_null"),
                )
                for i, role in enumerate(names)
            ]
        )
    )
    return row.select(stacked.alias("r")).select("r.*")
