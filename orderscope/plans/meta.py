"""Value lists and date range for the filter widgets (no filters applied)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderscope.functions.expressions import datetime_text
from orderscope.sources.columns import require


def _distinct_text(fact: DataFrame, role: str) -> DataFrame:
    require(fact, role)
    return (
        fact.select(F.col(role).cast("string").alias(role))
        .where(F.col(role).isNotNull())
        .distinct()
        .orderBy(role)
    )


def platforms(fact: DataFrame) -> DataFrame:
    """platform: distinct platforms as sorted text."""
    return _distinct_text(fact, "platform")


def macros(fact: DataFrame) -> DataFrame:
    """macro_bairro: distinct areas as sorted text."""
    return _distinct_text(fact, "macro_bairro")


def date_range(fact: DataFrame) -> DataFrame:
    """periodo_min, periodo_max as text (NULL when there is no date)."""
    require(fact, "order_datetime")
    return fact.agg(
        datetime_text(F.min("order_datetime")).alias("periodo_min"),
        datetime_text(F.max("order_datetime")).alias("periodo_max"),
    )
