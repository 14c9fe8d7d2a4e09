"""Overview dashboard datasets."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderscope.functions.expressions import check_java_regex, ci_regex, elapsed_whole_days, safe_div, text_key
from orderscope.operators.filters import FilterSpec, apply_filters
from orderscope.operators.histogram import equal_width_histogram, left_out
from orderscope.operators.ranking import by_keys, by_measure_desc, top_n
from orderscope.operators.timeseries import bucketed_series
from orderscope.sources.columns import has, require

VARIANT = "overview"


def _filtered(fact: DataFrame, spec: FilterSpec | None) -> DataFrame:
    return apply_filters(fact, spec, VARIANT)


def kpis(fact: DataFrame, spec: FilterSpec | None = None, cancel_match: str = "cancel") -> DataFrame:
    """One row: total_pedidos, receita_total, ticket_medio (mean of
    total/items per order), cancelados_pct, pedidos_por_dia (orders per
    elapsed day, at least one day), periodo_min, periodo_max."""
    df = _filtered(fact, spec)
    n = F.count(F.lit(1))
    aggs = [n.alias("total_pedidos")]
    aggs.append(
        F.coalesce(F.sum("total_brl"), F.lit(0.0)).alias("receita_total")
        if has(df, "total_brl") else F.lit(0.0).alias("receita_total")
    )
    aggs.append(
        F.avg(safe_div(F.col("total_brl"), F.col("num_itens"))).alias("ticket_medio")
        if has(df, "total_brl") and has(df, "num_itens") else F.lit(0.0).alias("ticket_medio")
    )
    if has(df, "status"):
        check_java_regex(df.sparkSession, cancel_match)
        aggs.append(F.count_if(text_key("status").rlike(ci_regex(cancel_match))).alias("_cancel"))
    else:
        aggs.append(F.lit(None).cast("bigint").alias("_cancel"))
    if has(df, "order_datetime"):
        aggs += [F.min("order_datetime").alias("periodo_min"), F.max("order_datetime").alias("periodo_max")]
    else:
        aggs += [F.lit(None).cast("timestamp_ntz").alias(c) for c in ("periodo_min", "periodo_max")]
    row = df.agg(*aggs)
    total = F.col("total_pedidos")
    days = F.greatest(elapsed_whole_days(F.col("periodo_min"), F.col("periodo_max")) + 1, F.lit(1))
    cancel_pct = F.when(total > 0, F.col("_cancel") / total * 100.0).otherwise(F.lit(0.0))
    return row.select(
        "total_pedidos",
        "receita_total",
        "ticket_medio",
        (F.when(F.col("_cancel").isNotNull(), cancel_pct) if has(df, "status") else F.lit(None).cast("double")).alias(
            "cancelados_pct"
        ),
        F.when(F.col("periodo_min").isNotNull() & (total > 0), total / days).alias("pedidos_por_dia"),
        "periodo_min",
        "periodo_max",
    )


def timeseries_orders(
    fact: DataFrame,
    spec: FilterSpec | None = None,
    freq: str = "D",
    origin: _dt.date | None = None,
    bounds: bool = False,
) -> DataFrame:
    """date, orders; empty buckets between the first and last order count 0.
    ``freq`` is any calendar offset (``functions/buckets``); ``origin`` and
    ``bounds`` as in ``bucketed_series``."""
    df = _filtered(fact, spec)
    require(df, "order_datetime")
    measures = {"orders": F.count(F.lit(1))}
    return bucketed_series(df, "order_datetime", freq, measures, fill={"orders": 0}, origin=origin, bounds=bounds)


def timeseries_revenue_with_orders(fact: DataFrame, spec: FilterSpec | None = None, freq: str = "M") -> DataFrame:
    """date, receita_total, orders (orders also counts rows without a total)."""
    df = _filtered(fact, spec)
    require(df, "order_datetime", "total_brl")
    return bucketed_series(
        df,
        "order_datetime",
        freq,
        {"receita_total": F.coalesce(F.sum("total_brl"), F.lit(0.0)), "orders": F.count(F.lit(1))},
        fill={"receita_total": 0.0, "orders": 0},
    )


def _count_by(df: DataFrame, key: str, name: str = "orders") -> DataFrame:
    require(df, key)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))


def by_platform(fact: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """platform, orders; most orders first."""
    df = _filtered(fact, spec)
    return _count_by(df, "platform").orderBy(*by_measure_desc("orders", "platform"))


def top_macro_by_orders(fact: DataFrame, spec: FilterSpec | None = None, n: int = 5) -> DataFrame:
    """macro_bairro, orders; the ``n`` (1..50) busiest areas."""
    if not (1 <= n <= 50):
        raise ValueError("top_n must be within 1..50")
    df = _filtered(fact, spec)
    return top_n(_count_by(df, "macro_bairro"), n, by_measure_desc("orders", "macro_bairro"))


def status_distribution(fact: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """status, count; missing status counted under ``nan``."""
    df = _filtered(fact, spec)
    require(df, "status")
    return (
        df.groupBy(text_key("status").alias("status"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(*by_measure_desc("count", "status"))
    )


def ticket_histogram(fact: DataFrame, spec: FilterSpec | None = None, bins: int = 15) -> DataFrame:
    """bin_start, bin_end, count of total/items over orders with items > 0."""
    if not (3 <= bins <= 100):
        raise ValueError("bins must be within 3..100")
    return equal_width_histogram(_tickets(fact, spec), "ticket", bins)


def ticket_histogram_left_out(fact: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """binned, infinite, missing: how many tickets the histogram counts and
    how many have no place in it."""
    return left_out(_tickets(fact, spec), "ticket")


def _tickets(fact: DataFrame, spec: FilterSpec | None) -> DataFrame:
    df = _filtered(fact, spec)
    require(df, "total_brl", "num_itens")
    return df.where(F.col("num_itens") > 0).select(safe_div(F.col("total_brl"), F.col("num_itens")).alias("ticket"))


def macro_avg_revenue(fact: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """macro_bairro, avg_receita; highest first."""
    df = _filtered(fact, spec)
    require(df, "macro_bairro", "total_brl")
    return (
        df.where(F.col("macro_bairro").isNotNull())
        .groupBy("macro_bairro")
        .agg(F.avg("total_brl").alias("avg_receita"))
        .orderBy(*by_measure_desc("avg_receita", "macro_bairro"))
    )


def macro_choropleth(fact: DataFrame, spec: FilterSpec | None = None, metric: str = "avg_receita") -> DataFrame:
    """macro_bairro, value where value is orders, total_receita or (any other
    metric) avg_receita; in area order."""
    df = _filtered(fact, spec)
    require(df, "macro_bairro")
    metric = (metric or "avg_receita").lower()
    if metric == "orders":
        value = F.count(F.lit(1))
    else:
        require(df, "total_brl")
        value = F.coalesce(F.sum("total_brl"), F.lit(0.0)) if metric == "total_receita" else F.avg("total_brl")
    return (
        df.where(F.col("macro_bairro").isNotNull())
        .groupBy("macro_bairro")
        .agg(value.alias("value"))
        .orderBy(*by_keys("macro_bairro"))
    )
