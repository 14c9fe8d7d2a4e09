"""Finance dashboard datasets (gross and net revenue, margins, classes)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderscope.functions.expressions import class_label, class_rank, item_class, net_revenue, safe_div
from orderscope.operators.filters import FilterSpec, apply_filters
from orderscope.operators.ranking import by_measure_desc, top_n
from orderscope.operators.timeseries import bucketed_series
from orderscope.sources.columns import MissingColumnError, has, require

VARIANT = "finance"
PCT = "platform_commision_pct"


def _filtered(fact: DataFrame, spec: FilterSpec | None) -> DataFrame:
    return apply_filters(fact, spec, VARIANT)


def _net():
    return net_revenue(F.col("total_brl"), F.col(PCT))


def _sum0(c):
    return F.coalesce(F.sum(c), F.lit(0.0))


def kpis(fact: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """One row: receita_total, receita_liquida, ticket_medio (Σ total / Σ
    items, 0 when there are no items), total_pedidos."""
    df = _filtered(fact, spec)
    has_total = has(df, "total_brl")
    row = df.agg(
        (_sum0("total_brl") if has_total else F.lit(0.0)).alias("receita_total"),
        (_sum0(_net()) if has_total and has(df, PCT) else F.lit(0.0)).alias("receita_liquida"),
        (_sum0("num_itens") if has(df, "num_itens") else F.lit(None).cast("double")).alias("_items"),
        F.count(F.lit(1)).alias("total_pedidos"),
    )
    ticket = (
        F.when(F.col("_items") > 0, F.col("receita_total") / F.col("_items")).otherwise(F.lit(0.0))
        if has_total and has(df, "num_itens") else F.lit(0.0)
    )
    return row.select("receita_total", "receita_liquida", ticket.alias("ticket_medio"), "total_pedidos")


def orders_count(fact: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """One row: total_pedidos."""
    return _filtered(fact, spec).agg(F.count(F.lit(1)).alias("total_pedidos"))


def timeseries_revenue(fact: DataFrame, spec: FilterSpec | None = None, freq: str = "D") -> DataFrame:
    """date, gross, net (net only when a commission column exists). The
    calendar covers orders with a total; empty buckets are 0."""
    df = _filtered(fact, spec)
    require(df, "order_datetime", "total_brl")
    rows = df.where(F.col("total_brl").isNotNull())
    measures = {"gross": _sum0("total_brl")}
    fill = {"gross": 0.0}
    if has(df, PCT):
        measures["net"] = _sum0(_net())
        fill["net"] = 0.0
    return bucketed_series(rows, "order_datetime", freq, measures, fill=fill)


def margin_by_platform(fact: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """platform, gross (mean total), net (mean net), margin_pct = net/gross
    as a fraction (0 when undefined); highest margin first."""
    df = _filtered(fact, spec)
    require(df, "platform", "total_brl", PCT)
    g = (
        df.where(F.col("platform").isNotNull())
        .groupBy("platform")
        .agg(F.avg("total_brl").alias("gross"), F.avg(_net()).alias("net"))
    )
    return g.select(
        "platform", "gross", "net", F.coalesce(safe_div(F.col("net"), F.col("gross")), F.lit(0.0)).alias("margin_pct")
    ).orderBy(*by_measure_desc("margin_pct", "platform"))


def revenue_by_class(fact: DataFrame, spec: FilterSpec | None = None, class_col: str | None = None) -> DataFrame:
    """class, revenue. The class is ``class_col`` if the fact has it (keep it
    at ingest with ``canonicalise(extra=[...])``), else the order mode, else the
    platform."""
    df = _filtered(fact, spec)
    require(df, "total_brl")
    if class_col and class_col in df.columns:
        key = class_col
    elif has(df, "order_mode"):
        key = "order_mode"
    elif has(df, "platform"):
        key = "platform"
    else:
        raise MissingColumnError("no class column (class_col, order_mode or platform)")
    return (
        df.where(F.col(f"`{key}`").isNotNull())
        .groupBy(F.col(f"`{key}`").alias("class"))
        .agg(_sum0("total_brl").alias("revenue"))
        .orderBy(*by_measure_desc("revenue", "class"))
    )


def top_clients(fact: DataFrame, spec: FilterSpec | None = None, n: int = 10) -> DataFrame:
    """cliente_id, spent; the ``n`` biggest spenders (no client column → no rows)."""
    df = _filtered(fact, spec)
    require(df, "total_brl")
    if not has(df, "cliente_id"):
        return df.sparkSession.createDataFrame([], "cliente_id string, spent double")
    g = df.where(F.col("cliente_id").isNotNull()).groupBy("cliente_id").agg(_sum0("total_brl").alias("spent"))
    return top_n(g, n, by_measure_desc("spent", "cliente_id"))


def _gross_net_by(df: DataFrame, key: str) -> DataFrame:
    require(df, key, "total_brl")
    net = _sum0(_net()) if has(df, PCT) else _sum0("total_brl")
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(_sum0("total_brl").alias("receita_bruta"), net.alias("receita_liquida"))
    )


def revenue_by_platform(fact: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """platform, receita_bruta, receita_liquida (= gross without a
    commission column); highest gross first."""
    df = _filtered(fact, spec)
    return _gross_net_by(df, "platform").orderBy(*by_measure_desc("receita_bruta", "platform"))


def revenue_by_macro(fact: DataFrame, spec: FilterSpec | None = None, n: int | None = None) -> DataFrame:
    """macro_bairro, receita_bruta, receita_liquida; optionally the top ``n``."""
    if n is not None and n < 1:
        raise ValueError("top_n must be >= 1")
    df = _filtered(fact, spec)
    return top_n(_gross_net_by(df, "macro_bairro"), n, by_measure_desc("receita_bruta", "macro_bairro"))


def revenue_by_item_class(
    fact: DataFrame, spec: FilterSpec | None = None, class_col: str | None = None, merge_synonyms: bool = False
) -> DataFrame:
    """classe, revenue in the order individual, combo, família, others.

    Without ``class_col``, or if the fact lacks it, the class comes from the
    item count. With it, the raw values are summed first and then lower-cased and mapped through the
    synonym table, so two spellings of one class stay two rows (set
    ``merge_synonyms`` to map before summing)."""
    df = _filtered(fact, spec)
    require(df, "total_brl")
    if class_col and class_col in df.columns:
        raw = F.col(f"`{class_col}`")
        if merge_synonyms:
            g = df.where(raw.isNotNull()).groupBy(class_label(raw).alias("classe")).agg(
                _sum0("total_brl").alias("revenue")
            )
        else:
            g = (
                df.where(raw.isNotNull())
                .groupBy(raw.alias("_raw"))
                .agg(_sum0("total_brl").alias("revenue"))
                .select(class_label(F.col("_raw")).alias("classe"), "revenue", F.col("_raw").cast("string").alias("_tie"))
            )
    else:
        require(df, "num_itens")
        g = df.groupBy(item_class(F.col("num_itens")).alias("classe")).agg(_sum0("total_brl").alias("revenue"))
    if "_tie" not in g.columns:
        g = g.withColumn("_tie", F.col("classe"))
    return g.orderBy(class_rank(F.col("classe")), F.col("_tie")).select("classe", "revenue")
