"""Build the canonical order fact from the TPC-H-like driver tables.

Mapping ``star`` (one row per order):

* orders ⋈ customer ⋈ nation gives platform (market segment) and area
  (nation name); lineitem is first aggregated **per order** (item count, max
  discount as the commission fraction) and then left-joined, so orders
  without lines keep their row with NULL items / commission.
* Delivery-side measures (prep, ETA, delivery, distance, score) and the time
  of day do not exist in those tables; they are derived with exact integer
  arithmetic from the order key so that any SQL engine reproduces them.

Scale notes. The lineitem aggregate is hash-partitioned on the order key and
its output partitioning is reused by the order join (only ``orders`` is
shuffled for it). Customer is joined on its own, so that the size of its files
and not a join's estimate decides about broadcasting it, and nation last. No
join is hinted: the planner broadcasts a side only when its size is under
``spark.sql.autoBroadcastJoinThreshold`` (nation always; the lineitem
aggregate and customer only at small scale), otherwise it plans a
sort-merge join, and AQE splits skewed customer keys. For a date-filtered query the bounds are pushed onto the
raw ``o_orderdate`` column (the derived timestamp lies in
``[o_orderdate, o_orderdate + 1 day)``), which prunes Parquet row groups.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderscope.operators.filters import FilterSpec, ts_literal

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _k() -> Column:
    return F.col("o_orderkey")


def _orders_date_prefilter(orders: DataFrame, spec: FilterSpec | None) -> DataFrame:
    """Superset filter on the raw date column implied by the date filter."""
    if spec is None:
        return orders
    lo, hi, hi_exclusive = spec.date_bounds()
    if lo is not None:
        orders = orders.where(F.col("o_orderdate") > ts_literal(lo - _dt.timedelta(days=1)))
    if hi is not None:
        cond = F.col("o_orderdate") < ts_literal(hi) if hi_exclusive else F.col("o_orderdate") <= ts_literal(hi)
        orders = orders.where(cond)
    return orders


def star_fact(
    spark: SparkSession,
    sf_dir: str,
    spec: FilterSpec | None = None,
) -> DataFrame:
    """Canonical fact, mapping ``star``."""
    raw_orders = table(spark, sf_dir, "orders")
    orders = _orders_date_prefilter(raw_orders, spec)
    lines = table(spark, sf_dir, "lineitem")
    if orders is not raw_orders:
        # Only the lines of orders in range are aggregated. Whether their keys
        # are broadcast or shuffled is left to their size.
        wanted = orders.select(F.col("o_orderkey").alias("_wanted"))
        lines = lines.join(wanted, F.col("l_orderkey") == F.col("_wanted"), "left_semi")
    lines = (
        lines.groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).cast("double").alias("num_itens"),
            F.max("l_discount").cast("double").alias("platform_commision_pct"),
        )
    )
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    joined = (
        orders.join(lines, _k() == F.col("l_orderkey"), "left")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    )
    k = _k()
    minutes_of_day = (k % 24) * 60 + (k * 7) % 60
    return joined.select(
        k.alias("order_id"),
        F.timestamp_add("MINUTE", minutes_of_day, F.col("o_orderdate")).alias("order_datetime"),
        F.col("c_mktsegment").alias("platform"),
        F.col("o_orderpriority").alias("order_mode"),
        F.col("o_orderstatus").alias("status"),
        F.col("n_name").alias("macro_bairro"),
        F.col("o_totalprice").cast("double").alias("total_brl"),
        F.col("num_itens"),
        (F.lit(10) + (k * 7) % 31).cast("double").alias("tempo_preparo_minutos"),
        F.when(k % 50 != 0, F.lit(20) + (k * 17) % 61).cast("double").alias("actual_delivery_minutes"),
        (F.lit(25) + (k * 13) % 36).cast("double").alias("eta_minutes_quote"),
        ((F.lit(5) + (k * 11) % 140).cast("double") / F.lit(10.0)).alias("distance_km"),
        F.col("platform_commision_pct"),
        F.when(k % 40 != 0, F.lit(1.0) + ((k * 3) % 9).cast("double") / F.lit(2.0)).alias("satisfacao_nivel"),
        F.col("o_custkey").alias("cliente_id"),
    )


def blank_some(fact: DataFrame) -> DataFrame:
    """Mapping ``star_nulls``: the star fact with some platforms and areas NULL."""
    k = F.col("order_id")
    return fact.withColumns(
        {
            "platform": F.when(k % 97 != 0, F.col("platform")),
            "macro_bairro": F.when(k % 89 != 0, F.col("macro_bairro")),
        }
    )


# Raw cells no coercion can read, and spellings of order classes.
BAD_NUMBERS = ("abc", "1,5", "1d", "nan", "", "  ")
BAD_DATES = ("bad", "", "2024-13-45")
CLASS_SPELLINGS = ("Single", "1", "COMBO", "duo", "Familia", "4+", "individual", "Outro")


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as an untyped export would hold them: every cell text, under
    other header names, some cells unreadable, and a class column outside the
    roles. Ingest queries start here."""
    k = F.col("o_orderkey")

    def pick(values: tuple[str, ...], by: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))

    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("_items"))
    orders = table(spark, sf_dir, "orders").join(lines, k == F.col("l_orderkey"), "left")
    return orders.select(
        k.cast("string").alias("id_pedido"),
        F.when(k % 37 == 0, pick(BAD_DATES, k)).otherwise(F.col("o_orderdate").cast("string")).alias("data_pedido"),
        F.col("o_orderpriority").alias("modo_pedido"),
        F.col("o_orderstatus").alias("order_status"),
        F.when(k % 23 == 0, pick(BAD_NUMBERS, k))
        .otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
        .alias("valor_total"),
        F.when(k % 29 == 0, pick(BAD_NUMBERS, k)).otherwise(F.col("_items").cast("string")).alias("qtd_itens"),
        F.when(k % 40 != 0, (1 + k % 5).cast("string")).alias("nota"),
        F.col("o_custkey").cast("string").alias("nome_cliente"),
        pick(CLASS_SPELLINGS, k).alias("tipo"),
    )


def events_fact(spark: SparkSession, sf_dir: str, spec: FilterSpec | None = None) -> DataFrame:
    """Mapping ``events``: the event stream read as orders. Real times of day
    and skewed values; the score is derived from the JSON ``k`` property."""
    ev = table(spark, sf_dir, "events")
    if spec is not None:
        lo, hi, hi_exclusive = spec.date_bounds()
        if lo is not None:
            ev = ev.where(F.col("ts") >= ts_literal(lo))
        if hi is not None:
            ev = ev.where(F.col("ts") < ts_literal(hi) if hi_exclusive else F.col("ts") <= ts_literal(hi))
    return events_to_fact(ev)


def events_to_fact(ev: DataFrame) -> DataFrame:
    """Projection of an events frame (batch or streaming) onto the fact."""
    k = F.get_json_object(F.col("props"), "$.k").try_cast("bigint")
    return ev.select(
        F.col("event_id").alias("order_id"),
        F.col("ts").alias("order_datetime"),
        F.col("event_type").alias("platform"),
        F.col("user_id").cast("string").alias("macro_bairro"),
        F.col("value").alias("total_brl"),
        F.col("value").alias("actual_delivery_minutes"),
        k.cast("double").alias("eta_minutes_quote"),
        (F.lit(1) + k % 5).cast("double").alias("satisfacao_nivel"),
        F.col("user_id").alias("cliente_id"),
    )
