"""Named dataset queries over the driver tables.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame. Making it may
run jobs: the canonical fact is derived from the given tables (mapping
``star``, its ``star_nulls`` variant, or ``events``) and written on first use
(``orderscope.sources.store``), pages and exact quantiles count rows and
checkpoint their slices, and the stream entries run their stream. One
dashboard dataset is planned on top. The ``*_direct`` entries build the fact from the raw tables inside the
query instead (the date bounds of their filter are pushed onto the raw
``o_orderdate`` scan). Filtered variants exercise the shared filters.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderscope.operators.filters import FilterSpec, apply_filters
from orderscope.operators.value_chunks import count_between, percentiles_from_chunks
from orderscope.plans import explore, finance, meta, ops, overview, refresh, satisfaction
from orderscope.session import ensure_checkpoint_dir
from orderscope.sources.columns import canonicalise, with_overrides
from orderscope.sources.footers import table_summary
from orderscope.sources.mapping import raw_orders, star_fact, table
from orderscope.sources.order_index import OrderIndex, order_index
from orderscope.sources.partials import PartialStore
from orderscope.sources.readers import coercion_report, read_orders
from orderscope.sources.sinks import write_dataset
from orderscope.sources.store import fact_folder, fact_key, materialised_fact, table_key
from orderscope.sources.text_index import TextIndex
from orderscope.streaming.corrections import streamed_corrections
from orderscope.streaming.windows import streamed_daily_orders, streamed_hourly_orders

Query = Callable[[SparkSession, str], DataFrame]

# Filter settings used by the filtered variants (values exist in the driver data).
SPEC_DATES_PLATFORM_SCORE = FilterSpec(
    start_date="1996-01-01", end_date="1999-12-31", platform=("BUILDING", "MACHINERY"), score_min=2.0
)
SPEC_DATES_PLATFORM = FilterSpec(start_date="1996-01-01", end_date="1999-12-31", platform=("BUILDING", "MACHINERY"))
SPEC_LATE = FilterSpec(delivery_status="atrasado", threshold_min=5.0)
SPEC_CLASS_AREA = FilterSpec(
    classe_pedido=("1-URGENT", "2-HIGH"), macro_bairro=("NATION_1", "NATION_4", "NATION_7", "NATION_12", "NATION_18", "NATION_23")
)
SPEC_ON_TIME_SCORE = FilterSpec(delivery_status="no_prazo", score_min=2.5, end_date="2000-06-30")
SPEC_NAN_PLATFORM = FilterSpec(platform=("nan", "BUILDING"))
SPEC_THRESHOLD = FilterSpec(threshold_min=10.0)

EXPLORE_COLUMNS = ["order_id", "platform", "macro_bairro", "total_brl", "status"]


def _on_star(fn, spec: FilterSpec | None = None, nulls: bool = False, **kw) -> Query:
    mapping = "star_nulls" if nulls else "star"
    return lambda spark, sf_dir: fn(materialised_fact(spark, sf_dir, mapping), spec, **kw)


def _on_star_by_month(fn, spec: FilterSpec | None = None, **kw) -> Query:
    """Over the fact stored under order_month= folders (directory pruning)."""
    return lambda spark, sf_dir: fn(materialised_fact(spark, sf_dir, "star", partition_by_month=True), spec, **kw)


def _on_star_direct(fn, spec: FilterSpec | None = None, **kw) -> Query:
    return lambda spark, sf_dir: fn(star_fact(spark, sf_dir, spec), spec, **kw)


def _on_events(fn, spec: FilterSpec | None = None, **kw) -> Query:
    return lambda spark, sf_dir: fn(materialised_fact(spark, sf_dir, "events"), spec, **kw)


def _on_raw(fn, extra: tuple[str, ...] = (), money: T.DecimalType | None = None, **kw) -> Query:
    """Over the untyped export, through alias resolution and coercion."""
    return lambda spark, sf_dir: fn(canonicalise(raw_orders(spark, sf_dir), extra=extra, money=money), **kw)


def _with_column(name: str, make, fn, **kw) -> Query:
    """Over the star fact with one column added or replaced."""
    return lambda spark, sf_dir: fn(materialised_fact(spark, sf_dir, "star").withColumn(name, make()), **kw)


def _some_infinite():
    return F.when(F.col("order_id") % 101 == 0, F.lit(float("inf"))).otherwise(F.col("total_brl"))


def _page_meta(index: OrderIndex, **kw) -> DataFrame:
    return explore.indexed_page_meta(index, **kw).withColumn("columns", F.array_join("columns", ","))


def _refreshed(fn, *args, **kw) -> Query:
    """From the partial states of the stored star fact, brought up to date first."""
    return lambda spark, sf_dir: fn(_partials(spark, sf_dir).states(), *args, **kw)


def _partials(spark: SparkSession, sf_dir: str) -> PartialStore:
    source = fact_folder(spark, sf_dir)
    store = PartialStore(spark, source, source.replace("/orderscope_facts/", "/orderscope_partials/"))
    store.refresh()
    return store


def _sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the percentiles estimated from stored sketches, for the late
    nineties and two platforms, are within the stated rank error."""
    platforms = ("BUILDING", "MACHINERY")
    estimates = refresh.percentiles_by_macro(_partials(spark, sf_dir).sketches(), ops.PERCENTILE_PROBS, "1996-01-01", "1999-12-31", platforms)
    spec = FilterSpec(start_date="1996-01-01", end_date="1999-12-31", end_inclusive_day=True, platform=platforms)
    rows = apply_filters(materialised_fact(spark, sf_dir), spec, "ops")
    return refresh.rank_check(estimates, rows, ops.PERCENTILE_PROBS)


def _searched(q: str) -> Query:
    """How many orders, of how many areas, a search finds through the trigram index."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = fact_key(spark, sf_dir)
        index = TextIndex(materialised_fact(spark, sf_dir, key=key), key)
        return explore.indexed_search(index, q).agg(F.count(F.lit(1)).alias("orders"), F.count_distinct("macro_bairro").alias("areas"))

    return run


def _chunks(fn, spec: FilterSpec | None = None, empty: str | None = None, **kw) -> Query:
    """Chunked value lists with their runs as text; ``empty`` names an area
    whose delivery times are blanked."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        fact = materialised_fact(spark, sf_dir, "star")
        if empty:
            blank = F.when(F.col("macro_bairro") != empty, F.col("actual_delivery_minutes"))
            fact = fact.withColumn("actual_delivery_minutes", blank)
        found = fn(fact, spec, **kw)
        text = F.transform("runs", lambda r: F.concat_ws("x", r["value"].cast("string"), r["count"].cast("string")))
        return found.withColumn("runs", F.array_join(text, ","))

    return run


def _indexed(fn, sort: str, order: int, slices: int | None = None, **kw) -> Query:
    """Over the order index of the star fact for a sort column."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = fact_key(spark, sf_dir)
        return fn(order_index(materialised_fact(spark, sf_dir, key=key), key, sort, order, slices=slices), **kw)

    return run


def _raw_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    index = order_index(lines, table_key(spark, sf_dir, "lineitem"), "l_quantity", 1, ("l_orderkey", "l_linenumber"))
    return explore.indexed_page(index, offset=1000, limit=500)


def _page_with_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page with the total that was observed in the same run."""
    rows, meta = explore.page_and_meta(
        materialised_fact(spark, sf_dir, "star"), q="a", cols=EXPLORE_COLUMNS, sort="total_brl", order=-1, offset=100, limit=200
    )
    return rows.select("*", F.lit(meta["total"]).cast("bigint").alias("total"), F.lit(meta["returned"]).cast("bigint").alias("returned"))


def _stored_as(fmt: str) -> Query:
    """The untyped export, written in a text format and ingested from there."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/orderscope_ingest/{uuid.uuid4().hex}"
        write_dataset(raw_orders(spark, sf_dir), path, fmt)
        return read_orders(spark, path, fmt)

    return run


def _meta(fn) -> Query:
    return lambda spark, sf_dir: fn(materialised_fact(spark, sf_dir, "star"))


def _explore(fn, **kw) -> Query:
    return lambda spark, sf_dir: fn(materialised_fact(spark, sf_dir, "star"), **kw)


QUERIES: dict[str, Query] = {
    # overview
    "overview_kpis": _on_star(overview.kpis, cancel_match="p"),
    "overview_kpis_filtered": _on_star(overview.kpis, SPEC_DATES_PLATFORM_SCORE, cancel_match="p"),
    "overview_timeseries_orders": _on_star(overview.timeseries_orders, freq="D"),
    "overview_timeseries_orders_weekly": _on_star(overview.timeseries_orders, freq="W"),
    "overview_timeseries_orders_monthly": _on_star(overview.timeseries_orders, freq="M"),
    "overview_timeseries_revenue_with_orders": _on_star(overview.timeseries_revenue_with_orders, freq="M"),
    "overview_timeseries_revenue_with_orders_weekly_filtered": _on_star(
        overview.timeseries_revenue_with_orders, SPEC_DATES_PLATFORM_SCORE, freq="W"
    ),
    # calendar offsets, one query per family
    "overview_timeseries_orders_3d": _on_star(overview.timeseries_orders, freq="3D"),
    "overview_timeseries_orders_2w": _on_star(overview.timeseries_orders, freq="2W", bounds=True),
    "overview_timeseries_orders_week_wed": _on_star(overview.timeseries_orders, SPEC_CLASS_AREA, freq="W-WED"),
    "overview_timeseries_revenue_2m": _on_star(overview.timeseries_revenue_with_orders, freq="2M"),
    "overview_timeseries_orders_month_start": _on_star(overview.timeseries_orders, freq="MS", bounds=True),
    "overview_timeseries_orders_quarter": _on_star(overview.timeseries_orders, freq="Q"),
    "overview_timeseries_revenue_quarter_feb": _on_star(overview.timeseries_revenue_with_orders, SPEC_DATES_PLATFORM_SCORE, freq="Q-FEB"),
    "overview_timeseries_orders_quarter_start": _on_star(overview.timeseries_orders, freq="QS"),
    "overview_timeseries_orders_year": _on_star(overview.timeseries_orders, freq="Y"),
    "finance_timeseries_revenue_year_mar": _on_star(finance.timeseries_revenue, freq="Y-MAR"),
    "ops_timeseries_delivery_business_days": _on_star(ops.timeseries_delivery, SPEC_CLASS_AREA, freq="B"),
    "overview_timeseries_orders_business_month": _on_star(overview.timeseries_orders, freq="BME", bounds=True),
    "overview_timeseries_revenue_business_month_start": _on_star(overview.timeseries_revenue_with_orders, freq="BMS"),
    "finance_timeseries_revenue_business_quarter_feb": _on_star(finance.timeseries_revenue, freq="BQS-FEB"),
    "ops_timeseries_delivery_semi_month": _on_star(ops.timeseries_delivery, SPEC_CLASS_AREA, freq="SM"),
    "satisfaction_timeseries_semi_month_start": _on_star(satisfaction.timeseries, freq="SMS"),
    "overview_timeseries_orders_6h_events": _on_events(overview.timeseries_orders, freq="6H"),
    "overview_timeseries_orders_90min_events": _on_events(overview.timeseries_orders, freq="90min"),
    "satisfaction_timeseries_2q": _on_star(satisfaction.timeseries, freq="2Q"),
    "overview_by_platform": _on_star(overview.by_platform),
    "overview_by_platform_nulls": _on_star(overview.by_platform, nulls=True),
    "overview_top_macro_by_orders": _on_star(overview.top_macro_by_orders, n=5),
    "overview_status_distribution": _on_star(overview.status_distribution),
    "overview_status_distribution_nan_platform": _on_star(overview.status_distribution, SPEC_NAN_PLATFORM, nulls=True),
    "overview_ticket_histogram": _on_star(overview.ticket_histogram, bins=15),
    "overview_ticket_histogram_filtered": _on_star(overview.ticket_histogram, SPEC_CLASS_AREA, bins=40),
    "overview_ticket_histogram_infinite": _with_column("total_brl", _some_infinite, overview.ticket_histogram, bins=15),
    "overview_ticket_histogram_left_out": _with_column(
        "total_brl", _some_infinite, overview.ticket_histogram_left_out
    ),
    "overview_macro_avg_revenue": _on_star(overview.macro_avg_revenue),
    "overview_macro_choropleth": _on_star(overview.macro_choropleth, metric="avg_receita"),
    "overview_macro_choropleth_orders": _on_star(overview.macro_choropleth, metric="orders"),
    "overview_macro_choropleth_total": _on_star(overview.macro_choropleth, metric="total_receita"),
    "overview_timeseries_orders_events": _on_events(overview.timeseries_orders, freq="D"),
    # ops
    "ops_kpis": _on_star(ops.kpis, grace_min=0.0),
    "ops_kpis_late": _on_star(ops.kpis, SPEC_LATE, grace_min=10.0),
    "ops_timeseries_delivery": _on_star(ops.timeseries_delivery, freq="D"),
    "ops_timeseries_delivery_weekly": _on_star(ops.timeseries_delivery, freq="W"),
    "ops_boxplot_delivery_by_macro": _on_star(ops.boxplot_delivery_by_macro),
    "ops_boxplot_values_by_macro": _on_star(ops.boxplot_values_by_macro),
    # value lists in chunks, and what is read from them
    "ops_value_chunks_by_macro": _chunks(ops.value_chunks_by_macro, chunk=16, slices=5),
    "ops_value_chunks_by_macro_empty": _chunks(ops.value_chunks_by_macro, empty="NATION_3"),
    "ops_value_chunks_by_weekday": _chunks(ops.value_chunks_by_weekday, SPEC_LATE, chunk=20),
    "ops_percentiles_from_chunks": _on_star(
        lambda fact, spec: percentiles_from_chunks(ops.value_chunks_by_macro(fact, spec, chunk=16), ["macro_bairro"], ops.BOX_PROBS)
    ),
    "ops_count_between_from_chunks": _on_star(
        lambda fact, spec: count_between(ops.value_chunks_by_macro(fact, spec, chunk=8), ["macro_bairro"], 30.0, 45.0), SPEC_CLASS_AREA
    ),
    "ops_delay_heatmap_by_macro": _on_star(ops.delay_heatmap_by_macro),
    "ops_scatter_distance_delivery": _on_star(ops.scatter_distance_delivery),
    "ops_orders_by_hour": _on_star(ops.orders_by_hour),
    "ops_orders_by_hour_events": _on_events(ops.orders_by_hour),
    "ops_late_rate_by_macro": _on_star(ops.late_rate_by_macro),
    "ops_late_rate_by_macro_nulls": _on_star(ops.late_rate_by_macro, SPEC_THRESHOLD, nulls=True),
    "ops_percentiles_by_macro": _on_star(ops.percentiles_by_macro),
    "ops_percentiles_by_macro_sliced": _on_star(ops.percentiles_by_macro, slices=8),
    "ops_percentiles_by_macro_events": _on_events(ops.percentiles_by_macro),
    "ops_delivery_by_weekday": _on_star(ops.delivery_by_weekday),
    "ops_delivery_values_by_weekday": _on_star(ops.delivery_values_by_weekday),
    "ops_avg_delivery_by_hour": _on_star(ops.avg_delivery_by_hour),
    "ops_heatmap_hour_weekday": _on_star(ops.heatmap_hour_weekday, metric="avg_delivery_minutes"),
    "ops_heatmap_hour_weekday_delay": _on_star(ops.heatmap_hour_weekday, metric="avg_delay"),
    "ops_heatmap_hour_weekday_events": _on_events(ops.heatmap_hour_weekday, metric="avg_delivery_minutes"),
    "ops_late_rate_by_platform": _on_star(ops.late_rate_by_platform),
    # finance
    "finance_kpis": _on_star(finance.kpis),
    "finance_orders_count": _on_star(finance.orders_count),
    "finance_orders_count_filtered": _on_star(finance.orders_count, SPEC_CLASS_AREA),
    "finance_kpis_by_month_filtered": _on_star_by_month(finance.kpis, SPEC_DATES_PLATFORM_SCORE),
    "finance_timeseries_revenue": _on_star(finance.timeseries_revenue, freq="D"),
    "finance_timeseries_revenue_monthly": _on_star(finance.timeseries_revenue, freq="M"),
    "finance_margin_by_platform": _on_star(finance.margin_by_platform),
    "finance_revenue_by_class": _on_star(finance.revenue_by_class),
    "finance_revenue_by_class_status": _on_star(finance.revenue_by_class, class_col="status"),
    "finance_top_clients": _on_star(finance.top_clients, n=10),
    "finance_revenue_by_platform": _on_star(finance.revenue_by_platform),
    "finance_revenue_by_macro": _on_star(finance.revenue_by_macro),
    "finance_revenue_by_macro_top5_filtered": _on_star(finance.revenue_by_macro, SPEC_CLASS_AREA, n=5),
    "finance_revenue_by_item_class": _on_star(finance.revenue_by_item_class),
    "finance_revenue_by_item_class_explicit": _on_star(finance.revenue_by_item_class, class_col="order_mode"),
    "finance_revenue_by_macro_direct": _on_star_direct(finance.revenue_by_macro),
    "overview_kpis_filtered_direct": _on_star_direct(overview.kpis, SPEC_DATES_PLATFORM_SCORE, cancel_match="p"),
    "finance_revenue_by_class_extra": _on_raw(finance.revenue_by_class, extra=("tipo",), class_col="tipo"),
    "finance_revenue_by_item_class_synonyms": _on_raw(
        finance.revenue_by_item_class, extra=("tipo",), class_col="tipo"
    ),
    "finance_kpis_decimal": _on_raw(finance.kpis, money=T.DecimalType(18, 2)),
    # ingest
    "ingest_aliases": _on_raw(lambda fact: fact),
    "ingest_coercion_report": lambda spark, sf_dir: coercion_report(raw_orders(spark, sf_dir)),
    "ingest_csv": _stored_as("csv"),
    "ingest_json": _stored_as("json"),
    "ingest_second_date": lambda spark, sf_dir: overview.timeseries_orders(
        canonicalise(raw_orders(spark, sf_dir).withColumnRenamed("data_pedido", "data")), freq="M"
    ),
    "ingest_override": lambda spark, sf_dir: finance.kpis(
        canonicalise(raw_orders(spark, sf_dir), overrides={"total_brl": "qtd_itens", "num_itens": "no such column"})
    ),
    # another column for one dataset, and one that is absent
    "ops_kpis_override": _on_star(
        lambda fact, spec: ops.kpis(with_overrides(fact, {"actual_delivery_minutes": "tempo_preparo_minutos", "distance_km": "nope"}), spec)
    ),
    "overview_top_macro_override": _on_star(
        lambda fact, spec: overview.top_macro_by_orders(with_overrides(fact, {"macro_bairro": "order_mode"}), spec, n=3)
    ),
    # a class column that the fact lacks: the order class, the item count
    "finance_revenue_by_class_absent": _on_star(finance.revenue_by_class, class_col="no such column"),
    "finance_revenue_by_item_class_absent": _on_star(finance.revenue_by_item_class, class_col="no such column"),
    # optional columns that are empty throughout are left out
    "satisfaction_scatter_pruned": _on_star(
        lambda fact, spec: satisfaction.scatter_time_score(fact.drop("macro_bairro"), spec, prune_empty=True)
    ),
    # satisfaction
    "satisfaction_kpis": _on_star(satisfaction.kpis),
    "satisfaction_by_macro": _on_star(satisfaction.by_macro),
    "satisfaction_scatter_time_score": _on_star(satisfaction.scatter_time_score),
    "satisfaction_timeseries": _on_star(satisfaction.timeseries, freq="M"),
    "satisfaction_timeseries_weekly": _on_star(satisfaction.timeseries, freq="W"),
    "satisfaction_by_platform": _on_star(satisfaction.by_platform),
    "satisfaction_by_platform_on_time": _on_star(satisfaction.by_platform, SPEC_ON_TIME_SCORE),
    # from partial states: the rows of the datasets above from one scan of the fact
    "refresh_overview_kpis": _refreshed(refresh.overview_kpis, cancel_match="p"),
    "refresh_timeseries_orders": _refreshed(refresh.timeseries_orders, freq="D"),
    "refresh_timeseries_orders_weekly_filtered": _refreshed(refresh.timeseries_orders, SPEC_DATES_PLATFORM, freq="W"),
    "refresh_timeseries_revenue_with_orders": _refreshed(refresh.timeseries_revenue_with_orders, freq="M"),
    "refresh_by_platform": _refreshed(refresh.by_platform),
    "refresh_top_macro_by_orders": _refreshed(refresh.top_macro_by_orders, n=5),
    "refresh_status_distribution": _refreshed(refresh.status_distribution),
    "refresh_macro_avg_revenue": _refreshed(refresh.macro_avg_revenue),
    "refresh_ops_kpis": _refreshed(refresh.ops_kpis),
    "refresh_timeseries_delivery": _refreshed(refresh.timeseries_delivery, freq="D"),
    "refresh_delay_heatmap_by_macro": _refreshed(refresh.delay_heatmap_by_macro),
    "refresh_orders_by_hour": _refreshed(refresh.orders_by_hour),
    "refresh_late_rate_by_macro": _refreshed(refresh.late_rate, "macro_bairro"),
    "refresh_late_rate_by_platform": _refreshed(refresh.late_rate, "platform"),
    "refresh_heatmap_hour_weekday": _refreshed(refresh.heatmap_hour_weekday),
    "refresh_finance_kpis": _refreshed(refresh.finance_kpis),
    "refresh_timeseries_revenue": _refreshed(refresh.timeseries_revenue, freq="D"),
    "refresh_margin_by_platform": _refreshed(refresh.margin_by_platform),
    "refresh_revenue_by_platform": _refreshed(refresh.revenue_by, "platform"),
    "refresh_revenue_by_macro_top5_filtered": _refreshed(refresh.revenue_by, "macro_bairro", SPEC_CLASS_AREA, n=5),
    "refresh_revenue_by_class": _refreshed(refresh.revenue_by_class),
    "refresh_satisfaction_kpis": _refreshed(refresh.satisfaction_kpis),
    "refresh_satisfaction_by_macro": _refreshed(refresh.satisfaction_by, "macro_bairro"),
    "refresh_satisfaction_by_platform": _refreshed(refresh.satisfaction_by, "platform"),
    "refresh_satisfaction_timeseries": _refreshed(refresh.satisfaction_timeseries, freq="M"),
    "refresh_dashboard": _refreshed(refresh.dashboard),
    "refresh_percentiles_kll": _sketched,
    # meta (no filters)
    "meta_platforms": _meta(meta.platforms),
    "meta_macros": _meta(meta.macros),
    "meta_date_range": _meta(meta.date_range),
    # explore
    "explore_columns": _explore(explore.catalogue),
    "explore_column_counts": _explore(explore.catalogue, with_dtype=False),
    "explore_count": _explore(explore.count, q="build|^f$"),
    "explore_page": _indexed(
        explore.indexed_page, sort="total_brl", order=-1, q="a", cols=EXPLORE_COLUMNS, offset=100, limit=200
    ),
    "explore_page_asc": _indexed(explore.indexed_page, sort="status", order=1, cols=EXPLORE_COLUMNS, offset=0, limit=500),
    "explore_page_deep": _indexed(
        explore.indexed_page, sort="total_brl", order=1, cols=EXPLORE_COLUMNS, offset=9000, limit=1000
    ),
    # several slices, so that a page lies across them
    "explore_page_across_slices": _indexed(
        explore.indexed_page, slices=16, sort="total_brl", order=-1, q="a", cols=EXPLORE_COLUMNS, offset=700, limit=1500
    ),
    "explore_page_observed": _page_with_meta,
    "explore_page_unindexed": _explore(
        explore.page, q="a", cols=EXPLORE_COLUMNS, sort="total_brl", order=-1, offset=100, limit=200
    ),
    "explore_page_sliced": _explore(
        explore.page, q="a", cols=EXPLORE_COLUMNS, sort="total_brl", order=-1, offset=300, limit=900, slices=8
    ),
    # a table without an order id: ties go by the visible columns
    "explore_page_raw": _raw_page,
    "explore_page_meta": _indexed(
        _page_meta, sort="total_brl", order=-1, q="a", cols=EXPLORE_COLUMNS, offset=100, limit=200
    ),
    "explore_boolean_summary": _with_column(
        "late", lambda: F.col("actual_delivery_minutes") > F.col("eta_minutes_quote"),
        explore.feature_summary, column="late",
    ),
    "explore_summary_empty": _with_column(
        "total_brl", lambda: F.when(F.col("status") == "none", F.col("total_brl")),
        explore.feature_summary, column="total_brl",
    ),
    "explore_date_summary": _explore(explore.feature_summary, column="order_datetime"),
    "explore_numeric_summary": _explore(explore.numeric_summary, column="total_brl"),
    "explore_top_values": _explore(explore.top_values, column="macro_bairro"),
    # from the file footers; the columns they can't answer from a scan
    "explore_table_summary": lambda spark, sf_dir: table_summary(spark, f"{sf_dir}/orders.parquet"),
    "explore_table_summary_events": lambda spark, sf_dir: table_summary(spark, f"{sf_dir}/events.parquet").drop("dtype", "least", "greatest"),
    # searches through the trigram index: some files, no files, all files
    "explore_search_indexed": _searched("nation_1[0-9]|machin"),
    "explore_search_indexed_none": _searched("no such text"),
    "explore_search_indexed_all": _searched("build|^f$"),
    "explore_top_values_pruned": _explore(explore.top_values_pruned, column="cliente_id", n=20),
    "explore_top_values_pruned_events": lambda spark, sf_dir: explore.top_values_pruned(table(spark, sf_dir, "events"), "user_id", 12),
    # streaming: the events table as a file stream, daily event-time windows,
    # 1 hour allowed lateness, append mode, plus the windows open at the end
    "stream_events_daily_windows": streamed_daily_orders,
    "stream_events_hour_histogram": streamed_hourly_orders,
    # orders that come late and corrected: state per order, a changelog, merged
    "stream_events_corrections": streamed_corrections,
}

# Output columns that are sums of money; their exact values
# have at most 4 decimals. In "margin" queries gross/net are means instead.
SUM_COLUMNS = {"receita_total", "receita_liquida", "receita_bruta", "gross", "net", "revenue", "spent"}
SUM_COLUMNS_BY_QUERY = {
    "overview_macro_choropleth_total": {"value"},
    "finance_margin_by_platform": set(),
    "refresh_margin_by_platform": set(),
}


# Queries that pass stored values through: nothing is rounded.
ROW_LEVEL = {
    "explore_page",
    "explore_page_asc",
    "explore_page_deep",
    "explore_page_sliced",
    "explore_page_across_slices",
    "explore_page_observed",
    "explore_page_unindexed",
    "explore_page_raw",
    "ingest_aliases",
    "ingest_csv",
    "ingest_json",
    "satisfaction_scatter_pruned",
    "ops_scatter_distance_delivery",
    "ops_boxplot_values_by_macro",
    "ops_delivery_values_by_weekday",
    "satisfaction_scatter_time_score",
}


def sum_columns(name: str) -> set[str]:
    return SUM_COLUMNS_BY_QUERY.get(name, SUM_COLUMNS)


def check_round(df: DataFrame, sums: set[str] | None = None) -> DataFrame:
    """Round double columns half-up so results from engines with a different
    summation order compare equal: money sums on the 4-decimal grid (their
    exact values lie on it, so order noise never moves them), all other
    doubles (means, ratios, quantiles) on a 2^-12 grid, where decimal data
    never lands exactly half-way. ``floor(x·s + 0.5) / s`` is evaluated
    identically by any IEEE engine."""
    sums = SUM_COLUMNS if sums is None else sums
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            scale = 10000.0 if f.name in sums else 4096.0
            c = (F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)).alias(f.name)
        out.append(c)
    return df.select(*out)
