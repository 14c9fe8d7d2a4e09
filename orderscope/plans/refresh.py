"""The dashboard datasets, answered from partial states.

Each function gives the rows of the dataset of the same name in ``overview``,
``ops``, ``finance`` or ``satisfaction``, but reads ``PartialStore.states()``, whose size
follows the number of different keys and hours, not of orders. Filters may use
what the states are keyed by: dates on the hour, platform, area, order class, and
late or on time without a threshold. What needs the orders themselves (score
bounds, other thresholds, clients, exact quantiles) raises ``ValueError``: ask
the fact. ``dashboard`` answers all grouped panels in one aggregate over
grouping sets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderscope.functions.expressions import check_java_regex, ci_regex, datetime_text, elapsed_whole_days, safe_div, text_key, weekday_mon0
from orderscope.operators.filters import FilterSpec, _membership, ts_literal
from orderscope.operators.ranking import by_keys, by_measure_desc, top_n
from orderscope.operators.timeseries import bucketed_series
from orderscope.sources.partials import RANK_ERROR


def _none() -> Column:
    return F.lit(0).cast("bigint")


def _total(name: str) -> Column:
    """Sum over the orders, 0 of none."""
    return F.coalesce(F.sum(f"s_{name}"), F.lit(0.0))


def _mean(name: str) -> Column:
    return F.try_divide(F.sum(f"s_{name}"), F.sum(f"n_{name}"))


def _count(column: str = "n") -> Column:
    return F.coalesce(F.sum(column), _none())


def _kept(states: DataFrame, spec: FilterSpec | None, variant: str) -> DataFrame:
    """The states of the orders that a filter keeps."""
    spec = spec or FilterSpec()
    if spec.score_min is not None or spec.score_max is not None:
        raise ValueError("the states aren't keyed by score: ask the fact")
    parts: list[Column] = []
    lo, hi, hi_exclusive = spec.date_bounds()
    for bound in (lo, hi):
        if bound is not None and (bound.minute, bound.second, bound.microsecond) != (0, 0, 0):
            raise ValueError("the states are kept by the hour: dates must be on the hour")
    at = F.col("at")
    if lo is not None:
        parts.append(at >= ts_literal(lo))
    if hi is not None:
        parts.append((at < ts_literal(hi)) if hi_exclusive else (at < ts_literal(hi)) | ((at == ts_literal(hi)) & F.col("on_hour")))
    for role, values in (("platform", spec.platform), ("macro_bairro", spec.macro_bairro)):
        if values:
            parts.append(_membership(role, tuple(values)))
    if variant in ("overview", "finance") and spec.classe_pedido:
        parts.append(_membership("order_mode", tuple(spec.classe_pedido)))
    if variant in ("ops", "satisfaction") and spec.delivery_status:
        if spec.threshold_min and variant == "ops":
            raise ValueError("the states know late orders without a threshold: ask the fact")
        parts.append(F.col("late") if spec.delivery_status == "atrasado" else ~F.col("late"))
    if variant == "satisfaction":
        parts.append(F.col("scored"))
    return states.where(reduce(lambda a, b: a & b, parts)) if parts else states


# ------------------------------------------------------------- overview

def overview_kpis(states: DataFrame, spec: FilterSpec | None = None, cancel_match: str = "cancel") -> DataFrame:
    check_java_regex(states.sparkSession, cancel_match)
    cancelled = F.sum(F.when(text_key("status").rlike(ci_regex(cancel_match)), F.col("n")).otherwise(_none()))
    row = _kept(states, spec, "overview").agg(
        _count().alias("total_pedidos"), _total("total").alias("receita_total"), _mean("ticket").alias("ticket_medio"),
        F.coalesce(cancelled, _none()).alias("_cancel"), F.min("dt_min").alias("periodo_min"), F.max("dt_max").alias("periodo_max"),
    )
    total = F.col("total_pedidos")
    days = F.greatest(elapsed_whole_days(F.col("periodo_min"), F.col("periodo_max")) + 1, F.lit(1))
    return row.select(
        "total_pedidos", "receita_total", "ticket_medio",
        F.when(total > 0, F.col("_cancel") / total * 100.0).otherwise(F.lit(0.0)).alias("cancelados_pct"),
        F.when(F.col("periodo_min").isNotNull() & (total > 0), total / days).alias("pedidos_por_dia"),
        "periodo_min", "periodo_max",
    )


def timeseries_orders(states: DataFrame, spec: FilterSpec | None = None, freq: str = "D") -> DataFrame:
    """``freq``: hours and coarser."""
    return bucketed_series(_kept(states, spec, "overview"), "at", freq, {"orders": F.sum("n")}, fill={"orders": 0})


def timeseries_revenue_with_orders(states: DataFrame, spec: FilterSpec | None = None, freq: str = "M") -> DataFrame:
    measures = {"receita_total": _total("total"), "orders": F.sum("n")}
    return bucketed_series(_kept(states, spec, "overview"), "at", freq, measures, fill={"receita_total": 0.0, "orders": 0})


def _by(states: DataFrame, key: str, *measures: Column) -> DataFrame:
    return states.where(F.col(key).isNotNull()).groupBy(key).agg(*measures)


def by_platform(states: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    return _by(_kept(states, spec, "overview"), "platform", F.sum("n").alias("orders")).orderBy(*by_measure_desc("orders", "platform"))


def top_macro_by_orders(states: DataFrame, spec: FilterSpec | None = None, n: int = 5) -> DataFrame:
    if not (1 <= n <= 50):
        raise ValueError("top_n must be within 1..50")
    grouped = _by(_kept(states, spec, "overview"), "macro_bairro", F.sum("n").alias("orders"))
    return top_n(grouped, n, by_measure_desc("orders", "macro_bairro"))


def status_distribution(states: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    grouped = _kept(states, spec, "overview").groupBy(text_key("status").alias("status")).agg(F.sum("n").alias("count"))
    return grouped.orderBy(*by_measure_desc("count", "status"))


def macro_avg_revenue(states: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    grouped = _by(_kept(states, spec, "overview"), "macro_bairro", _mean("total").alias("avg_receita"))
    return grouped.orderBy(*by_measure_desc("avg_receita", "macro_bairro"))


# ------------------------------------------------------------------ ops

def ops_kpis(states: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """Without grace minutes."""
    on_time = F.try_divide(F.sum("n_delay") - F.sum("n_late"), F.sum("n_delay")) * 100.0
    return _kept(states, spec, "ops").agg(
        _mean("prep").alias("tempo_medio_preparo"), _mean("delivery").alias("tempo_medio_entrega"), _mean("delay").alias("atraso_medio"),
        _mean("distance").alias("distancia_media"), F.coalesce(on_time, F.lit(0.0)).alias("on_time_rate_pct"),
    )


def timeseries_delivery(states: DataFrame, spec: FilterSpec | None = None, freq: str = "D") -> DataFrame:
    rows = _kept(states, spec, "ops").where("n_delivery > 0")
    return bucketed_series(rows, "at", freq, {"avg_delivery_minutes": _mean("delivery")})


def delay_heatmap_by_macro(states: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    return _by(_kept(states, spec, "ops"), "macro_bairro", _mean("delay").alias("avg_delay")).orderBy(*by_keys("macro_bairro"))


def orders_by_hour(states: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    rows = _kept(states, spec, "ops").where(F.col("at").isNotNull())
    per_hour = rows.groupBy(F.hour("at").alias("hour")).agg(F.sum("n").alias("orders"))
    total = F.sum("orders").over(Window.partitionBy())  # at most 24 rows
    return per_hour.select("hour", "orders", F.coalesce(F.try_divide(F.col("orders"), total), F.lit(0.0)).alias("share")).orderBy("hour")


def late_rate(states: DataFrame, key: str, spec: FilterSpec | None = None) -> DataFrame:
    """By ``macro_bairro`` or ``platform``, without a threshold."""
    if spec and spec.threshold_min:
        raise ValueError("the states know late orders without a threshold: ask the fact")
    rows = _kept(states, spec.without_delivery_status() if spec else None, "ops")
    grouped = rows.groupBy(text_key(key).alias(key)).agg(F.sum("n_late").alias("late_count"), F.sum("n").alias("_n"))
    return grouped.select(
        key, "late_count", (F.col("_n") - F.col("late_count")).alias("on_time_count"),
        F.coalesce(F.try_divide(F.col("late_count"), F.col("_n")), F.lit(0.0)).alias("late_rate"),
    ).orderBy(*by_measure_desc("late_rate", key))


def heatmap_hour_weekday(states: DataFrame, spec: FilterSpec | None = None, metric: str = "avg_delivery_minutes") -> DataFrame:
    name = "delay" if metric == "avg_delay" else "delivery"
    rows = _kept(states, spec, "ops").where(F.col("at").isNotNull() & (F.col(f"n_{name}") > 0))
    grouped = rows.groupBy(F.hour("at").alias("hour"), weekday_mon0(F.col("at")).alias("weekday")).agg(_mean(name).alias("value"))
    return grouped.orderBy("weekday", "hour")


# -------------------------------------------------------------- finance

def finance_kpis(states: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    row = _kept(states, spec, "finance").agg(
        _total("total").alias("receita_total"), _total("net").alias("receita_liquida"), _total("items").alias("_items"), _count().alias("total_pedidos")
    )
    ticket = F.when(F.col("_items") > 0, F.col("receita_total") / F.col("_items")).otherwise(F.lit(0.0))
    return row.select("receita_total", "receita_liquida", ticket.alias("ticket_medio"), "total_pedidos")


def timeseries_revenue(states: DataFrame, spec: FilterSpec | None = None, freq: str = "D") -> DataFrame:
    rows = _kept(states, spec, "finance").where("n_total > 0")
    return bucketed_series(rows, "at", freq, {"gross": _total("total"), "net": _total("net")}, fill={"gross": 0.0, "net": 0.0})


def margin_by_platform(states: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    grouped = _by(_kept(states, spec, "finance"), "platform", _mean("total").alias("gross"), _mean("net").alias("net"))
    margin = F.coalesce(safe_div(F.col("net"), F.col("gross")), F.lit(0.0))
    return grouped.withColumn("margin_pct", margin).orderBy(*by_measure_desc("margin_pct", "platform"))


def revenue_by(states: DataFrame, key: str, spec: FilterSpec | None = None, n: int | None = None) -> DataFrame:
    """Gross and net by ``platform`` or ``macro_bairro``."""
    grouped = _by(_kept(states, spec, "finance"), key, _total("total").alias("receita_bruta"), _total("net").alias("receita_liquida"))
    return top_n(grouped, n, by_measure_desc("receita_bruta", key))


def revenue_by_class(states: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    grouped = _by(_kept(states, spec, "finance"), "order_mode", _total("total").alias("revenue"))
    return grouped.withColumnRenamed("order_mode", "class").orderBy(*by_measure_desc("revenue", "class"))


# --------------------------------------------------------- satisfaction

def satisfaction_kpis(states: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    row = _kept(states, spec, "satisfaction").agg(
        _mean("score").alias("_mean"), F.try_divide(F.sum("n_satisfied"), F.sum("n_score")).alias("_share"),
        _count("n_score").alias("total_avaliacoes"), F.min("dt_min").alias("_min"), F.max("dt_max").alias("_max"),
    )
    return row.select(
        F.coalesce("_mean", F.lit(0.0)).alias("nivel_medio"), F.coalesce(F.col("_share") * 100.0, F.lit(0.0)).alias("pct_muito_satisfeitos"),
        "total_avaliacoes", datetime_text(F.col("_min")).alias("periodo_min"), datetime_text(F.col("_max")).alias("periodo_max"),
    )


def satisfaction_by(states: DataFrame, key: str, spec: FilterSpec | None = None) -> DataFrame:
    """By ``macro_bairro`` (best first) or ``platform`` (in its order)."""
    grouped = _by(_kept(states, spec, "satisfaction"), key, _mean("score").alias("avg_satisfacao"), F.sum("n_score").alias("count"))
    return grouped.orderBy(*(by_measure_desc("avg_satisfacao", key) if key == "macro_bairro" else by_keys(key)))


def satisfaction_timeseries(states: DataFrame, spec: FilterSpec | None = None, freq: str = "M") -> DataFrame:
    measures = {"avg_satisfacao": _mean("score"), "count": F.sum("n_score")}
    return bucketed_series(_kept(states, spec, "satisfaction"), "at", freq, measures, fill={"avg_satisfacao": 0.0, "count": 0})


# ------------------------------------------------------------- together

PANELS = ((), ("platform",), ("macro_bairro",), ("order_mode",), ("hour",), ("platform", "macro_bairro"))


def dashboard(states: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """All grouped panels at once, in long form: ``panel`` (the names of its keys,
    ``total`` for none), the keys, orders, receita_bruta, receita_liquida,
    avg_delivery_minutes, late_count, avg_satisfacao. One scan of the states, one
    aggregate over grouping sets. Unknown keys are groups too."""
    keys = ["platform", "macro_bairro", "order_mode", "hour"]
    rows = _kept(states, spec, "overview").withColumn("hour", F.hour("at"))
    grouped = rows.groupingSets([[F.col(c) for c in p] for p in PANELS], *keys).agg(
        F.grouping_id().alias("_id"), F.sum("n").alias("orders"), _total("total").alias("receita_bruta"), _total("net").alias("receita_liquida"),
        _mean("delivery").alias("avg_delivery_minutes"), F.sum("n_late").alias("late_count"), _mean("score").alias("avg_satisfacao"),
    )
    # The grouping id has a bit per key that a set leaves out, the first key highest.
    ids = {sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in p): "+".join(p) or "total" for p in PANELS}
    name = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])[F.col("_id").cast("int")]
    return grouped.select(name.alias("panel"), *keys, "orders", "receita_bruta", "receita_liquida", "avg_delivery_minutes", "late_count", "avg_satisfacao")


def percentiles_by_macro(
    sketches: DataFrame, probs: dict[str, float], start_day=None, end_day=None, platform: tuple[str, ...] = ()
) -> DataFrame:
    """macro_bairro, count, one estimate per name in ``probs`` from the merged KLL
    sketches of the days ``start_day .. end_day`` (both inside) and platforms. An
    estimate is a value of the group whose rank is within ``RANK_ERROR`` of the
    wanted share, with 99 % confidence."""
    rows = sketches.where(F.col("macro_bairro").isNotNull())
    if start_day is not None:
        rows = rows.where(F.col("day") >= F.lit(start_day).cast("date"))
    if end_day is not None:
        rows = rows.where(F.col("day") <= F.lit(end_day).cast("date"))
    if platform:
        rows = rows.where(_membership("platform", platform))
    merged = rows.groupBy("macro_bairro").agg(F.sum("n").alias("count"), F.kll_merge_agg_double("sketch").alias("_s"))
    out = [F.kll_sketch_get_quantile_double("_s", F.lit(float(p))).alias(name) for name, p in probs.items()]
    return merged.select("macro_bairro", "count", *out).orderBy(*by_keys("macro_bairro"))


def rank_check(estimates: DataFrame, fact: DataFrame, probs: dict[str, float], error: float = RANK_ERROR) -> DataFrame:
    """macro_bairro, count and, per name, whether the estimate's true ranks in
    ``fact`` reach the wanted share within ``error``."""
    rows = fact.where(F.col("macro_bairro").isNotNull() & F.col("actual_delivery_minutes").isNotNull())
    held = rows.select("macro_bairro", F.col("actual_delivery_minutes").alias("_v")).join(estimates, "macro_bairro")
    counted = held.groupBy("macro_bairro", "count").agg(
        *[c for name in probs for c in (F.avg((F.col("_v") < F.col(name)).cast("int")).alias(f"_lo_{name}"), F.avg((F.col("_v") <= F.col(name)).cast("int")).alias(f"_hi_{name}"))]
    )
    inside = [((F.col(f"_lo_{n}") <= p + error) & (F.col(f"_hi_{n}") >= p - error)).alias(n) for n, p in probs.items()]
    return counted.select("macro_bairro", "count", *inside)
