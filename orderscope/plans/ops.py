"""Operations (delivery performance) dashboard datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderscope.functions.expressions import late_flag, text_key, weekday_mon0
from orderscope.operators.filters import FilterSpec, apply_filters
from orderscope.operators.quantiles import group_quantiles
from orderscope.operators.ranking import by_keys, by_measure_desc
from orderscope.operators.timeseries import bucketed_series
from orderscope.operators.value_chunks import CHUNK, value_chunks
from orderscope.sources.columns import has, require

VARIANT = "ops"
DELIVERY = "actual_delivery_minutes"
ETA = "eta_minutes_quote"

# Box-plot statistics as quantile probabilities.
BOX_PROBS = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
PERCENTILE_PROBS = {"p50": 0.5, "p75": 0.75, "p90": 0.9}


def _filtered(fact: DataFrame, spec: FilterSpec | None) -> DataFrame:
    return apply_filters(fact, spec, VARIANT)


def kpis(fact: DataFrame, spec: FilterSpec | None = None, grace_min: float = 0.0) -> DataFrame:
    """One row of means (prep, delivery, delay = delivery − eta, distance)
    and on_time_rate_pct = % of orders with both times where delivery ≤
    eta + grace. A missing column gives 0.0; no usable rows gives NULL
    means and a 0.0 rate."""
    df = _filtered(fact, spec)

    def mean_of(role: str, name: str):
        return F.avg(role).alias(name) if has(df, role) else F.lit(0.0).alias(name)

    both = has(df, DELIVERY) and has(df, ETA)
    d, e = F.col(DELIVERY), F.col(ETA)
    aggs = [
        mean_of("tempo_preparo_minutos", "tempo_medio_preparo"),
        mean_of(DELIVERY, "tempo_medio_entrega"),
        (F.avg(d - e) if both else F.lit(0.0)).alias("atraso_medio"),
        mean_of("distance_km", "distancia_media"),
    ]
    if both:
        known = d.isNotNull() & e.isNotNull()
        aggs.append(
            F.coalesce(
                F.avg(F.when(known, F.when(d <= e + F.lit(float(grace_min)), 1.0).otherwise(0.0))) * 100.0,
                F.lit(0.0),
            ).alias("on_time_rate_pct")
        )
    else:
        aggs.append(F.lit(0.0).alias("on_time_rate_pct"))
    return df.agg(*aggs)


def timeseries_delivery(fact: DataFrame, spec: FilterSpec | None = None, freq: str = "D") -> DataFrame:
    """date, avg_delivery_minutes; empty buckets stay NULL."""
    df = _filtered(fact, spec)
    require(df, "order_datetime", DELIVERY)
    rows = df.where(F.col(DELIVERY).isNotNull())
    return bucketed_series(rows, "order_datetime", freq, {"avg_delivery_minutes": F.avg(DELIVERY)})


def _delivery_rows(df: DataFrame, key_expr, key: str) -> DataFrame:
    return df.select(key_expr.alias(key), F.col(DELIVERY).alias("delivery_minutes")).where(
        F.col(key).isNotNull() & F.col("delivery_minutes").isNotNull()
    )


def boxplot_delivery_by_macro(fact: DataFrame, spec: FilterSpec | None = None, method: str = "exact") -> DataFrame:
    """macro_bairro, count, min, q1, median, q3, max of delivery minutes.

    The per-area value lists of a box plot are summarised where they are
    computed (exact, distributed rank selection), instead of being collected
    into one array per area; ``boxplot_values_by_macro`` gives the values."""
    df = _filtered(fact, spec)
    require(df, "macro_bairro", DELIVERY)
    rows = _delivery_rows(df, F.col("macro_bairro"), "macro_bairro")
    return group_quantiles(rows, ["macro_bairro"], "delivery_minutes", BOX_PROBS, method=method).orderBy(
        *by_keys("macro_bairro")
    )


def boxplot_values_by_macro(fact: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """Long form of the per-area value lists: macro_bairro, delivery_minutes."""
    df = _filtered(fact, spec)
    require(df, "macro_bairro", DELIVERY)
    return _delivery_rows(df, F.col("macro_bairro"), "macro_bairro")


def value_chunks_by_macro(
    fact: DataFrame, spec: FilterSpec | None = None, chunk: int = CHUNK, slices: int | None = None
) -> DataFrame:
    """The per-area value lists of a box plot as numbered chunks: macro_bairro,
    chunk, first_rank, n, low, high, runs (see ``operators/value_chunks``). An
    area without a delivery time keeps an empty list."""
    df = _filtered(fact, spec)
    require(df, "macro_bairro", DELIVERY)
    return value_chunks(df, ["macro_bairro"], DELIVERY, chunk, slices)


def value_chunks_by_weekday(
    fact: DataFrame, spec: FilterSpec | None = None, chunk: int = CHUNK, slices: int | None = None
) -> DataFrame:
    """As by area, per weekday (Monday = 0) with a delivery time."""
    return value_chunks(_weekday_rows(_filtered(fact, spec)), ["weekday"], "delivery_minutes", chunk, slices)


def delay_heatmap_by_macro(fact: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """macro_bairro, avg_delay (NULL when no order of the area has both times)."""
    df = _filtered(fact, spec)
    require(df, "macro_bairro", DELIVERY, ETA)
    return (
        df.where(F.col("macro_bairro").isNotNull())
        .groupBy("macro_bairro")
        .agg(F.avg(F.col(DELIVERY) - F.col(ETA)).alias("avg_delay"))
        .orderBy(*by_keys("macro_bairro"))
    )


def scatter_distance_delivery(fact: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """distance_km, delivery_minutes: one row per order with both (row-level
    output; write it out rather than collecting it)."""
    df = _filtered(fact, spec)
    require(df, "distance_km", DELIVERY)
    return df.select(
        F.col("distance_km"), F.col(DELIVERY).alias("delivery_minutes")
    ).where(F.col("distance_km").isNotNull() & F.col("delivery_minutes").isNotNull())


def orders_by_hour(fact: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """hour, orders, share of all orders with a timestamp (hours with no
    order are absent)."""
    df = _filtered(fact, spec)
    require(df, "order_datetime")
    per_hour = (
        df.where(F.col("order_datetime").isNotNull())
        .groupBy(F.hour("order_datetime").alias("hour"))
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    # At most 24 rows reach this window, so the single partition is bounded.
    total = F.sum("orders").over(Window.partitionBy())
    return per_hour.select(
        "hour", "orders", F.coalesce(F.try_divide(F.col("orders"), total), F.lit(0.0)).alias("share")
    ).orderBy("hour")


def _late_rate(df: DataFrame, key: str, threshold_min: float | None, unknown_count: bool = False) -> DataFrame:
    require(df, key, DELIVERY, ETA)
    late = late_flag(F.col(DELIVERY), F.col(ETA), float(threshold_min or 0.0))
    unknown = (F.col(DELIVERY) - F.col(ETA)).isNull()
    g = df.groupBy(text_key(key).alias(key)).agg(
        F.count_if(late).alias("late_count"), F.count(F.lit(1)).alias("_total"), F.count_if(unknown).alias("_unknown")
    )
    cols = [
        F.col(key),
        F.col("late_count"),
        (F.col("_total") - F.col("late_count")).alias("on_time_count"),
        F.coalesce(F.try_divide(F.col("late_count"), F.col("_total")), F.lit(0.0)).alias("late_rate"),
    ]
    if unknown_count:
        cols.append(F.col("_unknown").alias("unknown_count"))
    return g.select(*cols).orderBy(*by_measure_desc("late_rate", key))


def late_rate_by_macro(fact: DataFrame, spec: FilterSpec | None = None, unknown_count: bool = False) -> DataFrame:
    """macro_bairro, late_count, on_time_count, late_rate. Late means
    delivery − eta > threshold_min; an unknown delay counts as on time
    (``unknown_count`` adds how many those are). The late/on-time filter of
    the spec is not applied here."""
    spec = spec or FilterSpec()
    df = _filtered(fact, spec.without_delivery_status())
    return _late_rate(df, "macro_bairro", spec.threshold_min, unknown_count)


def late_rate_by_platform(fact: DataFrame, spec: FilterSpec | None = None, unknown_count: bool = False) -> DataFrame:
    """platform, late_count, on_time_count, late_rate (as by area)."""
    spec = spec or FilterSpec()
    df = _filtered(fact, spec.without_delivery_status())
    return _late_rate(df, "platform", spec.threshold_min, unknown_count)


def percentiles_by_macro(
    fact: DataFrame, spec: FilterSpec | None = None, method: str = "exact", slices: int | None = None
) -> DataFrame:
    """macro_bairro, mean, p50, p75, p90, count of delivery minutes
    (linear interpolation); highest p90 first. ``slices`` fixes the number of
    range slices of the exact method (default: by the counted rows)."""
    df = _filtered(fact, spec)
    require(df, "macro_bairro", DELIVERY)
    rows = _delivery_rows(df, F.col("macro_bairro"), "macro_bairro")
    q = group_quantiles(
        rows, ["macro_bairro"], "delivery_minutes", PERCENTILE_PROBS, method=method, with_mean=True, slices=slices
    )
    return q.select("macro_bairro", "mean", "p50", "p75", "p90", "count").orderBy(
        *by_measure_desc("p90", "macro_bairro")
    )


def _weekday_rows(df: DataFrame) -> DataFrame:
    require(df, "order_datetime", DELIVERY)
    return _delivery_rows(df, weekday_mon0(F.col("order_datetime")), "weekday")


def delivery_by_weekday(fact: DataFrame, spec: FilterSpec | None = None, method: str = "exact") -> DataFrame:
    """weekday (Monday = 0), count, min, q1, median, q3, max of delivery minutes."""
    rows = _weekday_rows(_filtered(fact, spec))
    return group_quantiles(rows, ["weekday"], "delivery_minutes", BOX_PROBS, method=method).orderBy("weekday")


def delivery_values_by_weekday(fact: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """Long form: weekday, delivery_minutes."""
    return _weekday_rows(_filtered(fact, spec))


def avg_delivery_by_hour(fact: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """hour, avg_delivery_minutes."""
    df = _filtered(fact, spec)
    require(df, "order_datetime", DELIVERY)
    return (
        _delivery_rows(df, F.hour("order_datetime"), "hour")
        .groupBy("hour")
        .agg(F.avg("delivery_minutes").alias("avg_delivery_minutes"))
        .orderBy("hour")
    )


def heatmap_hour_weekday(
    fact: DataFrame, spec: FilterSpec | None = None, metric: str = "avg_delivery_minutes"
) -> DataFrame:
    """hour, weekday, value = mean delivery minutes, or mean delay when
    ``metric == 'avg_delay'``."""
    df = _filtered(fact, spec)
    require(df, "order_datetime", DELIVERY)
    if metric == "avg_delay":
        require(df, ETA)
        v = F.col(DELIVERY) - F.col(ETA)
    else:
        v = F.col(DELIVERY)
    ts = F.col("order_datetime")
    return (
        df.select(F.hour(ts).alias("hour"), weekday_mon0(ts).alias("weekday"), v.alias("_v"))
        .where(F.col("hour").isNotNull() & F.col("_v").isNotNull())
        .groupBy("hour", "weekday")
        .agg(F.avg("_v").alias("value"))
        .orderBy("weekday", "hour")
    )
