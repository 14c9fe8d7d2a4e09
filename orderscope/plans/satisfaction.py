"""Customer satisfaction dashboard datasets.

The satisfaction filter always keeps only scores within 1..5 (NULL scores
leave), so every dataset here sees scored orders only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderscope.functions.expressions import datetime_text, text_key
from orderscope.operators.filters import FilterSpec, apply_filters
from orderscope.operators.ranking import by_keys, by_measure_desc
from orderscope.operators.timeseries import bucketed_series
from orderscope.sources.columns import has, require

VARIANT = "satisfaction"
SCORE = "satisfacao_nivel"


def _filtered(fact: DataFrame, spec: FilterSpec | None) -> DataFrame:
    return apply_filters(fact, spec, VARIANT)


def kpis(fact: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """One row: nivel_medio, pct_muito_satisfeitos (% of scores ≥ 4.5),
    total_avaliacoes, periodo_min / periodo_max as text."""
    df = _filtered(fact, spec)
    require(df, SCORE)
    s = F.col(SCORE)
    n = F.count(F.lit(1))
    dt_min = F.min("order_datetime") if has(df, "order_datetime") else F.lit(None).cast("timestamp_ntz")
    dt_max = F.max("order_datetime") if has(df, "order_datetime") else F.lit(None).cast("timestamp_ntz")
    row = df.agg(
        n.alias("_rows"),
        F.avg(s).alias("_mean"),
        F.avg(F.when(s >= 4.5, 1.0).when(s.isNotNull(), 0.0)).alias("_share"),
        F.count(s).alias("total_avaliacoes"),
        dt_min.alias("_dmin"),
        dt_max.alias("_dmax"),
    )
    any_rows = F.col("_rows") > 0
    return row.select(
        F.when(any_rows, F.col("_mean")).otherwise(F.lit(0.0)).alias("nivel_medio"),
        F.when(any_rows, F.col("_share") * 100.0).otherwise(F.lit(0.0)).alias("pct_muito_satisfeitos"),
        "total_avaliacoes",
        datetime_text(F.col("_dmin")).alias("periodo_min"),
        datetime_text(F.col("_dmax")).alias("periodo_max"),
    )


def _score_by(df: DataFrame, key: str) -> DataFrame:
    require(df, key, SCORE)
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.avg(SCORE).alias("avg_satisfacao"), F.count(SCORE).alias("count"))
    )


def by_macro(fact: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """macro_bairro, avg_satisfacao, count; best first."""
    return _score_by(_filtered(fact, spec), "macro_bairro").orderBy(
        *by_measure_desc("avg_satisfacao", "macro_bairro")
    )


def by_platform(fact: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """platform, avg_satisfacao, count; in platform order."""
    return _score_by(_filtered(fact, spec), "platform").orderBy(*by_keys("platform"))


def scatter_time_score(fact: DataFrame, spec: FilterSpec | None = None, prune_empty: bool = False) -> DataFrame:
    """order_id, date (text), platform, macro_bairro, delivery_minutes,
    satisfacao, eta_minutes for every order with a delivery time and a
    score. The schema is fixed: an absent role is a NULL column. With
    ``prune_empty`` the optional columns that are NULL on every row are
    dropped (one extra aggregate job; the schema then depends on the data)."""
    df = _filtered(fact, spec)
    require(df, "actual_delivery_minutes", SCORE)

    def opt(role, expr=None, typ="string"):
        return (expr if expr is not None else F.col(role)) if has(df, role) else F.lit(None).cast(typ)

    out = df.where(F.col("actual_delivery_minutes").isNotNull() & F.col(SCORE).isNotNull()).select(
        opt("order_id").alias("order_id"),
        opt("order_datetime", datetime_text(F.col("order_datetime"))).alias("date"),
        opt("platform", text_key("platform")).alias("platform"),
        opt("macro_bairro", text_key("macro_bairro")).alias("macro_bairro"),
        F.col("actual_delivery_minutes").alias("delivery_minutes"),
        F.col(SCORE).alias("satisfacao"),
        opt("eta_minutes_quote", typ="double").alias("eta_minutes"),
    )
    if not prune_empty:
        return out
    optional = ["order_id", "platform", "macro_bairro", "eta_minutes"]
    counts = out.agg(*[F.count(c).alias(c) for c in optional]).first()
    return out.drop(*[c for c in optional if counts[c] == 0])


def timeseries(fact: DataFrame, spec: FilterSpec | None = None, freq: str = "M") -> DataFrame:
    """date, avg_satisfacao, count; empty buckets give 0 for both."""
    df = _filtered(fact, spec)
    require(df, "order_datetime", SCORE)
    rows = df.where(F.col(SCORE).isNotNull())
    return bucketed_series(
        rows,
        "order_datetime",
        freq,
        {"avg_satisfacao": F.avg(SCORE), "count": F.count(SCORE)},
        fill={"avg_satisfacao": 0.0, "count": 0},
    )
