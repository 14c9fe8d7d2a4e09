"""Equal-width histogram over [min, max] with empty bins kept.

Semantics (the usual numeric-library rule): ``bins`` equal-width bins,
edges ``lo + i·((hi − lo)/bins)`` with the last edge exactly ``hi``; every
bin is half-open except the last, which is closed. A constant input is
widened to ``[v − 0.5, v + 0.5]``. The bin of ``x`` is
``trunc(((x − lo)/(hi − lo))·bins)``, then moved by one where floating
point put ``x`` outside its bin's own edges.

Plan: one global min/max/count aggregate (partial aggregation, one
bounded row fetched to the driver: the bounds are needed as literals to
build the bin expression) → bin id per row (codegen) → count per bin
(partial aggregation; at most ``bins`` groups) → left join from the bin
spine (``bins`` ≤ 100 rows). No row-level data leaves the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIST_SCHEMA = T.StructType(
    [
        T.StructField("bin_start", T.DoubleType()),
        T.StructField("bin_end", T.DoubleType()),
        T.StructField("count", T.LongType()),
    ]
)


def histogram_edges(lo: float, hi: float, bins: int) -> list[float]:
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    step = (hi - lo) / bins
    edges = [i * step + lo for i in range(bins)]
    edges.append(hi)
    return edges


def left_out(df: DataFrame, value: str) -> DataFrame:
    """binned, infinite, missing: how many values of ``value`` the histogram
    puts into bins, and how many it can't (±infinity; NULL or NaN)."""
    x = F.col(f"`{value}`").cast("double")
    missing = x.isNull() | F.isnan(x)
    infinite = F.abs(x) == F.lit(float("inf"))
    return df.agg(
        F.count_if(~missing & ~infinite).alias("binned"),
        F.count_if(~missing & infinite).alias("infinite"),
        F.count_if(missing).alias("missing"),
    )


def equal_width_histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Histogram of the finite, non-null values of ``value``;
    ``left_out`` counts the others."""
    if not (isinstance(bins, int) and bins >= 1):
        raise ValueError("bins must be a positive integer")
    spark = df.sparkSession
    v = F.col(value)
    finite = df.select(v.cast("double").alias("_x")).where(
        F.col("_x").isNotNull() & ~F.isnan("_x") & (F.abs("_x") != F.lit(float("inf")))
    )
    bounds = finite.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi")).first()
    if bounds is None or bounds["lo"] is None:
        return spark.createDataFrame([], HIST_SCHEMA)
    edges = histogram_edges(float(bounds["lo"]), float(bounds["hi"]), bins)
    lo, hi = edges[0], edges[-1]
    assert math.isfinite(lo) and math.isfinite(hi)
    edge_arr = F.array(*[F.lit(e) for e in edges])

    def edge(i):  # 0-based edge lookup
        return F.element_at(edge_arr, i + F.lit(1))

    raw = ((F.col("_x") - F.lit(lo)) / F.lit(hi - lo)) * F.lit(float(bins))
    idx0 = F.least(raw.cast("int"), F.lit(bins - 1))
    idx1 = F.when(F.col("_x") < edge(idx0), idx0 - 1).otherwise(idx0)
    idx2 = F.when((F.col("_x") >= edge(idx1 + 1)) & (idx1 != bins - 1), idx1 + 1).otherwise(idx1)
    counts = finite.select(idx2.alias("_bin")).groupBy("_bin").agg(F.count(F.lit(1)).alias("count"))
    spine = spark.range(bins).select(F.col("id").cast("int").alias("_bin"))
    return (
        spine.join(counts, "_bin", "left")
        .select(
            edge(F.col("_bin")).alias("bin_start"),
            edge(F.col("_bin") + 1).alias("bin_end"),
            F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"),
        )
        .orderBy("bin_start")
    )
