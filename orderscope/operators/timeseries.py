"""Bucketed time series with gap filling, for any calendar offset.

Shape of the plan: filter rows with a timestamp → unit number per row
(codegen, ``functions/buckets``) → hash aggregate per bucket (partial + final
around one shuffle) → each bucket learns the next non-empty bucket (``lead``) →
``posexplode(sequence(unit, next − step))`` emits the bucket itself (position
0, with its measures) followed by the empty buckets up to the next one (fill
values). One scan, one pipeline, no join. A multiple of a unit without an
origin first reads the least timestamp (one row reaches the driver).

The ``lead`` window runs over the bucket aggregate, whose size is the number
of non-empty buckets (bounded by the time span, never by the row count), in
one partition; that partition is already in bucket order, so the final sort
needs no further exchange.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderscope.functions.buckets import Offset, bucket_bounds, bucket_unit, origin_unit, parse_offset, unit_index, unit_label

_UNIT = "_bucket_unit"


def _origin(df: DataFrame, ts_col: str, off: Offset, origin: _dt.date | None) -> Column:
    if off.n == 1:
        return F.lit(0)
    if origin is None:
        origin = df.agg(F.min(ts_col).alias("first")).first()["first"] or _dt.date(1970, 1, 1)
    return origin_unit(off, origin)


def bucketed_series(
    df: DataFrame,
    ts_col: str,
    freq: str,
    measures: Mapping[str, Column],
    fill: Mapping[str, object] | None = None,
    label: str = "date",
    origin: _dt.date | None = None,
    bounds: bool = False,
) -> DataFrame:
    """One row per bucket from the first to the last non-empty bucket.

    ``measures`` are aggregate expressions; ``fill`` gives the value an
    empty bucket gets per measure (missing key → NULL stays NULL). With
    ``bounds`` each bucket also has ``bucket_start`` and ``bucket_end`` (the next
    bucket's start) and ``step``, its place in the series from 0."""
    off = parse_offset(freq)
    fill = dict(fill or {})
    unit = bucket_unit(unit_index(F.col(ts_col), off), off, _origin(df, ts_col, off, origin))
    rows = df.where(F.col(ts_col).isNotNull()).withColumn(_UNIT, unit)
    agg = rows.groupBy(_UNIT).agg(*[expr.alias(name) for name, expr in measures.items()])
    order = Window.orderBy(_UNIT)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.coalesce(F.col("_next") - off.n, F.col(_UNIT))
    filled = agg.select("*", F.lead(_UNIT).over(order).alias("_next"), F.min(_UNIT).over(whole).alias("_first")).select(
        "*", F.posexplode(F.sequence(F.col(_UNIT), last, F.lit(off.n).cast("bigint"))).alias("_pos", "_bucket")
    )
    out_cols = [unit_label(F.col("_bucket"), off).alias(label)]
    if bounds:
        start, end = bucket_bounds(F.col("_bucket"), off)
        step = ((F.col("_bucket") - F.col("_first")) / F.lit(off.n)).cast("bigint")
        out_cols += [start.alias("bucket_start"), end.alias("bucket_end"), step.alias("step")]
    for name in measures:
        empty = F.lit(fill[name]) if fill.get(name) is not None else F.lit(None)
        out_cols.append(F.when(F.col("_pos") == 0, F.col(name)).otherwise(empty.cast(agg.schema[name].dataType)).alias(name))
    return filled.select(*out_cols).orderBy(label)
