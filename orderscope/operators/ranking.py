"""Deterministic ordering, top-n and paging.

Spark has no row order, so every sort ends with a tie-break on the group
key (or a row key) to make top-n boundaries and pages reproducible. NULLs
sort last in both directions. A ``limit`` after ``orderBy`` is planned as
``TakeOrderedAndProject``: each task keeps its own top n, which is right for
the small top-n lists over aggregated groups. A page over raw rows, shallow
or deep, numbers the rows in a distributed way (range slices of the total
order, positions inside each sorted slice, slice offsets from a table with
one row per slice) and keeps only the page: no task holds more than a slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderscope.operators.sizing import slice_count
from orderscope.session import ensure_checkpoint_dir

# monotonically_increasing_id() keeps the row's position in its partition in
# the lower 33 bits.
POSITION_MASK = (1 << 33) - 1


def by_measure_desc(measure: str, *keys: str) -> list[Column]:
    return [F.col(measure).desc_nulls_last()] + [F.col(k).asc_nulls_last() for k in keys]


def by_keys(*keys: str) -> list[Column]:
    return [F.col(k).asc_nulls_last() for k in keys]


def top_n(df: DataFrame, n: int | None, order: list[Column]) -> DataFrame:
    """Sorted frame, cut to ``n`` rows when ``n`` is given. ``n`` must not be
    negative; 0 yields no rows."""
    if n is None:
        return df.orderBy(*order)
    if n < 0:
        raise ValueError("top_n must not be negative")
    return df.orderBy(*order).limit(int(n))


def page(df: DataFrame, order: list[Column], offset: int, limit: int, slices: int | None = None) -> DataFrame:
    """Rows ``offset .. offset + limit − 1`` of ``df`` in ``order``, which
    must be a total order (end it with a unique row key). Project ``df`` to
    the wanted and ordering columns first: they are what the range shuffle
    moves and the checkpoint holds."""
    if offset < 0:
        raise ValueError("offset must be >= 0")
    if not (1 <= limit <= 5000):
        raise ValueError("limit must be within 1..5000")
    n = slices or slice_count(df)
    cols = [F.col(f"`{c}`") for c in df.columns]
    # Slice id = range partition of the total order; the position is taken
    # inside the sorted partition, so the range shuffle is the only one. The
    # slices feed two consumers (slice totals and the page filter) and their
    # bounds are sampled, so they are checkpointed to the shared folder: both
    # read the very same slices, also after losing an executor.
    ensure_checkpoint_dir(df.sparkSession)
    numbered = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .select(
            *cols,
            F.spark_partition_id().alias("_s"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(POSITION_MASK)).alias("_r"),
        )
        .checkpoint(eager=True)
    )
    totals = numbered.groupBy("_s").agg(F.count(F.lit(1)).alias("_sn"))
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    starts = totals.select(F.col("_s").alias("_ts"), "_sn", F.coalesce(F.sum("_sn").over(before), F.lit(0)).alias("_off"))
    # only the slices that hold a part of the page are joined
    starts = starts.where((F.col("_off") < F.lit(offset + limit)) & (F.col("_off") + F.col("_sn") > F.lit(offset)))
    pos = F.col("_off") + F.col("_r")
    return (
        numbered.join(starts, F.col("_s") == F.col("_ts"))
        .where((pos >= F.lit(offset)) & (pos < F.lit(offset + limit)))
        .orderBy(pos)
        .select(*cols)
    )
