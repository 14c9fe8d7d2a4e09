"""Exact per-group quantiles (linear interpolation) without holding a group
in one task.

``percentile`` keeps a map of every distinct value of a group in one
aggregation buffer, and a window ordered inside a group sends the whole
group to one task; both break when one key holds a third of the data. This
operator is a distributed rank selection instead:

1. ``(key, value) → count`` (partial aggregation collapses repeated values);
2. range-partition those pairs on ``(key, value)`` so a hot key is spread
   over many tasks, each holding a contiguous slice of its sorted values;
3. inside each slice, a running count gives each value's rank range relative
   to the slice (the window is keyed on ``(slice, key)``: bounded by the
   slice size, not the group size);
4. slice totals (at most ``slices + keys`` rows) give each slice's offset
   within its key;
5. the one or two values at ranks ``floor(p·(n−1))`` and the next are picked
   by a filter, and interpolated:
   ``q = a + (b − a)·t`` (or ``b − (b − a)·(1 − t)`` for ``t ≥ 0.5``).

Memory per task is bounded by the slice size for any key distribution;
the number of slices follows the input's estimated size (``sizing.py``).
The slice exchange is a ``repartitionByRange(n)`` (AQE never coalesces or
splits such a user-sized shuffle). Its bounds are sampled, so the sliced and
windowed frame is checkpointed to the shared checkpoint folder before its
two consumers (slice totals, rank filter) read it: both see the same slices
by construction, not by exchange reuse, and a lost executor cannot re-slice.
With ``with_mean`` the group mean ``Σ v·c / Σ c`` comes from the same slice
totals (no second pass over the rows).
``method="approx"`` uses ``percentile_approx`` (one pass, bounded sketch);
``method="buffer"`` uses Spark's exact ``percentile`` (fast for few distinct
values per group, unbounded for many).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderscope.operators.sizing import slice_count
from orderscope.session import ensure_checkpoint_dir

METHODS = ("exact", "buffer", "approx")


def _lerp(a: Column, b: Column, t: Column) -> Column:
    diff = b - a
    return F.when(t >= 0.5, b - diff * (F.lit(1.0) - t)).otherwise(a + diff * t)


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    method: str = "exact",
    slices: int | None = None,
    approx_accuracy: int = 10_000,
    with_mean: bool = False,
) -> DataFrame:
    """Return ``keys + [count] + one column per name in probs`` (+ ``mean``).

    Rows with a NULL value are ignored; NULL keys are kept as a group (the
    caller filters them if its semantics drop them). ``count`` is the number
    of non-null values of the group (bigint)."""
    keys = list(keys)
    for name, p in probs.items():
        if not (0.0 <= float(p) <= 1.0):
            raise ValueError(f"probability for {name} must be in [0, 1]")
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    mean = [F.avg("_v").alias("mean")] if with_mean else []
    if method == "buffer":
        return rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("count"),
            *mean,
            *[F.percentile(F.col("_v"), float(p)).alias(name) for name, p in probs.items()],
        )
    if method == "approx":
        return rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("count"),
            *mean,
            *[F.percentile_approx(F.col("_v"), float(p), approx_accuracy).cast("double").alias(name)
              for name, p in probs.items()],
        )
    return _exact(rows, keys, probs, slices, with_mean)


def _exact(
    rows: DataFrame, keys: list[str], probs: Mapping[str, float], slices: int | None, with_mean: bool
) -> DataFrame:
    spark = rows.sparkSession
    distinct = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    n_slices = slices or slice_count(rows)
    order = [F.col(k).asc_nulls_last() for k in keys] + [F.col("_v").asc()]
    ranged = distinct.repartitionByRange(n_slices, *order).withColumn("_s", F.spark_partition_id())

    # Running count before each value inside its (slice, key) block, and the
    # block total, from one window partitioning (one exchange).
    # Explicitly n_slices partitions, whatever the session's number.
    block = Window.partitionBy("_s", *keys)
    ranged = ranged.repartition(n_slices, "_s", *keys).select(
        *keys,
        "_s",
        "_v",
        "_c",
        F.coalesce(F.sum("_c").over(block.orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(
            "_before"
        ),
        F.sum("_c").over(block).alias("_sc"),
        F.sum(F.col("_v") * F.col("_c")).over(block).alias("_ssum"),
    )
    # The slices feed two consumers (slice totals and the rank filter) and
    # their bounds are sampled: checkpoint them to the shared folder so both
    # read the very same slices (and an executor loss cannot re-slice).
    ensure_checkpoint_dir(spark)
    ranged = ranged.checkpoint(eager=True)
    # One row per (slice, key). Keys are renamed for the join.
    tk = {k: f"_t_{i}" for i, k in enumerate(keys)}
    slice_tot = ranged.groupBy("_s", *keys).agg(F.first("_sc").alias("_sc"), F.first("_ssum").alias("_ssum"))
    by_key = Window.partitionBy(*keys)
    slice_tot = slice_tot.select(
        F.col("_s").alias("_ts"),
        *[F.col(k).alias(tk[k]) for k in keys],
        F.coalesce(
            F.sum("_sc").over(by_key.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_off"),
        F.sum("_sc").over(by_key).alias("_n"),
        (F.sum("_ssum").over(by_key) / F.sum("_sc").over(by_key)).alias("_mean"),
    )
    # Null-safe on the keys: a NULL key is a group of its own.
    cond = [F.col("_s") == F.col("_ts")] + [F.col(k).eqNullSafe(F.col(tk[k])) for k in keys]
    placed = ranged.join(slice_tot, cond, "inner").select(
        *keys,
        "_v",
        (F.col("_off") + F.col("_before")).alias("_lo"),
        (F.col("_off") + F.col("_before") + F.col("_c")).alias("_hi"),
        "_n",
        "_mean",
    )
    n = F.col("_n")
    wanted = []
    for name, p in probs.items():
        h = (n - 1).cast("double") * F.lit(float(p))
        i0 = F.floor(h)
        i1 = F.least(i0 + 1, n - 1)
        wanted.append(F.struct(F.lit(name).alias("q"), F.lit(0).alias("side"), i0.alias("pos")))
        wanted.append(F.struct(F.lit(name).alias("q"), F.lit(1).alias("side"), i1.alias("pos")))
    hits = placed.select(
        *keys,
        "_n",
        "_mean",
        "_v",
        F.explode(
            F.filter(F.array(*wanted), lambda w: (w["pos"] >= F.col("_lo")) & (w["pos"] < F.col("_hi")))
        ).alias("_w"),
    )
    picked = hits.groupBy(*keys, "_n", "_mean").agg(
        *[
            F.max(F.when((F.col("_w.q") == name) & (F.col("_w.side") == side), F.col("_v"))).alias(f"{name}__{side}")
            for name in probs
            for side in (0, 1)
        ]
    )
    out = [F.col(k) for k in keys] + [F.col("_n").cast("bigint").alias("count")]
    if with_mean:
        out.append(F.col("_mean").alias("mean"))
    for name, p in probs.items():
        h = (F.col("_n") - 1).cast("double") * F.lit(float(p))
        t = h - F.floor(h)
        out.append(_lerp(F.col(f"{name}__0"), F.col(f"{name}__1"), t).alias(name))
    return picked.select(*out)
