"""Per-group value lists as sorted, run-length coded chunks of bounded size.

A box plot wants the list of a group's values. One array per group would put an
unbounded group into one row; here a group is a numbered series of chunks, each
an array of at most ``chunk`` runs ``(value, count, upto)`` in ascending order
of value. ``upto`` is the rank after the run's last copy, so a chunk knows which
ranks and (``low`` .. ``high``) which values it holds: a percentile or a range is
read from the one or two chunks that hold it, also from chunks that were written
to a table, whose row groups the bounds prune.

Plan: (key, value) counts (partial aggregation collapses repeated values) →
range partitions of (key, value), so a hot key is spread over slices → running
counts inside each (slice, key) block → offsets from one row per (slice, key) →
chunks. No task holds more than a slice or a chunk of a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderscope.operators.quantiles import _lerp
from orderscope.operators.sizing import slice_count
from orderscope.session import ensure_checkpoint_dir

CHUNK = 4096


def value_chunks(
    df: DataFrame, keys: Sequence[str], value: str, chunk: int = CHUNK, slices: int | None = None
) -> DataFrame:
    """keys, chunk (from 0), first_rank, n (values in the chunk), low, high,
    runs. Rows with a NULL key are left out; a group without a value is kept as
    one empty chunk."""
    if chunk < 1:
        raise ValueError("chunk must be >= 1")
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"))
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    counted = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    # Counted once for the slices, their totals and the empty groups.
    ensure_checkpoint_dir(df.sparkSession)
    counted = counted.checkpoint(eager=True)
    pairs = counted.where(F.col("_v").isNotNull())
    n = slices or slice_count(pairs)
    order = [F.col(k).asc() for k in keys] + [F.col("_v").asc()]
    block = Window.partitionBy("_s", *keys).orderBy("_v")
    # Range bounds are sampled: checkpointed, so that both readers see the same slices.
    placed = (
        pairs.repartitionByRange(n, *order)
        .withColumn("_s", F.spark_partition_id())
        .withColumn("_place", F.row_number().over(block))
        .withColumn("_upto", F.sum("_c").over(block.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .checkpoint(eager=True)
    )
    totals = placed.groupBy("_s", *keys).agg(F.count(F.lit(1)).alias("_runs"), F.sum("_c").alias("_values"))
    before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # one row per (slice, key)
    zero = F.lit(0)
    starts = totals.select(
        "_s", *keys, F.coalesce(F.sum("_runs").over(before), zero).alias("_runs_before"),
        F.coalesce(F.sum("_values").over(before), zero).alias("_values_before"),
    )
    numbered = placed.join(starts, ["_s", *keys]).select(
        *keys,
        F.expr(f"(_runs_before + _place - 1) div {int(chunk)}").cast("int").alias("chunk"),
        F.struct(F.col("_v").alias("value"), F.col("_c").alias("count"), (F.col("_values_before") + F.col("_upto")).alias("upto")).alias("_run"),
    )
    held = numbered.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list("_run")).alias("runs"), F.sum("_run.count").alias("n"))
    first, last = F.element_at("runs", 1), F.element_at("runs", -1)
    full = held.select(
        *keys, "chunk", (last["upto"] - F.col("n")).alias("first_rank"), "n", first["value"].alias("low"), last["value"].alias("high"), "runs"
    )
    empty = counted.groupBy(*keys).agg(F.count("_v").alias("_some")).where("_some = 0")
    none = F.lit(None).cast("double")
    nothing = empty.select(
        *keys, F.lit(0).alias("chunk"), F.lit(0).cast("bigint").alias("first_rank"), F.lit(0).cast("bigint").alias("n"),
        none.alias("low"), none.alias("high"), F.expr(f"CAST(array() AS {full.schema['runs'].dataType.simpleString()})").alias("runs"),
    )
    return full.unionByName(nothing)


def _at_rank(rank: Column) -> Column:
    """The value at a rank that a chunk holds."""
    return F.filter("runs", lambda r: r["upto"] > rank)[0]["value"]


def percentiles_from_chunks(chunks: DataFrame, keys: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """keys, count, one column per name in ``probs``: the same values as
    ``group_quantiles``. Only chunk rows are read: one aggregate for the group's
    length, and the runs of the chunks that hold a wanted rank."""
    keys = list(keys)
    for name, p in probs.items():
        if not (0.0 <= float(p) <= 1.0):
            raise ValueError(f"probability for {name} must be in [0, 1]")
    size = chunks.groupBy(*keys).agg(F.sum("n").alias("_n")).where("_n > 0")
    held = chunks.where("n > 0").join(size, keys)
    picks = []
    for i, p in enumerate(probs.values()):
        for side in (0, 1):
            at = F.floor((F.col("_n") - 1).cast("double") * F.lit(float(p)))
            at = F.least(at + side, F.col("_n") - 1)
            inside = (at >= F.col("first_rank")) & (at < F.col("first_rank") + F.col("n"))
            picks.append(F.max(F.when(inside, _at_rank(at))).alias(f"_q{i}_{side}"))
    picked = held.groupBy(*keys, "_n").agg(*picks)
    out = [F.col(k) for k in keys] + [F.col("_n").alias("count")]
    for i, (name, p) in enumerate(probs.items()):
        h = (F.col("_n") - 1).cast("double") * F.lit(float(p))
        out.append(_lerp(F.col(f"_q{i}_0"), F.col(f"_q{i}_1"), h - F.floor(h)).alias(name))
    return picked.select(*out)


def count_between(chunks: DataFrame, keys: Sequence[str], low: float, high: float) -> DataFrame:
    """keys, count of the values in ``low .. high`` (both inside), groups
    without one too. Chunks outside are skipped by their bounds."""
    inside = F.filter("runs", lambda r: (r["value"] >= low) & (r["value"] <= high))
    n = F.aggregate(inside, F.lit(0).cast("bigint"), lambda total, r: total + r["count"])
    some = (F.col("high") >= low) & (F.col("low") <= high)
    return chunks.groupBy(*keys).agg(F.coalesce(F.sum(F.when(some, n)), F.lit(0)).alias("count"))


def expand(chunks: DataFrame, keys: Sequence[str], name: str = "value") -> DataFrame:
    """Back to one row per value, in any order, distributed."""
    runs = chunks.select(*keys, F.explode("runs").alias("_r"))
    return runs.select(*keys, F.col("_r.value").alias(name), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_r.count"))).alias("_copy")).drop("_copy")
