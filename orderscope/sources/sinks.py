"""Writing datasets out.

Datasets are DataFrames; small ones can be collected by the caller, and the
row-level ones (scatter plots, value lists, pages) should be written where
they are computed. Writes go to shared storage and are committed by Spark's
output committer, so a lost executor only reruns its own tasks. A page and
its metadata (``explore.page`` / ``explore.page_meta``) are two outputs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

SINK_FORMATS = ("parquet", "json", "csv", "table")


def write_dataset(
    df: DataFrame,
    target: str,
    fmt: str = "parquet",
    mode: str = "overwrite",
    partition_by: Sequence[str] | None = None,
) -> None:
    """Write ``df`` to a path (parquet/json/csv) or a catalogue table."""
    if fmt not in SINK_FORMATS:
        raise ValueError(f"format must be one of {SINK_FORMATS}")
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "table":
        writer.saveAsTable(target)
    elif fmt == "parquet":
        writer.parquet(target)
    elif fmt == "json":
        writer.json(target)
    else:
        writer.option("header", "true").csv(target)
