"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderscope.session import ensure_checkpoint_dir

LOC = ("__loc_file", "__loc_row")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their
    Python workers can import it whatever folder they start in."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="orderscope-py-"), "orderscope_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/orderscope_llm/{uuid.uuid4().hex}/{name}"


def materialise(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and
    a lost executor costs no recomputation."""
    path = shared_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_session(spark: SparkSession, **conf: str) -> SparkSession:
    """A sibling session (same application) with its own settings, so that the
    caller's settings stay as they are. Shuffle files are dropped as soon as a
    written intermediate no longer needs them."""
    own = spark.newSession()
    for key in (
        "spark.sql.shuffle.partitions",
        "spark.sql.session.timeZone",
        "spark.sql.files.maxPartitionBytes",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes",
        "spark.sql.adaptive.coalescePartitions.enabled",
        "spark.sql.autoBroadcastJoinThreshold",
    ):
        value = spark.conf.get(key, None)
        if value is not None:
            own.conf.set(key, value)
    for key, value in conf.items():
        own.conf.set(key, value)
    return own


def located(spark: SparkSession, docs: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(docs, docs.select(columns) + locator)``.

    The locator of a row is the 64-bit hash of its file's path and its row
    number in that file: stable across scans, unique even for repeated rows
    and null ids. Input that is not a plain file scan is written to the shared
    folder first and the returned ``docs`` is that copy. Own columns of ``docs``
    named like the locator don't get in its way."""
    try:
        return docs, docs.select(*columns, *_locator(docs))
    except AnalysisException:
        docs = materialise(spark, docs, "input")
        return docs, docs.select(*columns, *_locator(docs))


def _locator(docs: DataFrame) -> list[Column]:
    file = docs.metadataColumn("_metadata")
    return [F.xxhash64(file["file_path"]).alias(LOC[0]), file["row_index"].alias(LOC[1])]


def located_files(docs: DataFrame) -> DataFrame:
    """``(file hash of the locator, path)`` of the files that ``docs`` reads."""
    path = docs.metadataColumn("_metadata")["file_path"]
    return docs.select(F.xxhash64(path).alias(LOC[0]), path.alias("path")).distinct()


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` (a file scan) without the rows at the locators ``gone``. The row
    travels as one struct, so its columns may have any names."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_locator(docs))
    return whole.join(gone, list(LOC), "left_anti").select(*[F.col(f"row.`{c}`") for c in docs.columns])


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``(node, component)`` for undirected ``edges(a, b)``; component is the
    smallest node. Alternating large-star and small-star rounds: every round is
    a shuffle of the edges, each is written to the shared folder, and only the
    number of edges and two digests of them reach the driver. The smallest neighbour of a node is
    found by a partially aggregated min, so a hub costs no large task."""
    current = materialise(
        spark,
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    # A set of edges by its size and two 64-bit digests: one partial row per task.
    digests = [F.bit_xor(F.xxhash64("a", "b", F.lit(i))) for i in (1, 2)]
    known = current.agg(F.count(F.lit(1)), *digests).first()
    while True:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        after = materialise(spark, small.where("a <> b").distinct(), "edges")
        found = after.agg(F.count(F.lit(1)), *digests).first()
        current, same, known = after, found == known, found
        if same:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
