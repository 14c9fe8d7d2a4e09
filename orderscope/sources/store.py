"""Materialised canonical facts: build once from the raw tables, query many.

A dashboard runs dozens of datasets over the same fact. Rebuilding the fact
(four-table join plus a lineitem aggregate) for each of them repeats the
most expensive shuffles, so the fact is written once as Parquet under the
shared folder named by ``spark.checkpoint.dir`` and every dataset reads it:

* files are range-partitioned and sorted on ``(order_datetime, order_id)``,
  so Parquet row-group statistics prune date-filtered scans
  (``PushedFilters``); the order id in the range key splits a timestamp
  shared by a huge number of orders over many files instead of one task;
* the file count follows the counted rows of the driving table (one fact row
  per order / event), and is at least one file per core so small tables still
  scan in parallel;
* optionally partitioned by ``order_month`` (directory pruning; the filter
  builder adds the matching partition predicate), written from the stored
  fact; the variant with nulls is a projection of the stored fact;
* the table location is keyed by the mapping code and by the name, size and
  modification time of every source file, nested ones too. The key is taken
  anew at every call (one Spark job over the file listing), so a changed
  source gives a new table, never a stale one. A table superseded this way
  stays where it is, since a running query may be reading it;
* a build writes to a private temporary folder that is then renamed, so on a
  file system whose folder rename is atomic (local, NFS, HDFS) a reader never
  sees a half-written table, and the loser of two concurrent builders uses the
  winner's. On a store without such a rename keep the fact in a catalogue
  table instead (``sinks.write_dataset(fmt="table")``, ``read_orders``);
* it lives on shared storage, so losing an executor loses nothing (no
  ``cache()`` / local checkpoint whose blocks die with the executor).
"""

from __future__ import annotations

import hashlib
import inspect
import math
import threading
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderscope.session import ensure_checkpoint_dir
from orderscope.sources import mapping as _mapping
from orderscope.sources.mapping import blank_some, events_fact, star_fact, table

# Source tables read by each stored mapping; the first one drives the row count.
MAPPING_TABLES = {
    "star": ("orders", "lineitem", "customer", "nation"),
    "events": ("events",),
}
BUILDERS = {"star": star_fact, "events": events_fact}
ROWS_PER_FILE = 2_000_000


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def _source_signature(spark: SparkSession, sf_dir: str, tables: tuple[str, ...]) -> str:
    """Digest of the mapping code and of (path, size, mtime) of every source
    file at any depth. The listing is a Spark scan whose content column is
    pruned, so no file is opened."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load([f"{sf_dir.rstrip('/')}/{t}.parquet" for t in tables])
        .agg(
            F.count(F.lit(1)),
            F.sum("length"),
            F.max("modificationTime").cast("string"),
            F.bit_xor(F.xxhash64("path", "length", F.unix_micros("modificationTime"))),
        )
        .first()
    )
    code = inspect.getsource(_mapping) + inspect.getsource(write_fact)
    return hashlib.sha1(f"{sf_dir.rstrip('/')}|{tuple(files)}|{code}".encode()).hexdigest()[:16]


def fact_key(spark: SparkSession, sf_dir: str, mapping: str = "star") -> str:
    """Names the version of a stored fact: another one whenever a source file
    or the mapping changes."""
    base = "star" if mapping == "star_nulls" else mapping
    return f"{mapping}-{_source_signature(spark, sf_dir, MAPPING_TABLES[base])}"


def _known(spark: SparkSession, path: str) -> tuple[str, str, str]:
    return spark.sparkContext.applicationId, spark._jsparkSession.sessionUUID(), path


def _facts(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/orderscope_facts"


def fact_folder(spark: SparkSession, sf_dir: str, mapping: str = "star") -> str:
    """Where a stored fact lies; it is built if need be."""
    key = fact_key(spark, sf_dir, mapping)
    materialised_fact(spark, sf_dir, mapping, key=key)
    return _PATHS[_known(spark, f"{_facts(spark)}/{key}")]


def table_key(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Names the version of a driver table."""
    return f"{name}-{_source_signature(spark, sf_dir, (name,))}"


def _committed(spark: SparkSession, path: str) -> bool:
    fs, jpath = _fs(spark, path.rstrip("/") + "/_SUCCESS")
    return bool(fs.exists(jpath))


def _publish(spark: SparkSession, tmp: str, path: str) -> None:
    """Rename a finished build into place; if another builder won, keep its
    table and drop ours (a Hadoop rename onto an existing folder would nest
    the source inside it, so existence is checked first)."""
    fs, src = _fs(spark, tmp)
    _, dst = _fs(spark, path)
    fs.mkdirs(dst.getParent())
    if not fs.exists(dst) and fs.rename(src, dst):
        return
    fs.delete(src, True)
    if not _committed(spark, path):
        raise RuntimeError(f"could not publish fact table at {path}")


def write_fact(df: DataFrame, path: str, files: int, partition_by_month: bool = False) -> None:
    """Write a canonical fact sorted on ``(order_datetime, order_id)`` into
    ``files`` range partitions (optionally under ``order_month=`` folders)."""
    order = [F.col("order_datetime").asc_nulls_last(), F.col("order_id").asc_nulls_last()]
    out = df.repartitionByRange(files, *order).sortWithinPartitions(*order)
    writer = out.write.mode("overwrite")
    if partition_by_month:
        out = out.withColumn("order_month", F.trunc(F.to_date("order_datetime"), "month"))
        writer = out.write.mode("overwrite").partitionBy("order_month")
    writer.parquet(path)


def _build(spark: SparkSession, df: DataFrame, rows: int, path: str, partition_by_month: bool) -> None:
    files = max(math.ceil(rows / ROWS_PER_FILE), spark.sparkContext.defaultParallelism)
    tmp = f"{path}.tmp-{uuid.uuid4().hex[:12]}"
    try:
        write_fact(df, tmp, files, partition_by_month)
    except BaseException:
        fs, jtmp = _fs(spark, tmp)
        fs.delete(jtmp, True)
        raise
    _publish(spark, tmp, path)


# (application, session, path) -> stored table; its scan keeps the file listing.
_RESOLVED: dict[tuple[str, str, str], DataFrame] = {}
_PATHS: dict[tuple[str, str, str], str] = {}  # where it lies (a rebuilt copy has a folder of its own)
_LOCKS: dict[str, threading.Lock] = defaultdict(threading.Lock)


def materialised_fact(
    spark: SparkSession,
    sf_dir: str,
    mapping: str = "star",
    partition_by_month: bool = False,
    rebuild: bool = False,
    key: str | None = None,
) -> DataFrame:
    """The canonical fact for ``mapping`` over ``sf_dir``, built on first use
    and again whenever a source file changes. ``rebuild`` writes a fresh copy
    even if one is committed (used to time the build). ``key`` (``fact_key``)
    pins the version: the source files aren't listed again."""
    if mapping == "star_nulls":
        return blank_some(materialised_fact(spark, sf_dir, "star", partition_by_month, rebuild, key))
    if mapping not in BUILDERS:
        raise ValueError(f"unknown mapping {mapping!r}")
    path = f"{_facts(spark)}/{key or fact_key(spark, sf_dir, mapping)}{'-m' if partition_by_month else ''}"
    known = _known(spark, path)
    with _LOCKS[path]:
        if rebuild:
            path = f"{path}-rebuilt-{uuid.uuid4().hex[:12]}"
        elif known in _RESOLVED:
            return _RESOLVED[known]
        if not _committed(spark, path):
            if partition_by_month:
                source = materialised_fact(spark, sf_dir, mapping)
            else:
                source = BUILDERS[mapping](spark, sf_dir)
            rows = table(spark, sf_dir, MAPPING_TABLES[mapping][0]).count()  # from the file footers
            _build(spark, source, rows, path, partition_by_month)
        _RESOLVED[known], _PATHS[known] = spark.read.parquet(path), path
        return _RESOLVED[known]
