"""Continuously arriving orders: event-time tumbling windows.

Streaming versions of the overview order series, the delivery-time series
and the orders-by-hour histogram. Each window is emitted once, in append
mode, after the watermark (max event time seen − allowed lateness) passes
its end; rows arriving later than that are dropped by Spark's state store.
State is one aggregation buffer per open window, so it is bounded by the
number of windows inside the lateness horizon, not by the row count.

The windows still open when the input ends stay in the state, ready for the
next run. ``with_open_windows`` adds them to a read-back result: it aggregates
the few rows after the last emitted window in batch, so stream and batch agree.

Event time: watermarks need ``TIMESTAMP``; the fact carries wall-clock
``timestamp_ntz``. The wall clock is mapped to the instant with the same
UTC reading (built from its fields with an explicit UTC zone) and window
bounds are mapped back by ``timestamp_ntz`` arithmetic from the epoch, so
no session time zone enters: a day window is always a wall-clock day.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orderscope.functions.expressions import wall_clock_instant
from orderscope.operators.filters import ts_literal
from orderscope.session import ensure_checkpoint_dir
from orderscope.sources.mapping import events_to_fact


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _event_time(ntz: Column) -> Column:
    """Wall-clock timestamp_ntz → instant with the same UTC reading."""
    return wall_clock_instant(ntz)


def _wall_clock(ltz: Column) -> Column:
    """Instant → its UTC reading as timestamp_ntz (inverse of _event_time)."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(ltz), _epoch())


def streaming_session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """A session of the same application with a configuration of its own for
    streams. Spark fixes the number of state partitions when a query first
    starts, from ``spark.sql.shuffle.partitions``; it is set here (default: the
    cluster's default parallelism) and the caller's session keeps its own."""
    ensure_checkpoint_dir(spark)
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    session.conf.set("spark.sql.shuffle.partitions", str(state_partitions or spark.sparkContext.defaultParallelism))
    return session


def read_event_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The event table at ``path`` (a folder, partitioned or not, or one file)
    as a stream of canonical orders (mapping ``events``). The schema is taken
    from the files present at start, never inferred per batch."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(jpath).isFile():  # a file stream reads folders: its folder, and only this name
        reader = reader.option("pathGlobFilter", jpath.getName())
        path = jpath.getParent().toString()
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return events_to_fact(reader.parquet(path))


def windowed_orders(fact: DataFrame, window: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """window_start, window_end, orders, avg_delivery_minutes per tumbling window."""
    et = _event_time(F.col("order_datetime")).alias("_et")
    w = F.window("_et", window)
    return (
        fact.select(et, F.col("actual_delivery_minutes"))
        .withWatermark("_et", lateness)
        .groupBy(w.alias("_w"))
        .agg(F.count(F.lit(1)).alias("orders"), F.avg("actual_delivery_minutes").alias("avg_delivery_minutes"))
        .select(
            _wall_clock(F.col("_w.start")).alias("window_start"),
            _wall_clock(F.col("_w.end")).alias("window_end"),
            "orders",
            "avg_delivery_minutes",
        )
    )


def windowed_orders_by_hour(fact: DataFrame, window: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """window_start, hour, orders: the hour-of-day histogram per window."""
    et = _event_time(F.col("order_datetime")).alias("_et")
    return (
        fact.select(et, F.hour("order_datetime").alias("hour"))
        .withWatermark("_et", lateness)
        .groupBy(F.window("_et", window).alias("_w"), "hour")
        .agg(F.count(F.lit(1)).alias("orders"))
        .select(_wall_clock(F.col("_w.start")).alias("window_start"), "hour", "orders")
    )


def run_to_table(stream: DataFrame, name: str, run: str | None = None) -> tuple[str, StreamingQuery]:
    """Run a windowed stream over everything available now and write the
    emitted windows as Parquet under the shared checkpoint folder, next to the
    query's own checkpoint. A later call with the same ``name`` and ``run``
    goes on where that one stopped (or was killed): it reads the new files
    only. Without ``run`` the call starts afresh in a folder of its own."""
    spark = stream.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    folder = f"{base}/orderscope_streams/{name}-{run or uuid.uuid4().hex[:12]}"
    q = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/data")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return f"{folder}/data", q


def with_open_windows(
    emitted: DataFrame, fact: DataFrame, windowed: Callable[[DataFrame], DataFrame], window: str = "1 day"
) -> DataFrame:
    """The emitted windows and those still open. Windows are emitted in time
    order, so exactly the rows from the end of the last emitted one on belong
    to open windows; that bound is one value and is pushed into the scan."""
    start = emitted.agg(F.max("window_start")).first()[0]
    if start is not None:
        end = ts_literal(start) + F.expr(f"INTERVAL {window}")
        fact = fact.where(F.col("order_datetime") >= end)
    return emitted.unionByName(windowed(fact))


def _streamed(spark: SparkSession, sf_dir: str, name: str, windowed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    stream = windowed(read_event_stream(streaming_session(spark), path))
    out, _ = run_to_table(stream, name)
    # the sink may have emitted nothing: give the schema
    emitted = spark.read.schema(stream.schema).parquet(out)
    return with_open_windows(emitted, events_to_fact(spark.read.parquet(path)), windowed)


def streamed_daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows of the events stream, run to the end of the input."""
    return _streamed(spark, sf_dir, "daily_orders", windowed_orders)


def streamed_hourly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hour-of-day histogram per daily window of the events stream."""
    return _streamed(spark, sf_dir, "hourly_orders", windowed_orders_by_hour)
