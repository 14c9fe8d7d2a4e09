import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from orderscope.sources.mapping import events_fact, events_to_fact
from orderscope.streaming.windows import (
    read_event_stream,
    run_to_table,
    streamed_daily_orders,
    streamed_hourly_orders,
    streaming_session,
    windowed_orders,
    with_open_windows,
)

SF = "/root/testdata/sf0.001"
EVENTS = f"{SF}/events.parquet"


def _scratch() -> str:
    return tempfile.mkdtemp(prefix="orderscope-test-", dir=os.environ.get("TMPDIR", "/tmp"))


def _daily(df):
    return {(r.window_start, r.orders, round(r.avg_delivery_minutes, 9)) for r in df.collect()}


def _batch(spark):
    rows = (
        events_fact(spark, SF)
        .groupBy(F.to_date("order_datetime").alias("d"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg("actual_delivery_minutes").alias("a"))
        .collect()
    )
    return {(dt.datetime.combine(r.d, dt.time()), r.n, round(r.a, 9)) for r in rows}


def test_streamed_windows_equal_batch(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert _daily(streamed_daily_orders(spark, SF)) == _batch(spark)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before  # the stream has a session of its own


def test_streamed_hour_histogram_totals(spark):
    got = streamed_hourly_orders(spark, SF)
    assert set(got.columns) == {"window_start", "hour", "orders"}
    assert got.agg(F.sum("orders")).first()[0] == events_fact(spark, SF).count()


def _folder_in_time_order(spark, base: str, files: int) -> list[str]:
    """The events as ``files`` files of consecutive days."""
    days = sorted(r.d for r in spark.read.parquet(EVENTS).select(F.to_date("ts").alias("d")).distinct().collect())
    paths = []
    for i in range(files):
        part = days[i * len(days) // files:(i + 1) * len(days) // files]
        path = f"{base}/part-{i}"
        spark.read.parquet(EVENTS).where(F.to_date("ts").isin(part)).coalesce(1).write.parquet(path)
        paths.append(path)
    return paths


def test_folder_stream_restarts_where_it_stopped(spark):
    base, table = _scratch(), f"{_scratch()}/events.parquet"
    os.makedirs(table)
    parts = _folder_in_time_order(spark, base, 4)

    def arrive(path):
        name = next(f for f in os.listdir(path) if f.endswith(".parquet"))
        os.link(f"{path}/{name}", f"{table}/{name}")

    session = streaming_session(spark, state_partitions=2)
    for p in parts[:3]:
        arrive(p)
    stream = windowed_orders(read_event_stream(session, table, max_files_per_trigger=1))
    out, first = run_to_table(stream, "test_restart", run=os.path.basename(base))
    assert sum(p["numInputRows"] > 0 for p in first.recentProgress) >= 2  # several batches
    closed = _daily(spark.read.parquet(out))
    arrive(parts[3])
    again, second = run_to_table(
        windowed_orders(read_event_stream(session, table)), "test_restart", run=os.path.basename(base)
    )
    assert again == out
    new_rows = sum(p["numInputRows"] for p in second.recentProgress)
    assert new_rows == spark.read.parquet(parts[3]).count()  # only the new file was read
    assert closed < _daily(spark.read.parquet(out))
    whole = with_open_windows(spark.read.parquet(out), events_to_fact(spark.read.parquet(table)), windowed_orders)
    assert _daily(whole) == _batch(spark)


def test_folder_partitioned_stream_source(spark):
    table = f"{_scratch()}/events.parquet"
    spark.read.parquet(EVENTS).withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(table)
    stream = windowed_orders(read_event_stream(streaming_session(spark), table))
    out, _ = run_to_table(stream, "test_partitioned")
    got = with_open_windows(
        spark.read.schema(stream.schema).parquet(out), events_to_fact(spark.read.parquet(table)), windowed_orders
    )
    assert sum(r.orders for r in got.collect()) == events_fact(spark, SF).count()


def test_windows_do_not_depend_on_session_time_zone(spark):
    tz = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        starts = {r.window_start for r in streamed_daily_orders(spark, SF).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", tz)
    assert starts and all(s.hour == 0 and s.minute == 0 for s in starts)
