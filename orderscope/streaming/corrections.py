"""Streams whose orders arrive late, out of order and corrected.

The windows of ``windows.py`` are emitted once and closed. Here an order may come
again with a higher ``version`` (another time, another value), so what a window
holds can change after it was written. State is kept per order, not per window:
the last version's window and value. An arriving order gives changes: its
share is added to its window, and a correction also takes the old share out of
the old window. The changes are appended to a changelog table, exactly once
also over restarts (file sink and checkpoint), and any batch query adds them up
(``merged_windows``). No key is hot: an order's rows are few, and the changelog is
summed with partial aggregation.

Orders are dealt by the hash of their id into ``BUCKETS`` groups, the keys of the
state: a group's orders are one value, an Arrow table read, updated and written
at once. A key per order would cost calls between Python and the state store, and
a data frame, for every order. A batch so reads and writes the whole value of
each group it touches; more groups make them smaller. Their number is part of the
state and must stay as long as a checkpoint is used.

An order's state is freed once the watermark (greatest event time seen less
``retention``) has passed the order's time, by a timer per group set to the first
order due; rows older than the watermark are dropped, as in any stream. So
corrections are taken for ``retention`` of event time after an order; one that
comes later is dropped, or, if it moves the order to a newer time, counts as a
new order.

Values are kept to six decimals as whole numbers, so that what is taken out is
exactly what was added. Of several rows of one version the first to arrive
counts. Rows without an id, time or version are left out.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderscope.session import ensure_checkpoint_dir
from orderscope.sources.mapping import events_to_fact
from orderscope.streaming.windows import _event_time, _wall_clock, run_to_table, streaming_session

# Executors need no copy of this package: the function travels with the query.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHANGES = "window_ms bigint, orders bigint, value_n bigint, value_micros bigint"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCALE = 1_000_000
BUCKETS = 512


STATE = ["order_id", "version", "window_ms", "value_n", "value_micros", "due_ms"]
SHARE = ["window_ms", "orders", "value_n", "value_micros"]


def _packed(orders: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(orders, preserve_index=False).replace_schema_metadata(None)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    return sink.getvalue().to_pybytes()


def latest_versions(key, rows, state) -> Iterator[pd.DataFrame]:
    """One group of orders: keeps each order's last version's window and value,
    emits what changes."""
    watermark = state.getCurrentWatermarkMs()
    held = pa.ipc.open_stream(bytes(state.get[0])).read_all().to_pandas() if state.exists else None
    changed = False
    if not state.hasTimedOut:
        parts = [part.assign(due_ms=part["event_ms"].clip(lower=watermark) + 1)[STATE] for part in rows]
        before = 0 if held is None else len(held)
        orders = pd.concat(parts if held is None else [held, *parts], ignore_index=True)
        # Per order the highest version, of equal ones the first: what is held comes first.
        order = pd.factorize(orders["order_id"], use_na_sentinel=False)[0]
        rank = np.lexsort((~orders["version"].to_numpy(), order))
        last = rank[np.diff(order[rank], prepend=-1) != 0]
        new = last[last >= before]
        changed = len(new) > 0
        if changed:
            gone = np.flatnonzero(np.isin(order[:before], order[new]))
            shares = orders.assign(orders=1)[SHARE].iloc[np.concatenate([gone, new])]
            shares.iloc[: len(gone), 1:] *= -1
            yield shares
        held = orders.iloc[np.sort(last)]
    # What a batch finds due stays for its corrections and goes at its end.
    left = held[held["due_ms"] >= watermark]
    if left.empty:
        state.remove()
        return
    if changed or len(left) < len(held):
        state.update((_packed(left),))
    state.setTimeoutTimestamp(int(left["due_ms"].min()))


def corrections_session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """A session for streams (see ``streaming_session``) whose state lies in
    RocksDB, not in the executors' heap."""
    session = streaming_session(spark, state_partitions)
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return session


def corrected_windows(
    orders: DataFrame, window: str = "1 day", retention: str = "30 days", value: str = "actual_delivery_minutes", buckets: int = BUCKETS
) -> DataFrame:
    """The changelog of a stream of canonical orders with a ``version`` column:
    window_start, orders, value_n, value_micros, each to be added up. The stream
    must be read in a ``corrections_session``; ids are numbers, strings, dates or
    other plain values."""
    at = _event_time(F.col("order_datetime")).alias("_et")
    rows = orders.select("order_id", F.col("version").cast("bigint").alias("version"), at, F.col(value).cast("double").alias("_v"))
    rows = rows.where("order_id IS NOT NULL AND version IS NOT NULL AND _et IS NOT NULL").withWatermark("_et", retention)
    bucket = F.pmod(F.xxhash64("order_id"), F.lit(buckets)).alias("bucket")
    rows = rows.select(
        bucket, "order_id", "version", "_et", F.unix_millis(F.window("_et", window)["start"]).alias("window_ms"), F.unix_millis("_et").alias("event_ms"),
        F.col("_v").isNotNull().cast("bigint").alias("value_n"),
        F.coalesce(F.round(F.col("_v") * SCALE).cast("bigint"), F.lit(0).cast("bigint")).alias("value_micros"),
    )
    changes = rows.groupBy("bucket").applyInPandasWithState(latest_versions, CHANGES, "orders binary", "append", "EventTimeTimeout")
    return changes.select(_wall_clock(F.timestamp_millis("window_ms")).alias("window_start"), "orders", "value_n", "value_micros")


def merged_windows(changelog: DataFrame) -> DataFrame:
    """window_start, orders, avg_value of the windows as they are now; windows
    that lost all their orders are gone."""
    summed = changelog.groupBy("window_start").agg(*[F.sum(c).alias(c) for c in ("orders", "value_n", "value_micros")])
    mean = F.try_divide(F.col("value_micros"), F.col("value_n")) / F.lit(SCALE)
    return summed.where("orders > 0").select("window_start", "orders", mean.alias("avg_value"))


def with_corrections(events: DataFrame) -> DataFrame:
    """Events as versions of orders, dealt into three deliveries: every tenth
    event is corrected to another value, every twentieth also to the next day, and
    every seventh comes late, after corrections of others."""
    orders = events_to_fact(events).select("order_id", "order_datetime", "actual_delivery_minutes")
    k = F.col("order_id")
    first = orders.withColumns({"version": F.lit(0), "delivery": F.when(k % 7 == 0, 2).otherwise(k % 2).cast("int")})
    moved = F.when(k % 20 == 0, F.col("order_datetime") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("order_datetime"))
    second = orders.where(k % 10 == 0).withColumns(
        {"order_datetime": moved, "actual_delivery_minutes": F.col("actual_delivery_minutes") + 5.25, "version": F.lit(1), "delivery": ((k / 10) % 3).cast("int")}
    )
    return first.unionByName(second)


def streamed_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows of the corrected events: three deliveries, the stream
    stopped and started again after the first, merged from the changelog."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/orderscope_streams/corrections-{uuid.uuid4().hex[:12]}"
    made = with_corrections(spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet"))
    session, run = corrections_session(spark), uuid.uuid4().hex[:12]
    for number in range(3):
        made.where(F.col("delivery") == number).drop("delivery").write.mode("append").parquet(f"{base}/in")
        stream = session.readStream.schema(made.drop("delivery").schema).parquet(f"{base}/in")
        out, _ = run_to_table(corrected_windows(stream, retention="90 days"), "corrections", run)
    return merged_windows(spark.read.parquet(out))
