"""Late and corrected orders: the stream's changelog equals the batch result."""

from __future__ import annotations

import datetime as dt
import random
import uuid

from pyspark.sql import functions as F

from orderscope.streaming.corrections import corrected_windows, corrections_session, merged_windows, streamed_corrections
from orderscope.streaming.windows import run_to_table

SCHEMA = "order_id bigint, order_datetime timestamp_ntz, actual_delivery_minutes double, version int"
RUN = uuid.uuid4().hex[:12]  # streams of an earlier test run lie in the same shared folder
DAY0 = dt.datetime(2024, 3, 1)


def batch(rows):
    last = {}
    for r in rows:
        if None not in (r[0], r[1], r[3]) and (r[0] not in last or r[3] > last[r[0]][3]):
            last[r[0]] = r
    out = {}
    for _, at, v, _ in last.values():
        out.setdefault(at.replace(hour=0, minute=0), []).append(v)
    known = {d: [round(v * 1e6) for v in vs if v is not None] for d, vs in out.items()}
    return {(d, len(vs), round(sum(known[d]) / len(known[d]) / 1e6, 9) if known[d] else None) for d, vs in out.items()}


def now(spark, out):
    return {(r["window_start"], r["orders"], None if r["avg_value"] is None else round(r["avg_value"], 9)) for r in merged_windows(spark.read.parquet(out)).collect()}


def deliver(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.mode("append").parquet(folder)


def test_out_of_order_corrections_and_restarts_equal_batch(spark, tmp_path):
    rng = random.Random(9)
    made = []
    for i in range(300):
        for version in rng.sample(range(4), rng.choice([1, 1, 1, 2, 3])):
            at = DAY0 + dt.timedelta(days=rng.randrange(6), minutes=rng.randrange(1440))
            made.append((i, at, rng.choice([None, 0.1, 7.25, 1 / 3]), version))
    made += [(None, DAY0, 1.0, 0), (900, None, 1.0, 0), (901, DAY0, 1.0, None)]
    rng.shuffle(made)
    folder, session, out = str(tmp_path / "in"), corrections_session(spark, 3), None
    for at in range(0, len(made), 200):  # each delivery is a run of its own: stopped and started again
        deliver(spark, folder, made[at : at + 200])
        stream = session.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        out, _ = run_to_table(corrected_windows(stream), "corrections-test", RUN)
        assert now(spark, out) == batch(made[: at + 200])
    stream = session.readStream.schema(SCHEMA).parquet(folder)
    changes = spark.read.parquet(out).count()
    run_to_table(corrected_windows(stream), "corrections-test", RUN)
    assert spark.read.parquet(out).count() == changes  # nothing new: no change


def test_state_is_freed_after_the_retention(spark, tmp_path):
    folder, session = str(tmp_path / "in"), corrections_session(spark, 2)

    def run():
        stream = session.readStream.schema(SCHEMA).parquet(folder)
        out, query = run_to_table(corrected_windows(stream, retention="2 days"), "corrections-old", RUN)
        return out, query

    deliver(spark, folder, [(1, DAY0, 1.0, 0), (2, DAY0, 2.0, 0)])
    run()
    deliver(spark, folder, [(1, DAY0, 3.0, 1), (3, DAY0 + dt.timedelta(days=9), 4.0, 0)])  # in time
    out, _ = run()
    deliver(spark, folder, [(2, DAY0, 50.0, 1), (4, DAY0 + dt.timedelta(days=9), 6.0, 0)])  # too late: dropped
    out, query = run()
    day9 = DAY0 + dt.timedelta(days=9)
    assert now(spark, out) == {(DAY0, 2, 2.5), (day9, 2, 5.0)}
    kept = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert kept and kept[-1] < 8  # orders 1 and 2 hold no state any more


def test_orders_share_state_values(spark, tmp_path):
    """A state value per group, not per order: calls to the store don't grow with
    the orders, and within a group each order is kept and freed on its own."""
    session, groups = corrections_session(spark, 2), 3
    folder, out = str(tmp_path / "in"), None

    def run():
        stream = session.readStream.schema(SCHEMA).parquet(folder)
        return run_to_table(corrected_windows(stream, retention="2 days", buckets=groups), "corrections-groups", RUN)

    first = [(i, DAY0 + dt.timedelta(days=i % 2), float(i), 0) for i in range(400)]
    deliver(spark, folder, first)
    out, query = run()
    assert now(spark, out) == batch(first)
    assert query.recentProgress[-1].stateOperators[0].numRowsTotal == groups
    # corrected: one of each day, twice in one delivery, and by an older version too
    later = [(4, DAY0, 0.5, 2), (4, DAY0, 0.25, 1), (7, DAY0, 2.5, 1), (500, DAY0 + dt.timedelta(days=3, hours=1), 1.0, 0)]
    deliver(spark, folder, later)
    out, _ = run()
    assert now(spark, out) == batch(first + later)
    # the watermark is day 1, 1:00: orders of day 0 are free, those of midnight of day 1 too
    deliver(spark, folder, [(9, DAY0 + dt.timedelta(days=2), 3.0, 1), (500, DAY0 + dt.timedelta(days=2), 2.0, 1)])
    out, _ = run()
    day = lambda n: DAY0 + dt.timedelta(days=n)
    counts = {d: n for d, n, _ in now(spark, out)}
    assert counts == {day(0): 201, day(1): 199, day(2): 2}  # 9 anew, 500 moved


def test_string_ids(spark, tmp_path):
    folder, session, out = str(tmp_path / "in"), corrections_session(spark, 2), None
    rows = [(f"o{i}", DAY0, float(i), 0) for i in range(20)]
    for part in (rows, [("o3", DAY0 + dt.timedelta(days=1), 7.0, 1), ("ö", DAY0, 1.0, 0)]):
        schema = SCHEMA.replace("order_id bigint", "order_id string")
        spark.createDataFrame(part, schema).write.mode("append").parquet(folder)
        out, _ = run_to_table(corrected_windows(session.readStream.schema(schema).parquet(folder), buckets=2), "corrections-ids", RUN)
    assert now(spark, out) == batch(rows + [("o3", DAY0 + dt.timedelta(days=1), 7.0, 1), ("ö", DAY0, 1.0, 0)])


def test_registered_stream_moves_orders_between_days(spark):
    found = streamed_corrections(spark, "/root/testdata/sf0.001")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert found.agg(F.sum("orders")).first()[0] == events.count()
