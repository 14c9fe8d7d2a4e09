import datetime as dt
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from orderscope.functions.buckets import parse_offset
from orderscope.operators.timeseries import bucketed_series
from orderscope.plans import ops, overview, satisfaction

from conftest import make_fact, ts


@pytest.fixture(scope="module")
def gap_days(spark):
    rows = [
        dict(order_id=1, order_datetime=ts("2024-01-07 15:00"), actual_delivery_minutes=10.0, satisfacao_nivel=4.0),
        dict(order_id=2, order_datetime=ts("2024-01-08 00:00"), actual_delivery_minutes=20.0, satisfacao_nivel=2.0),
        dict(order_id=3, order_datetime=ts("2024-02-29 23:59"), actual_delivery_minutes=30.0, satisfacao_nivel=5.0),
        dict(order_id=4, order_datetime=None, actual_delivery_minutes=40.0, satisfacao_nivel=3.0),
        dict(order_id=5, order_datetime=ts("2024-03-01 00:00"), actual_delivery_minutes=50.0, satisfacao_nivel=1.0),
    ]
    return make_fact(spark, rows)


def test_daily_spine(gap_days):
    rows = overview.timeseries_orders(gap_days, freq="D").collect()
    assert len(rows) == 55
    assert rows[0].date == dt.date(2024, 1, 7) and rows[-1].date == dt.date(2024, 3, 1)
    assert sum(r.orders for r in rows) == 4  # the NULL date is dropped
    assert sum(1 for r in rows if r.orders == 0) == 51


def test_weekly_labels_end_on_sunday(gap_days):
    rows = overview.timeseries_orders(gap_days, freq="W").collect()
    assert len(rows) == 9
    assert rows[0].date == dt.date(2024, 1, 7)  # Sunday 15:00 belongs to the week ending that day
    assert rows[1].date == dt.date(2024, 1, 14) and rows[1].orders == 1
    assert all(r.date.weekday() == 6 for r in rows)


def test_monthly_labels_last_day(gap_days):
    rows = overview.timeseries_orders(gap_days, freq="M").collect()
    assert [(r.date, r.orders) for r in rows] == [
        (dt.date(2024, 1, 31), 2),
        (dt.date(2024, 2, 29), 1),
        (dt.date(2024, 3, 31), 1),
    ]


def test_empty_bucket_fill_policies(gap_days):
    # mean series: empty buckets stay NULL
    d = {r.date: r.avg_delivery_minutes for r in ops.timeseries_delivery(gap_days, freq="D").collect()}
    assert d[dt.date(2024, 1, 9)] is None and d[dt.date(2024, 1, 8)] == 20.0
    # satisfaction series: empty buckets are 0 for mean and count
    s = {r.date: (r.avg_satisfacao, r["count"]) for r in satisfaction.timeseries(gap_days, freq="D").collect()}
    assert s[dt.date(2024, 1, 9)] == (0.0, 0)
    assert s[dt.date(2024, 1, 7)] == (4.0, 1)


def test_frequency_totals_agree(gap_days):
    totals = {f: sum(r.orders for r in overview.timeseries_orders(gap_days, freq=f).collect()) for f in "DWM"}
    assert totals == {"D": 4, "W": 4, "M": 4}


def test_bad_frequency(gap_days):
    with pytest.raises(ValueError):
        overview.timeseries_orders(gap_days, freq="fortnight")


def test_empty_input_gives_no_rows(spark):
    empty = make_fact(spark, [])
    assert overview.timeseries_orders(empty, freq="D").count() == 0


OFFSETS = [
    "D", "3D", "11D", "W", "2W", "W-WED", "3W-TUE", "M", "2M", "5M", "MS", "2MS", "Q", "Q-FEB", "2Q", "QS", "QS-FEB", "2QS-NOV",
    "Y", "Y-MAR", "2Y", "YS", "YS-JUL", "B", "3B", "H", "6H", "5H", "37min", "90min",
    "BME", "2BME", "BMS", "3BMS", "BQE", "BQE-FEB", "2BQE", "BQS", "BQS-FEB", "BYE", "BYE-MAR", "BYS", "BYS-JUL",
    "SME", "SME-10", "3SME", "SMS", "SMS-20", "2SMS", "7200s",
]


@pytest.mark.parametrize("freq", OFFSETS)
def test_every_offset_equals_a_plain_resample(spark, freq):
    rng = random.Random(freq)
    short = freq.endswith(("H", "min", "s"))
    times = [dt.datetime(1969, 12, 27, 9, 30) + dt.timedelta(minutes=rng.randrange(60 * 24 * (9 if short else 1500))) for _ in range(120)]
    times += [dt.datetime(1970, 1, 31, 23, 59), dt.datetime(1970, 2, 1)] if not short else []
    fact = make_fact(spark, [dict(order_id=i, order_datetime=t, total_brl=float(i)) for i, t in enumerate(times)])
    got = [(r["date"], r["orders"]) for r in overview.timeseries_orders(fact, freq=freq).collect()]
    # the plain library's own names for the same offsets
    plain = freq.replace("H", "h") if freq.endswith("H") else freq.replace("min", "min")
    m = re.fullmatch(r"(\d*)([MQY])((?:-[A-Z]+)?)", plain)
    plain = f"{m[1]}{m[2]}E{m[3]}" if m else plain
    want = pd.Series(1, index=pd.DatetimeIndex(times)).resample(plain).sum()
    label = (lambda t: t.to_pydatetime()) if short else (lambda t: t.date())
    assert got == [(label(t), int(n)) for t, n in want.items()]


def test_bounds_steps_and_origin(spark, gap_days):
    rows = bucketed_series(gap_days, "order_datetime", "2W-WED", {"n": F.count(F.lit(1))}, {"n": 0}, bounds=True).collect()
    assert [r["step"] for r in rows] == list(range(len(rows))) and sum(r["n"] for r in rows) == 4
    assert all((r["bucket_end"] - r["bucket_start"]).days == 14 and r["date"] == r["bucket_end"] - dt.timedelta(days=1) for r in rows)
    assert all(a["bucket_end"] == b["bucket_start"] for a, b in zip(rows, rows[1:]))
    # buckets of business and half months meet without gaps, and hold their rows
    for freq in ("BME", "BMS", "2BQE-FEB", "BYS", "SM", "SMS", "3SM-10"):
        rows = bucketed_series(gap_days, "order_datetime", freq, {"n": F.count(F.lit(1)), "low": F.min("order_datetime"), "high": F.max("order_datetime")}, {"n": 0}, bounds=True).collect()
        assert all(a["bucket_end"] == b["bucket_start"] for a, b in zip(rows, rows[1:])) and sum(r["n"] for r in rows) == 4
        assert all(r["bucket_start"] <= r["low"].date() <= r["high"].date() < r["bucket_end"] for r in rows if r["n"])
    # an origin of its own: the same buckets whatever the first row
    some = gap_days.where("order_id > 1")
    for freq in ("3D", "2M", "7H", "2W", "3B"):
        one, two = ({r["date"]: r["orders"] for r in bucketed_series(f, "order_datetime", freq, {"orders": F.count(F.lit(1))}, {"orders": 0}, origin=dt.date(2020, 5, 6)).collect()} for f in (gap_days, some))
        assert set(two) <= set(one)


@pytest.mark.parametrize("bad", ["", None, "0D", "-1D", "2", "D-MON", "W-JAN", "Q-MON", "M-JAN", "SM-MON", "SM-28", "SMS-1", "BW", "BD", "BSM", "BB", "BM-JAN", "M-15"])
def test_bad_offsets(bad):
    with pytest.raises(ValueError):
        parse_offset(bad)
