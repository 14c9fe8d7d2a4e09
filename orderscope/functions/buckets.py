"""Calendar offsets for time series: every bucket is a whole number of units.

An offset is a unit (second, minute, hour, day, business day, week, half month,
month, quarter or year), a multiple, an anchor inside the unit (the weekday that
ends a week, the day that cuts a month in half, the month that ends or starts a
quarter or year), the side its label is on and, for months and longer, whether
the unit ends (starts) with its last (first) business day. A timestamp's unit is
an integer (``unit_index``): days, hours, minutes and seconds since 1970, weeks by
the day that ends them, months as year * 12 + month, two halves to a month,
business days five to a week. A bucket of ``n`` units is then integer arithmetic, a gap in the
series is a gap between integers, and labels and bounds are computed from the
integer. All of it stays inside whole-stage codegen and uses wall-clock fields
only, so no time zone moves a row.

Labels follow the dashboard convention. Days, hours, minutes, business days
and the ``S`` (start) forms are labelled by their first day or time and run on
from the first bucket; weeks, months, quarters and years by their last day, and
the first bucket ends with the first row's unit. Weekend rows count to the
business day before. Days after a month's last business day count to the next
month of a business month (quarter, year); days before its first one to the
month before, where those are labelled by their start. Half months run from their
label: from the 1st and the 15th (``SMS``), or from the 15th and the last day (``SM``).

Multiples need a place to count from: the first row's unit (for hours and
minutes the midnight before the first row), or an ``origin`` date, which keeps
the buckets of two queries over different rows alike.
"""

from __future__ import annotations

import datetime as _dt
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekday and month names in offsets, and the units' spellings.
WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
UNITS = {
    "S": "second", "MIN": "minute", "T": "minute", "H": "hour", "D": "day", "B": "business", "W": "week",
    "SM": "half", "SME": "half", "SMS": "half_start",
    "M": "month", "ME": "month", "MS": "month_start", "Q": "quarter", "QE": "quarter", "QS": "quarter_start",
    "Y": "year", "YE": "year", "A": "year", "YS": "year_start", "AS": "year_start",
}
MONTHS_IN = {"month": 1, "quarter": 3, "year": 12}
SECONDS_IN = {"second": 1, "minute": 60, "hour": 3600}
HALF_MONTH = 15


@dataclass(frozen=True)
class Offset:
    unit: str  # second, minute, hour, day, business, week, half (labelled by its start day), half_start, month, quarter, year
    n: int = 1
    # weekday (0 = Monday) that ends a week; day that cuts a month; month (1..12) that ends or starts a quarter or year
    anchor: int = 0
    at_end: bool = False  # labelled by its last day
    business: bool = False  # of months and longer: ends (starts) with its last (first) business day

    @property
    def timed(self) -> bool:
        """Whether labels are times, not dates."""
        return self.unit in SECONDS_IN


def parse_offset(freq: str | Offset) -> Offset:
    """``3D``, ``2W-WED``, ``Q-FEB``, ``MS``, ``BME``, ``BQS-FEB``, ``SM``, ``SMS-10``, ``6H``, ``15min``, ``B``, ..."""
    if isinstance(freq, Offset):
        return freq
    m = re.fullmatch(r"(\d*)([A-Z]+)(?:-([A-Z]{3}|\d{1,2}))?", (freq or "").strip().upper())
    unit, business = (UNITS.get(m[2]), False) if m else (None, False)
    if m and not unit and m[2][0] == "B":
        unit, business = UNITS.get(m[2][1:]), True
        unit = unit if unit and unit.removesuffix("_start") in MONTHS_IN else None
    if not unit:
        raise ValueError(
            f"unknown freq {freq!r}: use a multiple of S, min, H, D, B, W[-day], SM[-day of month], SMS[-day of month], "
            "M, MS, Q[-month], QS[-month], Y[-month] or YS[-month], the last six also with a B (business) before them"
        )
    n = int(m[1] or 1)
    if n < 1:
        raise ValueError(f"freq must be a positive multiple (got {freq!r})")
    at_end = unit in ("week", *MONTHS_IN)
    if unit.startswith("half"):
        anchor = int(m[3]) if (m[3] or "").isdigit() else 0 if m[3] else HALF_MONTH
        if not (2 if unit == "half_start" else 1) <= anchor <= 27:
            raise ValueError(f"freq {freq!r} has no anchor {m[3]!r}")
        return Offset(unit, n, anchor)
    unit = unit.removesuffix("_start")
    names = WEEKDAYS if unit == "week" else MONTHS if unit in ("quarter", "year") else ()
    if m[3] and m[3] not in names:
        raise ValueError(f"freq {freq!r} has no anchor {m[3]!r}")
    if unit == "week":
        anchor = WEEKDAYS.index(m[3]) if m[3] else 6
    elif unit in ("quarter", "year"):
        anchor = MONTHS.index(m[3]) + 1 if m[3] else (12 if at_end else 1)
    else:
        anchor = 0
    return Offset(unit, n, anchor, at_end, business)


def _floor_div(x: Column, n: int) -> Column:
    return x if n == 1 else ((x - F.pmod(x, F.lit(n))) / F.lit(n)).cast("bigint")


def _days(ts: Column) -> Column:
    return F.unix_date(F.to_date(ts)).cast("bigint")


def unit_index(ts: Column, off: Offset) -> Column:
    """The number of the unit that holds a timestamp (bigint)."""
    if off.unit == "day":
        return _days(ts)
    if off.unit == "hour":
        return _days(ts) * 24 + F.hour(ts)
    if off.unit == "minute":
        return _days(ts) * 1440 + F.hour(ts) * 60 + F.minute(ts)
    if off.unit == "second":
        return _days(ts) * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts)).cast("bigint")
    if off.unit == "week":
        # 1970-01-01 is a Thursday: day 3 of a week counted from Monday.
        return _floor_div(_days(ts) + (9 - off.anchor), 7)
    if off.unit == "business":
        monday = _days(ts) + 3
        return _floor_div(monday, 7) * 5 + F.least(F.pmod(monday, F.lit(7)), F.lit(4))
    month, day = F.year(ts).cast("bigint") * 12 + F.month(ts) - 1, F.to_date(ts)
    if off.unit.startswith("half"):
        second = (F.dayofmonth(ts) >= off.anchor).cast("bigint")
        # Halves that a month's last day starts are numbered as the second ones of that month.
        return month * 2 + second + ((day == F.last_day(ts)).cast("bigint") - 1 if off.unit == "half" else 0)
    if off.business and off.at_end:
        month = month + (day > _last_business_day(day)).cast("bigint")
    elif off.business:
        month = month - (day < _first_business_day(F.trunc(day, "month"))).cast("bigint")
    width, rest = _months(off)
    return _floor_div(month - rest + (width - 1 if off.at_end else 0), width)


def _months(off: Offset) -> tuple[int, int]:
    width = MONTHS_IN[off.unit]
    return width, (off.anchor - 1) % width if off.anchor else 0


def _weekday(day: Column) -> Column:
    """0 = Monday."""
    return F.pmod(F.unix_date(day) + 3, F.lit(7))


def _last_business_day(day: Column) -> Column:
    """Of the month that holds a day."""
    last = F.last_day(day)
    return F.date_sub(last, F.greatest(_weekday(last) - 4, F.lit(0)))


def _first_business_day(first: Column) -> Column:
    """Of the month that begins with a day."""
    weekday = _weekday(first)
    return F.date_add(first, F.when(weekday > 4, 7 - weekday).otherwise(0))


def _first_of_month(month: Column) -> Column:
    return F.make_date(_floor_div(month, 12).cast("int"), (F.pmod(month, F.lit(12)) + 1).cast("int"), F.lit(1))


def unit_start(index: Column, off: Offset) -> Column:
    """First day (time, for hours and minutes) of a unit."""
    if off.timed:
        seconds = index * SECONDS_IN[off.unit]
        day = F.date_from_unix_date(_floor_div(seconds, 86400).cast("int")).cast("timestamp_ntz")
        return day + F.make_dt_interval(mins=(F.pmod(seconds, F.lit(86400)) / 60).cast("int"), secs=F.pmod(seconds, F.lit(60)).cast("decimal(18, 6)"))
    if off.unit == "day":
        return F.date_from_unix_date(index.cast("int"))
    if off.unit == "week":
        return F.date_from_unix_date((index * 7 + (off.anchor - 9)).cast("int"))
    if off.unit == "business":
        return F.date_from_unix_date((_floor_div(index, 5) * 7 - 3 + F.pmod(index, F.lit(5))).cast("int"))
    if off.unit.startswith("half"):
        first = _first_of_month(_floor_div(index, 2))
        odd = F.pmod(index, F.lit(2)) == 1
        if off.unit == "half":
            return F.when(odd, F.last_day(first)).otherwise(F.date_add(first, off.anchor - 1))
        return F.when(odd, F.date_add(first, off.anchor - 1)).otherwise(first)
    if off.business and off.at_end:
        return F.date_add(unit_label(index - 1, off), 1)
    width, rest = _months(off)
    first = _first_of_month(index * width + rest - (width - 1 if off.at_end else 0))
    return _first_business_day(first) if off.business else first


def unit_label(index: Column, off: Offset) -> Column:
    """A unit's first day or time, or its last day."""
    if not off.at_end:
        return unit_start(index, off)
    if off.unit == "week":
        return F.date_from_unix_date((index * 7 + (off.anchor - 3)).cast("int"))
    width, rest = _months(off)
    last = _first_of_month(index * width + rest)
    return _last_business_day(last) if off.business else F.last_day(last)


def bucket_unit(index: Column, off: Offset, origin: Column) -> Column:
    """The unit that labels the bucket of a unit: every ``n``-th one from the
    unit ``origin``. A bucket runs from (or, labelled by its end, up to) it."""
    if off.n == 1:
        return index
    away = index - origin
    return origin + (-_floor_div(-away, off.n) if off.at_end else _floor_div(away, off.n)) * off.n


def bucket_bounds(label_unit: Column, off: Offset) -> tuple[Column, Column]:
    """First day or time of a bucket, and of the next one."""
    first = label_unit - (off.n - 1) if off.at_end else label_unit
    return unit_start(first, off), unit_start(first + off.n, off)


def origin_unit(off: Offset, first: _dt.datetime | _dt.date) -> Column:
    """The unit to count multiples from, for a first row or an origin date."""
    midnight = _dt.datetime(first.year, first.month, first.day)
    at = F.lit(midnight.isoformat(sep=" ")).cast("timestamp_ntz")
    return unit_index(at, off)
