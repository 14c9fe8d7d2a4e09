"""Scalar expressions shared by the datasets (built-ins only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Null token: a missing text key is grouped and matched as this literal
# (pandas turns NaN into the text "nan" when a column goes through astype(str)).
NULL_TOKEN = "nan"


def text_key(c: Column | str) -> Column:
    """Text view of a key where nulls become the ``nan`` token."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(NULL_TOKEN))


def datetime_text(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` text of a wall-clock ``timestamp_ntz``.

    A string cast of timestamp_ntz involves no time zone; ``date_format``
    does, and shifts wall-clock times that fall in a daylight-saving gap of
    the session zone."""
    return F.substring(ts.cast("timestamp_ntz").cast("string"), 1, 19)


def wall_clock_instant(ts: Column) -> Column:
    """The instant whose UTC reading is the wall-clock ``timestamp_ntz``.

    Built from the wall-clock fields with an explicit UTC zone, so no session
    zone enters (a cast or ``timestamp_diff`` would move times that fall in a
    daylight-saving gap of the session zone)."""
    return F.make_timestamp(
        F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts),
        F.date_part(F.lit("SECOND"), ts), F.lit("UTC"),
    )


def elapsed_whole_days(start: Column, end: Column) -> Column:
    """Whole days elapsed between two wall-clock timestamps (23:00 → 01:00
    next day is 0), independent of the session time zone."""
    micros = F.unix_micros(wall_clock_instant(end)) - F.unix_micros(wall_clock_instant(start))
    return F.floor(micros / F.lit(86_400_000_000))


def ci_regex(pattern: str) -> str:
    """Case-insensitive, Unicode-aware Java regex (``(?i)`` alone only folds ASCII)."""
    return "(?iu)" + pattern


def check_java_regex(spark, pattern: str) -> None:
    """Reject a pattern before any job starts, using the JVM's own regex
    compiler (Spark evaluates ``rlike`` with java.util.regex, whose syntax
    differs from Python's in corners such as named groups)."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(ci_regex(pattern))
    except Exception as exc:  # py4j wraps PatternSyntaxException
        raise ValueError(f"invalid search pattern {pattern!r}: {str(exc).splitlines()[0][:200]}") from exc


def safe_div(num: Column, den: Column) -> Column:
    """x/0 and 0/0 give NULL instead of an ANSI error (or pandas' ±inf/NaN)."""
    return F.try_divide(num, den)


def weekday_mon0(ts: Column) -> Column:
    """Day of week with Monday = 0 .. Sunday = 6."""
    return F.weekday(ts)


def late_flag(delivery: Column, eta: Column, threshold: float = 0.0) -> Column:
    """True when delivery − eta exceeds the threshold; unknown delay is False."""
    return F.coalesce((delivery - eta) > F.lit(float(threshold)), F.lit(False))


def net_revenue(total: Column, pct: Column) -> Column:
    """Revenue after the platform commission; ``pct`` is a fraction (0.12),
    never a percentage. A NULL commission makes the net NULL."""
    return total * (F.lit(1.0) - pct)


# Order size classes by item count.
ITEM_CLASS_INDIVIDUAL = "individual"
ITEM_CLASS_COMBO = "combo"
ITEM_CLASS_FAMILY = "família"


def item_class(items: Column) -> Column:
    """≤ 1 item individual, ≤ 3 combo, otherwise família; unknown counts as 0."""
    n = F.coalesce(items, F.lit(0.0))
    return (
        F.when(n <= 1, F.lit(ITEM_CLASS_INDIVIDUAL))
        .when(n <= 3, F.lit(ITEM_CLASS_COMBO))
        .otherwise(F.lit(ITEM_CLASS_FAMILY))
    )


# Synonyms of an explicit class column (matched lower-case).
CLASS_SYNONYMS: dict[str, str] = {
    "individual": "individual",
    "1": "individual",
    "single": "individual",
    "simples": "individual",
    "combo": "combo",
    "2": "combo",
    "duo": "combo",
    "par": "combo",
    "família": "família",
    "familia": "família",
    "family": "família",
    "4+": "família",
    "4": "família",
}

# Display rank of a class; anything else ranks 99.
CLASS_RANK: dict[str, int] = {"individual": 1, "combo": 2, "família": 3, "familia": 3}
UNKNOWN_CLASS_RANK = 99


def class_label(raw: Column) -> Column:
    """Lower-case, then replace a whole-value synonym; other values stay lower-case."""
    low = F.lower(raw.cast("string"))
    return F.coalesce(F.try_element_at(_synonym_map(), low), low)


def _synonym_map() -> Column:
    return F.create_map(*[F.lit(x) for kv in CLASS_SYNONYMS.items() for x in kv])


def class_rank(label: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in CLASS_RANK.items() for x in kv])
    return F.coalesce(F.try_element_at(m, label), F.lit(UNKNOWN_CLASS_RANK))
