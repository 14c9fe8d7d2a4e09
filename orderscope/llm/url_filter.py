"""URL filtering against dated lists by an as-of join (native).

A list's history is dated additions and removals of entries (a host, or a
domain that covers all hosts below it). ``intervals`` turns it into validity
intervals; ``screen`` judges every capture by the entries that were active
when it was fetched.

Captures are reduced to distinct (host, day) pairs before the join and the
verdicts joined back by both, so a host with a third of all captures costs one row
per day it was fetched in the as-of join.

Defined results: a null or unparsable url, or a null or unreadable fetch day,
matches nothing and the capture is returned unblocked with no lists; repeated captures are
judged alike; events on one day count with removals last; a repeated
addition goes on, a removal of what is not listed is ignored; an empty history
blocks nothing; null entries or days in a history are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPEN_END = "9999-12-31"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null where there is none."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(authority), r"^.*@", ""), r":[0-9]*$", "")
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(host != "", host)


def intervals(history: DataFrame) -> DataFrame:
    """``(list, entry, valid_from, valid_to)`` (end exclusive) from
    ``(list, entry, action, dated)``, action being ``add`` or ``remove``. An
    addition is valid until the next event of that entry."""
    order = Window.partitionBy("list", "entry").orderBy("dated", "action")
    last = history.where("entry IS NOT NULL AND dated IS NOT NULL").select("list", F.lower("entry").alias("entry"), "action", "dated")
    last = last.groupBy("list", "entry", "dated").agg(F.max("action").alias("action"))
    last = last.withColumn("valid_to", F.coalesce(F.lead("dated").over(order), F.lit(OPEN_END).cast("date")))
    return last.where("action = 'add'").select("list", "entry", F.col("dated").alias("valid_from"), "valid_to")


def screen(captures: DataFrame, history: DataFrame, url_col: str = "url", fetched_col: str = "fetched") -> DataFrame:
    """``captures`` plus ``host``, ``blocked``, ``n_matches`` and ``lists`` (the
    matching lists, sorted, comma-joined). Own columns of these four names give
    way; all others are kept, whatever they are called."""
    own = [c for c in captures.columns if c not in ("host", "blocked", "n_matches", "lists")]
    row = F.struct(*[F.col(f"`{c}`") for c in own]).alias("row")
    captures = captures.select(row, host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{fetched_col}`").try_cast("date").alias("day"))
    days = captures.where("host IS NOT NULL AND day IS NOT NULL").groupBy("host", "day").agg(F.lit(1).alias("one"))
    parts = F.split("host", r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    asked = days.select("host", "day", F.explode(names).alias("entry"))
    active = (F.col("valid_from") <= F.col("day")) & (F.col("day") < F.col("valid_to"))
    hits = asked.join(intervals(history), "entry").where(active)
    hits = hits.groupBy("host", "day").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"))
    out = captures.join(hits, ["host", "day"], "left")
    return out.select(
        *[F.col(f"row.`{c}`") for c in own],
        "host",
        F.col("n").isNotNull().alias("blocked"),
        F.coalesce("n", F.lit(0)).alias("n_matches"),
        F.coalesce("lists", F.lit("")).alias("lists"),
    )


def _number(text: Column, start: int) -> Column:
    return F.conv(F.substring(F.md5(text), start, 6), 16, 10).cast("long")


def _day(offset: Column) -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), offset.cast("int"))


def history_of(pages: DataFrame) -> DataFrame:
    """A dated list history derived from the hosts that the pages name: each
    host, and the domain above it, is added to one list on a day of its own;
    two in three are removed again and one in three of all comes back."""
    host = host_of(F.col("url"))
    hosts = pages.select(F.explode(F.array(host, F.regexp_extract(host, r"^[^.]+\.(.*\..*\..*)$", 1))).alias("entry"))
    hosts = hosts.where("entry <> ''").groupBy("entry").agg(F.lit(1).alias("one"))
    name = F.element_at(F.array(F.lit("adult"), F.lit("malware"), F.lit("spam")), (_number(F.col("entry"), 1) % 3 + 1).cast("int"))
    added, gone = _number(F.col("entry"), 7) % 300, _number(F.col("entry"), 13) % 90 + 5
    kind = _number(F.col("entry"), 19) % 3
    event = lambda action, offset, where: F.when(where, F.struct(F.lit(action).alias("action"), _day(offset).alias("dated")))
    events = F.array(event("add", added, F.lit(True)), event("remove", added + gone, kind > 0), event("add", added + 2 * gone, kind > 1))
    return hosts.select(name.alias("list"), "entry", F.explode(events).alias("e")).where("e IS NOT NULL").select("list", "entry", "e.action", "e.dated")


def op10_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no fetch time; the day is derived from the page id."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    captures = pages.select("page_id", "url", _day((F.col("page_id") * 37) % 366).alias("fetched"))
    return screen(captures, history_of(pages))


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + ((page_id * 37) % 366)::INT AS fetched,
         nullif(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(coalesce(url, ''),
           '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '\.$', ''), '') AS host
  FROM pages),
h AS (
  SELECT DISTINCT entry FROM (
    SELECT host AS entry FROM p UNION ALL SELECT regexp_extract(host, '^[^.]+\.(.*\..*\..*)$', 1) FROM p)
  WHERE entry <> ''),
n AS (
  SELECT entry, ['adult', 'malware', 'spam'][('0x' || substr(md5(entry), 1, 6))::BIGINT % 3 + 1] AS list,
         ('0x' || substr(md5(entry), 7, 6))::BIGINT % 300 AS added,
         ('0x' || substr(md5(entry), 13, 6))::BIGINT % 90 + 5 AS gone,
         ('0x' || substr(md5(entry), 19, 6))::BIGINT % 3 AS kind
  FROM h),
v AS (
  SELECT list, entry, added AS a, CASE WHEN kind > 0 THEN added + gone ELSE 1000000 END AS b FROM n
  UNION ALL SELECT list, entry, added + 2 * gone, 1000000 FROM n WHERE kind > 1),
m AS (
  SELECT page_id, count(*) AS n_matches, string_agg(DISTINCT list, ',' ORDER BY list) AS lists
  FROM p JOIN v ON (p.host = v.entry OR ends_with(p.host, '.' || v.entry))
   AND (p.fetched - DATE '2024-01-01') >= v.a AND (p.fetched - DATE '2024-01-01') < v.b
  GROUP BY page_id)
SELECT page_id, url, fetched, host, n_matches IS NOT NULL AS blocked, coalesce(n_matches, 0) AS n_matches, coalesce(lists, '') AS lists
FROM p LEFT JOIN m USING (page_id)
"""
