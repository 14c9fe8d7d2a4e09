"""A stored order-statistic index: pages of a sorted table without sorting it.

An index is a sorted run of a table for one sort column and direction, next to
the stored facts:

* ``rows/slice=<i>``: the table's rows, range-partitioned on (sort column, row
  key) into slices of about ``ROWS_PER_SLICE`` rows; ``_pos`` is a row's place in
  its slice. It is written once per table version;
* ``fences``: one row per slice: its row count, its offset in the whole order and
  the least and greatest sort value;
* ``counts/<search>``: the same offsets for the rows that match a search, from
  one pass over the searched text columns (partial counts per slice are all that
  is exchanged), written when a search is first asked for.

A page looks its ranks up in the fences (or the search's counts), and reads the
slices that hold them, by path: one or two for any offset, however large the
table. Only a searched page numbers rows, inside those slices. So a page costs the
same at every offset, and the number of rows in all, which the page's metadata
needs, is known without a scan.

A run is a copy of the table's columns, which is its price. It is built into a
private folder and published by one rename, like the facts (``store.py``).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderscope.operators.ranking import POSITION_MASK
from orderscope.operators.sizing import slice_count
from orderscope.session import ensure_checkpoint_dir
from orderscope.sources.store import _committed, _fs, _publish

SLICE, POS = "_slice", "_pos"
VERSION = "1"


def ordering(sort: str | None, order: int, ties: Sequence[str]) -> list[Column]:
    """Total order of a page: the sort column (ascending iff ``order == 1``),
    nulls last, then the row key."""
    first = []
    if sort:
        c = F.col(f"`{sort}`")
        first.append(c.asc_nulls_last() if order == 1 else c.desc_nulls_last())
    return first + [F.col(f"`{t}`").asc_nulls_last() for t in ties if t != sort]


@dataclass(frozen=True)
class OrderIndex:
    """A committed index; see the module's text."""

    spark: SparkSession
    path: str
    schema: object  # of the table's own columns
    sort: str | None

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.schema.fields]

    def fences(self) -> DataFrame:
        """slice, rows, offset, least, greatest (of the sort column)."""
        return self.spark.read.parquet(f"{self.path}/fences")

    def rows(self) -> DataFrame:
        """All rows with their slice and position."""
        return self.spark.read.parquet(f"{self.path}/rows").withColumnRenamed("slice", SLICE)

    def _slices(self, numbers: Sequence[int]) -> DataFrame:
        paths = [f"{self.path}/rows/slice={n}" for n in numbers]
        read = self.spark.read.option("basePath", f"{self.path}/rows")
        return read.parquet(*paths).withColumnRenamed("slice", SLICE)

    def counts(self, name: str, matches: Callable[[DataFrame], Column]) -> DataFrame:
        """slice, rows, offset of the rows that match; ``name`` identifies the
        search. One pass over the run on first use, then one small read."""
        key = hashlib.sha1(name.encode()).hexdigest()[:16]
        path = f"{self.path}/counts/{key}"
        if not _committed(self.spark, path):
            if self.fences().isEmpty():
                return self.fences()
            every = self.rows()
            found = every.where(matches(every.select(*self.columns))).groupBy(F.col(SLICE).alias("slice")).agg(F.count(F.lit(1)).alias("rows"))
            _write(self.spark, _with_offsets(found), path)
        return self.spark.read.parquet(path)

    def total(self, counts: DataFrame | None = None) -> int:
        """How many rows there are (or match): no scan of the table."""
        known = self.fences() if counts is None else counts
        return known.agg(F.coalesce(F.max(F.col("offset") + F.col("rows")), F.lit(0)).alias("n")).first()["n"]

    def page(
        self, offset: int, limit: int, cols: Sequence[str] | None = None,
        search: tuple[str, Callable[[DataFrame], Column]] | None = None,
    ) -> DataFrame:
        """Rows ``offset .. offset + limit - 1`` of the order, of all rows or of
        those that a named search matches."""
        if offset < 0:
            raise ValueError("offset must be >= 0")
        if not (1 <= limit <= 5000):
            raise ValueError("limit must be within 1..5000")
        visible = [F.col(f"`{c}`") for c in (cols or self.columns)]
        known = self.counts(*search) if search else self.fences()
        # At most limit + 1 slices hold rows of a page; usually one or two.
        wanted = known.where((F.col("offset") < offset + limit) & (F.col("offset") + F.col("rows") > offset))
        starts = {r["slice"]: r["offset"] for r in wanted.select("slice", "offset").collect()}
        if not starts:
            return self.spark.createDataFrame([], self.schema).select(*visible)
        held = self._slices(sorted(starts))
        place = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])
        if search:
            held = held.where(search[1](held.select(*self.columns)))
            number = F.row_number().over(Window.partitionBy(SLICE).orderBy(POS)) - 1
        else:
            number = F.col(POS)
            # Positions on raw columns, one interval per slice: row groups off the page are skipped.
            parts = [(F.col(SLICE) == n) & F.col(POS).between(max(0, offset - at), offset + limit - 1 - at) for n, at in starts.items()]
            held = held.where(reduce(lambda a, b: a | b, parts))
        rank = F.element_at(place, F.col(SLICE).cast("int")) + number
        found = held.withColumn("_rank", rank).where((F.col("_rank") >= offset) & (F.col("_rank") < offset + limit))
        return found.orderBy("_rank").select(*visible)

    def rank_of(self, value) -> int:
        """How many rows come before the first one with this sort value: the
        offset of a page that starts there. Reads the fences and the slices whose
        fences hold the value."""
        if self.sort is None:
            raise ValueError("the index has no sort column")
        descending = self.path.rstrip("/").split("/")[-1].endswith("-desc")
        bound, c = F.lit(value), F.col(f"`{self.sort}`")
        before = (lambda x: x > bound) if descending else (lambda x: x < bound)
        fences = self.fences()
        last = F.col("least") if descending else F.col("greatest")
        # Slices wholly before the value; nulls come last, so a slice with nulls isn't.
        whole = fences.where(before(last) & ~F.col("has_null")).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
        edge = fences.where(before(F.col("greatest") if descending else F.col("least")) & ~(before(last) & ~F.col("has_null")))
        numbers = [r["slice"] for r in edge.select("slice").collect()]  # those that straddle the value: one or two
        return whole + (self._slices(numbers).where(before(c)).count() if numbers else 0)


def _with_offsets(counted: DataFrame) -> DataFrame:
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    return counted.withColumn("offset", F.coalesce(F.sum("rows").over(before), F.lit(0)))


def _write(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write a small table and publish it by one rename."""
    tmp = f"{path}.tmp-{uuid.uuid4().hex[:12]}"
    df.coalesce(1).write.parquet(tmp)
    _publish(spark, tmp, path)


def order_index(
    df: DataFrame, table_key: str, sort: str | None, order: int = -1,
    row_key: Sequence[str] = ("order_id",), slices: int | None = None,
) -> OrderIndex:
    """The index of ``df``, built on first use.

    ``table_key`` names the version of the table (``store.fact_key``): a changed
    table has another key, so an index is never stale. ``row_key`` must be
    unique together (rows that are equal in it and in the sort column are
    otherwise in any, but stored, order)."""
    spark = df.sparkSession
    for c in [*([sort] if sort else []), *row_key]:
        if c not in df.columns:
            raise ValueError(f"{c!r} is not a column of the table")
    if {SLICE, POS, "slice"} & set(df.columns):
        raise ValueError("the table must not have columns named slice, _slice or _pos")
    direction = "asc" if order == 1 or not sort else "desc"
    shape = f"{VERSION}|{table_key}|{sort}|{direction}|{list(row_key)}|{df.schema.json()}|{slices}"
    name = f"{hashlib.sha1(shape.encode()).hexdigest()[:16]}-{direction}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/orderscope_order_index/{name}"
    if not _committed(spark, path):
        _build(df, path, sort, ordering(sort, order, row_key), slices)
    return OrderIndex(spark, path, df.schema, sort)


def _build(df: DataFrame, path: str, sort: str | None, order: list[Column], slices: int | None) -> None:
    spark = df.sparkSession
    tmp = f"{path}.tmp-{uuid.uuid4().hex[:12]}"
    run = df.repartitionByRange(slices or slice_count(df), *order).sortWithinPartitions(*order)
    run = run.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.spark_partition_id().alias("slice"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(POSITION_MASK)).alias(POS),
    )
    run.write.partitionBy("slice").parquet(f"{tmp}/rows")
    if df.isEmpty():
        # Spark writes no data folder of an empty table: the fences are empty too.
        fences = spark.createDataFrame([], "slice int, rows bigint, least string, greatest string, has_null boolean")
    else:
        key = F.col(f"`{sort}`") if sort else F.lit(None).cast("string")
        fences = spark.read.parquet(f"{tmp}/rows").groupBy("slice").agg(
            F.count(F.lit(1)).alias("rows"), F.min(key).alias("least"), F.max(key).alias("greatest"),
            F.max(key.isNull()).alias("has_null"),
        )
    _with_offsets(fences).coalesce(1).write.parquet(f"{tmp}/fences")
    fs, done = _fs(spark, f"{tmp}/_SUCCESS")
    fs.create(done).close()
    _publish(spark, tmp, path)
