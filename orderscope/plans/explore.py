"""Generic table exploration: schema listing, regex search, paging, summaries.

These work on any DataFrame (raw or canonical). Search is an OR of
case-insensitive regex matches over all text columns, evaluated inside the
scan stage; a NULL cell is matched as the text ``nan``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderscope.functions.expressions import check_java_regex, ci_regex, text_key
from orderscope.operators.quantiles import group_quantiles
from orderscope.operators.ranking import page as _page
from orderscope.operators.top_counts import top_counts
from orderscope.session import ensure_checkpoint_dir
from orderscope.sources.columns import MissingColumnError, resolve_all
from orderscope.sources.order_index import OrderIndex
from orderscope.sources.order_index import ordering as page_order
from orderscope.sources.text_index import TextIndex

TOP_VALUES = 20
PLACE = ("__place_file", "__place_row")
# describe() statistics and their quantile probabilities.
DESCRIBE_PROBS = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def columns(df: DataFrame) -> DataFrame:
    """column, dtype for every column of ``df`` (schema only, no job)."""
    return df.sparkSession.createDataFrame(list(df.dtypes), "column string, dtype string")


def catalogue(df: DataFrame, with_dtype: bool = True) -> DataFrame:
    """column, [dtype,] non_null, rows: the table's columns with their
    non-null counts and the row count, from one aggregate pass (partial
    aggregation; the single result row is unpivoted, one row per column)."""
    names = list(df.columns)
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"_c{i}") for i, c in enumerate(names)]
    )
    long = counts.unpivot("_rows", [f"_c{i}" for i in range(len(names))], "_slot", "non_null")
    slot_name = F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(f"_c{i}"), F.lit(c))])
    out = [F.element_at(slot_name, F.col("_slot")).alias("column")]
    if with_dtype:
        dtypes = dict(df.dtypes)
        slot_type = F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(f"_c{i}"), F.lit(dtypes[c]))])
        out.append(F.element_at(slot_type, F.col("_slot")).alias("dtype"))
    return long.select(*out, F.col("non_null").cast("bigint").alias("non_null"), F.col("_rows").alias("rows"))


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def search_predicate(df: DataFrame, q: str) -> Column:
    check_java_regex(df.sparkSession, q)
    cols = text_columns(df)
    if not cols:
        return F.lit(False)
    pattern = ci_regex(q)
    return reduce(lambda a, b: a | b, [text_key(F.col(f"`{c}`")).rlike(pattern) for c in cols])


def search(df: DataFrame, q: str | None) -> DataFrame:
    return df if not q else df.where(search_predicate(df, q))


def count(df: DataFrame, q: str | None = None) -> DataFrame:
    """count: rows matching the search (all rows without ``q``)."""
    return search(df, q).agg(F.count(F.lit(1)).alias("count"))


def indexed_search(index: TextIndex, q: str) -> DataFrame:
    """``search`` of a table with a trigram index: files that can't hold a match
    are not opened."""
    check_java_regex(index.spark, q)
    return search(index.candidates(q), q)


def page(
    df: DataFrame,
    q: str | None = None,
    cols: list[str] | None = None,
    sort: str | None = None,
    order: int = -1,
    offset: int = 0,
    limit: int = 200,
    row_key: str | None = None,
    slices: int | None = None,
) -> DataFrame:
    """One page of the searched rows, projected to ``cols``. Sorted by
    ``sort`` (ascending iff ``order == 1``, NULLs last), ties and the
    unsorted case in ``row_key`` order, so pages are stable. The row key is by
    default the column of the order id role; a table without one is ordered
    by all its sortable visible columns, then by the rows' places, which spreads
    equal rows over slices. Rows are cut by distributed row
    numbering over ``slices`` slices (default: by the counted rows); only the
    visible columns and the row key are moved."""
    found = search(df, q)
    visible, moved, ordering = _page_shape(df, cols, sort, order, row_key)
    rows = found.select(*[F.col(f"`{c}`") for c in moved])
    if not (row_key or resolve_all(df.columns).get("order_id")):
        rows = _placed(found, moved)
        ordering += [F.col(c).asc() for c in PLACE]
    return _page(rows, ordering, offset, limit, slices).select(*[F.col(f"`{c}`") for c in visible])


def _page_shape(
    df: DataFrame, cols: list[str] | None, sort: str | None, order: int, row_key: str | None
) -> tuple[list[str], list[str], list[Column]]:
    """The visible columns, those with the row key, and the order of a page."""
    if cols:
        missing = [c for c in cols if c not in df.columns]
        if missing:
            raise MissingColumnError(f"invalid columns: {missing}")
    visible = list(cols) if cols else list(df.columns)
    if sort and sort not in visible:
        raise MissingColumnError(f"invalid sort column: {sort}")
    if row_key is not None and row_key not in df.columns:
        raise MissingColumnError(f"row key {row_key!r} not in the table")
    row_key = row_key or resolve_all(df.columns).get("order_id")
    sortable = [c for c in visible if not _holds(df.schema[c].dataType, (T.MapType, T.VariantType))]
    ties = [row_key] if row_key else sortable
    return visible, list(dict.fromkeys(visible + ties)), page_order(sort, order, ties)


def indexed_page(
    index: OrderIndex,
    q: str | None = None,
    cols: list[str] | None = None,
    offset: int = 0,
    limit: int = 200,
) -> DataFrame:
    """The same page as ``page``, of a table with an order index for its sort
    column: reads the slices that hold the page, for any offset."""
    if cols:
        missing = [c for c in cols if c not in index.columns]
        if missing:
            raise MissingColumnError(f"invalid columns: {missing}")
    return index.page(offset, limit, cols, _named_search(q))


def _named_search(q: str | None):
    return (f"regex:{q}", lambda df: search_predicate(df, q)) if q else None


def indexed_page_meta(
    index: OrderIndex, q: str | None = None, cols: list[str] | None = None, order: int = -1, offset: int = 0, limit: int = 200
) -> DataFrame:
    """``page_meta`` of an indexed table: the total is in the fences or in the
    counts that the searched page itself needs, so the table isn't scanned again."""
    named = _named_search(q)
    known = index.counts(*named) if named else index.fences()
    total = known.agg(F.coalesce(F.max(F.col("offset") + F.col("rows")), F.lit(0)).cast("bigint").alias("total"))
    return _meta_row(total, list(cols) if cols else index.columns, index.sort, order, offset, limit)


def page_and_meta(
    df: DataFrame, q: str | None = None, cols: list[str] | None = None, sort: str | None = None,
    order: int = -1, offset: int = 0, limit: int = 200, row_key: str | None = None,
) -> tuple[DataFrame, dict]:
    """A page and its metadata from one run over a table without an index: the
    total is observed (``DataFrame.observe``) while the rows pass to the sort. Each
    task keeps its first ``offset + limit`` rows, so this is for pages near the
    front; deep pages belong to ``order_index``. The page is written to the shared
    folder, as it would else be computed again for each use."""
    if offset < 0:
        raise ValueError("offset must be >= 0")
    if not (1 <= limit <= 5000):
        raise ValueError("limit must be within 1..5000")
    visible, moved, ordering = _page_shape(df, cols, sort, order, row_key)
    seen = Observation()
    rows = search(df, q).select(*[F.col(f"`{c}`") for c in moved]).observe(seen, F.count(F.lit(1)).alias("total"))
    first = rows.orderBy(*ordering).limit(offset + limit).offset(offset)
    ensure_checkpoint_dir(df.sparkSession)
    shown = first.select(*[F.col(f"`{c}`") for c in visible]).checkpoint(eager=True)
    total = seen.get["total"]
    meta = {
        "total": total, "returned": max(0, min(total - offset, limit)), "offset": offset, "limit": limit,
        "columns": visible, "sorted_by": sort, "order": "asc" if order == 1 else ("desc" if sort else None),
    }
    return shown, meta


def _placed(found: DataFrame, moved: list[str]) -> DataFrame:
    """``moved`` columns and the place of each row: its file and row number
    there, or, for rows that are no plain scan of such files, its position in
    the running query (only rows with equal sortable columns can swap places)."""
    cols = [F.col(f"`{c}`") for c in moved]
    try:
        file = found.metadataColumn("_metadata")
        return found.select(*cols, file["file_path"].alias(PLACE[0]), file["row_index"].alias(PLACE[1]))
    except AnalysisException:
        return found.select(*cols, F.lit("").alias(PLACE[0]), F.monotonically_increasing_id().alias(PLACE[1]))


def _holds(dtype: T.DataType, kinds: tuple[type, ...]) -> bool:
    """Whether a type is, or contains, one of ``kinds`` (types without an order)."""
    if isinstance(dtype, T.StructType):
        return any(_holds(f.dataType, kinds) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _holds(dtype.elementType, kinds)
    return isinstance(dtype, kinds)


def page_meta(
    df: DataFrame,
    q: str | None = None,
    cols: list[str] | None = None,
    sort: str | None = None,
    order: int = -1,
    offset: int = 0,
    limit: int = 200,
) -> DataFrame:
    """What the page is a page of, as one row: total, returned, offset, limit,
    columns, sorted_by, order."""
    total = search(df, q).agg(F.count(F.lit(1)).alias("total"))
    return _meta_row(total, list(cols) if cols else list(df.columns), sort, order, offset, limit)


def _meta_row(total: DataFrame, visible: list[str], sort: str | None, order: int, offset: int, limit: int) -> DataFrame:
    returned = F.greatest(F.least(F.col("total") - F.lit(offset), F.lit(limit)), F.lit(0))
    direction = "asc" if order == 1 else ("desc" if sort else None)
    return total.select(
        "total",
        returned.alias("returned"),
        F.lit(offset).alias("offset"),
        F.lit(limit).alias("limit"),
        F.array(*[F.lit(c) for c in visible]).alias("columns"),
        F.lit(sort).cast("string").alias("sorted_by"),
        F.lit(direction).cast("string").alias("order"),
    )


def is_numeric(df: DataFrame, column: str) -> bool:
    field = df.schema[column]
    return isinstance(field.dataType, (T.NumericType, T.BooleanType))


def boolean_summary(df: DataFrame, column: str) -> DataFrame:
    """count, unique, top, freq of a boolean column (NULLs not counted;
    a tie for the most frequent value goes to the smaller one)."""
    c = F.col(f"`{column}`")
    counts = df.where(c.isNotNull()).groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    # at most two groups reach this aggregate
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        F.max_by("value", F.struct(F.col("n"), ~F.col("value"))).alias("top"),
        F.max("n").alias("freq"),
    )


def numeric_summary(df: DataFrame, column: str) -> DataFrame:
    """count, mean, std (sample), min, p25, p50, p75, max (all double). One
    row also for an empty column: count 0, the others NULL."""
    if column not in df.columns:
        raise MissingColumnError(f"invalid column: {column}")
    x = F.nanvl(F.col(f"`{column}`").cast("double"), F.lit(None).cast("double"))
    rows = df.select(F.lit(0).alias("_g"), x.alias("_x"))
    moments = rows.agg(
        F.lit(0).alias("_m"),
        F.count("_x").cast("double").alias("count"),
        F.avg("_x").alias("mean"),
        F.stddev_samp("_x").alias("std"),
        F.min("_x").alias("min"),
        F.max("_x").alias("max"),
    )
    q = group_quantiles(rows, ["_g"], "_x", DESCRIBE_PROBS).drop("count")
    return moments.join(q, F.col("_m") == F.col("_g"), "left").select("count", "mean", "std", "min", "p25", "p50", "p75", "max")


def top_values(df: DataFrame, column: str, n: int = TOP_VALUES) -> DataFrame:
    """value, count: the ``n`` most frequent values as text (NULL as ``nan``)."""
    if column not in df.columns:
        raise MissingColumnError(f"invalid column: {column}")
    return (
        df.groupBy(text_key(F.col(f"`{column}`")).alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), F.col("value").asc())
        .limit(n)
    )


def top_values_pruned(df: DataFrame, column: str, n: int = TOP_VALUES) -> DataFrame:
    """The same rows as ``top_values`` for a column with very many values: a
    bounded summary leaves out values that can't be among the ``n`` before they are
    shuffled (``operators/top_counts``). Two or three scans of the column."""
    if column not in df.columns:
        raise MissingColumnError(f"invalid column: {column}")
    return top_counts(df.select(text_key(F.col(f"`{column}`")).alias("value")), n)


def feature_summary(df: DataFrame, column: str) -> DataFrame:
    """Numeric columns → ``numeric_summary``; booleans → ``boolean_summary``;
    anything else (text, dates) → ``top_values``."""
    if column not in df.columns:
        raise MissingColumnError(f"invalid column: {column}")
    if isinstance(df.schema[column].dataType, T.BooleanType):
        return boolean_summary(df, column)
    return numeric_summary(df, column) if is_numeric(df, column) else top_values(df, column)
