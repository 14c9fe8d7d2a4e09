"""The most frequent values of a column with very many, without grouping them all.

A full ``groupBy(value).count()`` shuffles every distinct value, most of them
rare. Here a bounded summary rules out values first:

1. every value falls into one of ``BUCKETS`` buckets in each of ``ROWS`` hash
   rows; the rows of each bucket are counted (partial aggregation: at most
   ``ROWS * BUCKETS`` rows are exchanged per task, and counts of tasks add up). A
   value's count is at most the least of its buckets' counts;
2. values whose bound reaches a first guess are counted exactly. The ``n``-th best
   of these, ``t``, is a sure lower limit of the ``n``-th best of all;
3. if the guess was above ``t``, values whose bound reaches ``t`` are counted
   exactly once more. No other value can be among the best, ties included, so the
   result equals the full group-by.

Only candidates are shuffled. If all values are about equally frequent, every
value is a candidate and the second pass is the full group-by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
ROWS = 2


def _bucket(value: Column, row: int) -> Column:
    return F.pmod(F.xxhash64(value, F.lit(row)), F.lit(BUCKETS)).cast("int")


def bucket_counts(values: DataFrame) -> DataFrame:
    """row, bucket, rows of a frame with one column ``value``: a summary that
    merges by adding. Values are pre-counted by nothing: a hot value is one
    partial row per task."""
    held = F.explode(F.array(*[F.struct(F.lit(r).alias("row"), _bucket(F.col("value"), r).alias("bucket")) for r in range(ROWS)]))
    return values.select(held.alias("b")).groupBy("b.row", "b.bucket").agg(F.count(F.lit(1)).alias("rows"))


def _counted(values: DataFrame, summary: DataFrame, least: int) -> DataFrame:
    """Exact counts of the values whose bound reaches ``least``."""
    kept = values
    for r in range(ROWS):
        kept = kept.withColumn(f"_b{r}", _bucket(F.col("value"), r))
        # At most BUCKETS rows of one number.
        hot = summary.where((F.col("row") == r) & (F.col("rows") >= least)).select(F.col("bucket").alias(f"_b{r}"))
        kept = kept.join(F.broadcast(hot), f"_b{r}", "left_semi")
    return kept.groupBy("value").agg(F.count(F.lit(1)).alias("count"))


def top_counts(values: DataFrame, n: int) -> DataFrame:
    """value, count of the ``n`` most frequent values of a frame with the text
    column ``value``, most frequent first, ties by value. NULL is a value."""
    if n < 1:
        raise ValueError("n must be >= 1")
    order = [F.col("count").desc(), F.col("value").asc_nulls_first()]
    known = bucket_counts(values)
    # At most ROWS * BUCKETS small rows.
    rows = known.collect()
    summary = values.sparkSession.createDataFrame(rows, known.schema)
    first = sorted((r["rows"] for r in rows if r["row"] == 0), reverse=True)
    if not first:
        return values.groupBy("value").agg(F.count(F.lit(1)).alias("count")).limit(0)
    guess = first[min(2 * n, len(first)) - 1]
    best = _counted(values, summary, guess).orderBy(*order).limit(n)
    counts = [r["count"] for r in best.select("count").collect()]  # n numbers
    sure = counts[-1] if len(counts) == n else 1
    return best if sure >= guess else _counted(values, summary, sure).orderBy(*order).limit(n)
