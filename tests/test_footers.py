"""Table summaries from file footers."""

from __future__ import annotations

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq

from orderscope.sources.footers import footer_aggregate, table_summary

SCHEMA = "i int, l bigint, s string, d double, b boolean, day date, at timestamp_ntz, nested struct<x: int>, list array<int>, nothing int"
ROWS = [
    (1, 5, "x" * 200 + "b", 1.5, True, dt.date(2024, 1, 5), dt.datetime(2024, 1, 1, 5), (1,), [1], None),
    (None, -7, "x" * 200 + "a", float("nan"), False, dt.date(1999, 12, 31), dt.datetime(1960, 1, 1), None, None, None),
    (3, 2**40, None, -0.5, None, None, None, (None,), [], None),
]


def summary(spark, path):
    return {r["column"]: (r["non_null"], r["rows"], r["least"], r["greatest"]) for r in table_summary(spark, path).collect()}


WANT = {
    "i": (2, 3, "1", "3"), "l": (3, 3, "-7", str(2**40)), "s": (2, 3, "x" * 200 + "a", "x" * 200 + "b"), "d": (3, 3, "-0.5", "nan"),
    "b": (2, 3, "false", "true"), "day": (2, 3, "1999-12-31", "2024-01-05"), "at": (2, 3, "1960-01-01 00:00:00", "2024-01-01 05:00:00"),
    "nested": (2, 3, None, None), "list": (2, 3, None, None), "nothing": (0, 3, None, None),
}


def test_every_type(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame(ROWS, SCHEMA).repartition(2).write.parquet(path)
    assert summary(spark, path) == WANT


def test_footers_answer_without_row_groups(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id", "cast(id AS string) AS s").write.parquet(path)
    pushed, scanned = footer_aggregate(spark, path)
    plan = pushed._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), COUNT(id), MIN(id), MAX(id), COUNT(s)]" in plan
    # what is left reads the text column alone
    left = scanned._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<s:string>" in left
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    assert summary(spark, path) == {"id": (1000, 1000, "0", "999"), "s": (1000, 1000, "0", "999")}


def test_files_without_statistics_are_scanned(spark, tmp_path):
    folder = tmp_path / "plain"
    folder.mkdir()
    for i in range(2):
        pq.write_table(pa.table({"i": [i, None, 7], "s": ["a", "b", None]}), folder / f"{i}.parquet", write_statistics=False)
    assert summary(spark, str(folder)) == {"i": (4, 6, "0", "7"), "s": (4, 6, "a", "b")}


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    spark.createDataFrame([], "i int, s string").write.parquet(path)
    assert summary(spark, path) == {"i": (0, 0, None, None), "s": (0, 0, None, None)}
