"""The stored order index: the same pages as a full sort, read from few slices."""

from __future__ import annotations

import random
import uuid

import pytest
from pyspark.sql import functions as F

from orderscope.plans import explore
from orderscope.sources.order_index import order_index


RUN = uuid.uuid4().hex  # indexes of an earlier test run lie in the same shared folder


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return [(i, rng.choice([None, 1.5, 2.0, 2.0, 2.0, rng.randint(0, 90) / 4]), rng.choice(["ab", "Bc", None, "x"])) for i in rng.sample(range(9000), 2500)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "order_id bigint, total double, kind string").repartition(6)


def in_order(rows, order):
    def key(r):
        return (r[1] is None, (r[1] if order == 1 else -r[1]) if r[1] is not None else 0, r[0])

    return sorted(rows, key=key)


@pytest.mark.parametrize("order", [1, -1])
@pytest.mark.parametrize("slices", [1, 7])
def test_pages_equal_a_full_sort(table, rows, order, slices):
    index = order_index(table, f"{RUN}t{order}{slices}", "total", order, slices=slices)
    want = in_order(rows, order)
    for offset, limit in ((0, 5), (0, 5000), (700, 900), (2400, 200), (2499, 1), (2500, 10), (99_999, 10)):
        assert [tuple(r) for r in index.page(offset, limit).collect()] == want[offset : offset + limit]
        hits = [r for r in want if "b" in (r[2] or "nan").lower()]
        assert [tuple(r) for r in explore.indexed_page(index, "b", offset=offset, limit=limit).collect()] == hits[offset : offset + limit]
    assert index.total() == 2500
    meta = explore.indexed_page_meta(index, "b", order=order, offset=100, limit=300).first()
    assert (meta["total"], meta["returned"], meta["sorted_by"]) == (len(hits), min(300, len(hits) - 100), "total")


def test_a_page_reads_its_slices_alone(table):
    index = order_index(table, f"{RUN}few", "total", 1, slices=10)
    page = index.page(1200, 50)
    files = {f.split("slice=")[1].split("/")[0] for f in page.inputFiles()}
    assert 1 <= len(files) <= 2
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Join" not in plan and "PushedFilters: [Or" in plan or "PushedFilters: [And" in plan or "_pos" in plan
    # A second index of the same table version is the first one.
    assert order_index(table, f"{RUN}few", "total", 1, slices=10).path == index.path
    assert order_index(table, f"{RUN}fresh", "total", 1, slices=10).path != index.path


@pytest.mark.parametrize("order", [1, -1])
def test_rank_of_a_value(table, rows, order):
    index = order_index(table, f"{RUN}rank{order}", "total", order, slices=9)
    for value in (-1.0, 1.5, 2.0, 7.25, 22.5, 99.0):
        before = sum(r[1] is not None and (r[1] < value if order == 1 else r[1] > value) for r in rows)
        assert index.rank_of(value) == before


def test_observed_page_and_metadata(table, rows):
    shown, meta = explore.page_and_meta(table, "b", ["order_id", "total"], "total", -1, 50, 100, row_key="order_id")
    hits = [r for r in in_order(rows, -1) if "b" in (r[2] or "nan").lower()]
    assert [tuple(r) for r in shown.collect()] == [r[:2] for r in hits[50:150]]
    assert meta == {"total": len(hits), "returned": 100, "offset": 50, "limit": 100, "columns": ["order_id", "total"], "sorted_by": "total", "order": "desc"}
    assert explore.page_and_meta(table, "zzz", offset=3)[1]["returned"] == 0


def test_index_of_nothing_and_bad_arguments(spark, table):
    empty = order_index(table.limit(0), f"{RUN}none", "total", 1)
    assert empty.page(0, 10).collect() == [] and empty.total() == 0 and empty.page(0, 10).columns == table.columns
    assert explore.indexed_page(empty, "b").collect() == []
    index = order_index(table, f"{RUN}few", "total", 1, slices=10)
    for bad in (dict(offset=-1, limit=5), dict(offset=0, limit=0), dict(offset=0, limit=5001)):
        with pytest.raises(ValueError):
            index.page(**bad)
    with pytest.raises(ValueError):
        explore.indexed_page(index, "b", ["nope"])
    with pytest.raises(ValueError):
        order_index(table, "t", "nope", 1)
    with pytest.raises(ValueError):
        order_index(table.withColumn("slice", F.lit(1)), "t", "total", 1)
