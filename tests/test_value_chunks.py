"""Chunked value lists: every group's whole list, in bounded arrays."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderscope.operators.quantiles import group_quantiles
from orderscope.operators.value_chunks import count_between, expand, percentiles_from_chunks, value_chunks


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    hot = [("hot", round(rng.gauss(30, 9), 1)) for _ in range(3000)]
    rest = [(rng.choice("abc"), rng.choice([None, 1.0, 2.5, -3.25])) for _ in range(400)]
    return hot + rest + [("none", None), ("none", None), (None, 4.0), ("one", 7.0)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "area string, v double").repartition(5)


def lists(rows):
    out = {}
    for k, v in rows:
        if k is not None:
            out.setdefault(k, []).extend([] if v is None else [v])
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize(("chunk", "slices"), [(4096, None), (7, 6), (1, 3)])
def test_chunks_hold_every_list(table, rows, chunk, slices):
    got, sizes = {}, []
    for r in sorted(value_chunks(table, ["area"], "v", chunk, slices).collect(), key=lambda r: (r["area"], r["chunk"])):
        held = got.setdefault(r["area"], [])
        assert r["first_rank"] == len(held)
        for run in r["runs"]:
            held += [run["value"]] * run["count"]
            assert run["upto"] == len(held)
        assert r["n"] == len(held) - r["first_rank"]
        assert (r["low"], r["high"]) == ((r["runs"][0]["value"], r["runs"][-1]["value"]) if r["runs"] else (None, None))
        sizes.append(len(r["runs"]))
    assert got == lists(rows) and max(sizes) <= chunk and got["none"] == []


def test_percentiles_and_ranges_from_stored_chunks(spark, table, rows, tmp_path):
    value_chunks(table, ["area"], "v", 10, 4).write.parquet(str(tmp_path / "c"))
    chunks = spark.read.parquet(str(tmp_path / "c"))
    probs = {"a": 0.0, "b": 0.31, "c": 0.5, "d": 0.9, "e": 1.0}
    want = {r["area"]: r.asDict() for r in group_quantiles(table.where("area IS NOT NULL"), ["area"], "v", probs).collect()}
    assert {r["area"]: r.asDict() for r in percentiles_from_chunks(chunks, ["area"], probs).collect()} == want
    assert want["hot"]["b"] == float(np.quantile(lists(rows)["hot"], 0.31))
    for lo, hi in ((28.0, 31.5), (-9.0, 0.0), (100.0, 200.0)):
        got = {r["area"]: r["count"] for r in count_between(chunks, ["area"], lo, hi).collect()}
        assert got == {k: sum(lo <= x <= hi for x in v) for k, v in lists(rows).items()}
    back = {}
    for r in expand(chunks, ["area"]).collect():
        back.setdefault(r["area"], []).append(r["value"])
    assert {k: sorted(v) for k, v in back.items()} == {k: v for k, v in lists(rows).items() if v}


def test_nothing_and_bad_arguments(table):
    assert value_chunks(table.limit(0), ["area"], "v").collect() == []
    with pytest.raises(ValueError):
        value_chunks(table, ["area"], "v", 0)
    with pytest.raises(ValueError):
        percentiles_from_chunks(value_chunks(table, ["area"], "v"), ["area"], {"x": 1.5})
    two = value_chunks(table.withColumn("b", F.length("area")), ["area", "b"], "v", 3)
    assert two.where("area = 'hot' AND b = 3").count() > 1
