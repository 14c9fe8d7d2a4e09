"""Pruned top counts equal the full group-by."""

from __future__ import annotations

import collections
import random

import pytest
from pyspark.sql import functions as F

from orderscope.operators import top_counts as module
from orderscope.operators.top_counts import bucket_counts, top_counts


def best(values, n):
    return sorted(collections.Counter(values).items(), key=lambda x: (-x[1], x[0] is not None, x[0] or ""))[:n]


@pytest.mark.parametrize("n", [1, 5, 40])
@pytest.mark.parametrize("kind", ["skewed", "flat", "few", "ties"])
@pytest.mark.parametrize("buckets", [1 << 14, 8])
def test_equal_to_a_full_group_by(spark, monkeypatch, n, kind, buckets):
    monkeypatch.setattr(module, "BUCKETS", buckets)
    rng = random.Random(n)
    values = {
        "skewed": [f"v{int(rng.paretovariate(0.6)) % 5000}" for _ in range(6000)] + ["hot"] * 3000 + [None] * 20,
        "flat": [f"v{i % 1500}" for i in range(3000)],
        "few": ["a", "b", "b", None],
        "ties": [f"t{i}" for i in range(60) for _ in range(3)],
    }[kind]
    frame = spark.createDataFrame([(v,) for v in values], "value string").repartition(4)
    assert [tuple(r) for r in top_counts(frame, n).collect()] == best(values, n)


def test_candidates_alone_are_shuffled(spark):
    """Of 50,000 rare values and three frequent ones few reach the exact count."""
    rare = spark.range(50_000).select(F.col("id").cast("string").alias("value"))
    hot = spark.range(9000).select(F.concat(F.lit("hot"), (F.col("id") % 3).cast("string")).alias("value"))
    frame = rare.union(hot)
    assert {tuple(r) for r in top_counts(frame, 3).collect()} == {(f"hot{i}", 3000) for i in range(3)}
    counted = module._counted(frame, bucket_counts(frame), 3000)
    assert counted.count() < 50


def test_nothing_and_bad_arguments(spark):
    empty = spark.createDataFrame([], "value string")
    assert top_counts(empty, 3).collect() == [] and top_counts(empty, 3).columns == ["value", "count"]
    with pytest.raises(ValueError):
        top_counts(empty, 0)
