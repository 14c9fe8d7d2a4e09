import numpy as np
import pytest

from orderscope.operators.histogram import equal_width_histogram
from orderscope.operators.quantiles import group_quantiles
from orderscope.plans import explore


def _hist(spark, values, bins):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    return [(r.bin_start, r.bin_end, r["count"]) for r in equal_width_histogram(df, "x", bins).collect()]


def test_histogram_constant_input_widened(spark):
    rows = _hist(spark, [5, 5], 3)
    assert [c for _, _, c in rows] == [0, 2, 0]
    assert rows[0][0] == 4.5 and rows[-1][1] == 5.5
    assert rows[1][0] == pytest.approx(4.8333, abs=1e-4)


def test_histogram_last_bin_closed(spark):
    assert [c for _, _, c in _hist(spark, [0, 1, 2, 3], 3)] == [1, 1, 2]


def test_histogram_empty_gives_no_rows(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert equal_width_histogram(df, "x", 5).count() == 0


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(7)
    for trial in range(4):
        values = np.round(rng.lognormal(3, 1, size=400), 3 if trial % 2 else 1)
        bins = int(rng.integers(3, 40))
        counts, edges = np.histogram(values, bins=bins)
        got = _hist(spark, values.tolist(), bins)
        assert [c for _, _, c in got] == counts.tolist()
        assert [s for s, _, _ in got] == edges[:-1].tolist()
        assert got[-1][1] == edges[-1]


def test_quantiles_fixture(spark):
    x = [1.0, 2.0, 4.0, 9.0]
    df = spark.createDataFrame([("a", v) for v in x], "k string, v double")
    probs = {"p50": 0.5, "p75": 0.75, "p90": 0.9}
    r = group_quantiles(df, ["k"], "v", probs).first()
    # the exact path reproduces numpy's linear interpolation bit for bit
    assert (r.p50, r.p75, r.p90, r["count"]) == (3.0, 5.25, float(np.quantile(x, 0.9)), 4)
    b = group_quantiles(df, ["k"], "v", probs, method="buffer").first()
    assert (b.p50, b.p75, b.p90) == pytest.approx((3.0, 5.25, 7.5))


def test_exact_quantiles_match_numpy_with_hot_key(spark):
    rng = np.random.default_rng(11)
    # one key holds most rows, with many repeated and distinct values
    keys = np.where(rng.random(3000) < 0.6, "hot", rng.choice(["a", "b", "c", "d"], 3000))
    vals = np.round(rng.gamma(2.0, 15.0, 3000), 1)
    df = spark.createDataFrame([(str(k), float(v)) for k, v in zip(keys, vals)], "k string, v double")
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = {r.k: r for r in group_quantiles(df, ["k"], "v", probs, slices=7).collect()}
    for k in set(keys.tolist()):
        x = vals[keys == k]
        assert got[k]["count"] == len(x)
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(float(np.quantile(x, p)), abs=1e-9), (k, name)


def test_quantiles_single_value_group_and_nulls(spark):
    df = spark.createDataFrame([("a", 4.0), ("a", None), ("b", None)], "k string, v double")
    rows = {r.k: r for r in group_quantiles(df, ["k"], "v", {"p50": 0.5}).collect()}
    assert set(rows) == {"a"} and rows["a"].p50 == 4.0 and rows["a"]["count"] == 1


def test_numeric_summary_matches_pandas(spark):
    import pandas as pd

    vals = [1.0, 2.0, 4.0, 9.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = explore.numeric_summary(df, "x").first().asDict()
    want = pd.Series(vals, dtype="float64").describe()
    assert got["count"] == want["count"] and got["mean"] == pytest.approx(want["mean"])
    assert got["std"] == pytest.approx(want["std"]) and got["std"] == pytest.approx(3.5590, abs=1e-4)
    assert (got["min"], got["p25"], got["p50"], got["p75"], got["max"]) == (
        want["min"], want["25%"], want["50%"], want["75%"], want["max"]
    )


def test_feature_summary_dispatch(spark):
    df = spark.createDataFrame(
        [(True, "a", 1.0), (False, "b", 2.0), (True, None, None), (None, "a", 4.0)], "flag boolean, txt string, x double"
    )
    b = explore.feature_summary(df, "flag").first()
    assert (b["count"], b.unique, b.top, b.freq) == (3, 2, True, 2)
    t = [(r.value, r["count"]) for r in explore.feature_summary(df, "txt").collect()]
    assert t == [("a", 2), ("b", 1), ("nan", 1)]
    assert explore.feature_summary(df, "x").first()["count"] == 3.0


def test_slice_count_follows_counted_rows(spark):
    from orderscope.operators.sizing import slice_count
    from orderscope.sources.mapping import star_fact

    assert slice_count(spark.range(1000)) == 1
    assert slice_count(spark.range(2_500_001)) == 3
    # A join is counted, not estimated as the product of its inputs.
    assert slice_count(star_fact(spark, "/root/testdata/sf0.01")) == 1
