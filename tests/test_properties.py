"""Property tests: the histogram and quantile operators against numpy."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from orderscope.operators.histogram import equal_width_histogram
from orderscope.operators.quantiles import group_quantiles

finite = st.floats(min_value=-1e6, max_value=1e6, allow_nan=False, allow_infinity=False)
# values on a coarse grid repeat often (ties); free floats exercise edges
values = st.one_of(
    st.lists(finite, min_size=1, max_size=60),
    st.lists(st.integers(-20, 20).map(lambda i: i / 4), min_size=1, max_size=60),
)
SETTINGS = settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(xs=values, bins=st.integers(1, 25))
def test_histogram_equals_numpy(spark, xs, bins):
    counts, edges = np.histogram(np.array(xs, dtype=float), bins=bins)
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = equal_width_histogram(df, "x", bins).collect()
    assert [r["count"] for r in got] == counts.tolist()
    assert [r.bin_start for r in got] == edges[:-1].tolist()
    assert [r.bin_end for r in got] == edges[1:].tolist()


@SETTINGS
@given(
    rows=st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(-50, 50).map(lambda i: i / 2)), min_size=1, max_size=80),
    p=st.floats(min_value=0, max_value=1, allow_nan=False),
    slices=st.integers(1, 9),
)
def test_exact_quantiles_equal_numpy(spark, rows, p, slices):
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in group_quantiles(df, ["k"], "v", {"q": p}, slices=slices, with_mean=True).collect()}
    for key in {k for k, _ in rows}:
        x = np.array([v for k, v in rows if k == key])
        assert got[key]["count"] == len(x)
        assert got[key].q == pytest.approx(float(np.quantile(x, p)), abs=1e-9)
        assert got[key].mean == pytest.approx(float(x.mean()), abs=1e-9)
