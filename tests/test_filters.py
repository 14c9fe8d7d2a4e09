import pytest

from orderscope.operators.filters import FilterSpec, apply_filters
from orderscope.sources.columns import MissingColumnError

from conftest import make_fact, ts


def ids(df):
    return sorted(r.order_id for r in df.select("order_id").collect())


@pytest.fixture(scope="module")
def fact(spark):
    return make_fact(
        spark,
        [
            dict(order_id=1, order_datetime=ts("2024-12-31 00:00"), platform="A", macro_bairro="X", order_mode="m1",
                 satisfacao_nivel=5.0, actual_delivery_minutes=30.0, eta_minutes_quote=20.0),
            dict(order_id=2, order_datetime=ts("2024-12-31 12:00"), platform="B", macro_bairro=None, order_mode="m2",
                 satisfacao_nivel=2.0, actual_delivery_minutes=20.0, eta_minutes_quote=20.0),
            dict(order_id=3, order_datetime=ts("2024-12-30 08:00"), platform=None, macro_bairro="Y", order_mode="m1",
                 satisfacao_nivel=None, actual_delivery_minutes=None, eta_minutes_quote=20.0),
            dict(order_id=4, order_datetime=None, platform="A", macro_bairro="X", order_mode=None,
                 satisfacao_nivel=7.0, actual_delivery_minutes=26.0, eta_minutes_quote=20.0),
        ],
    )


def test_end_date_is_midnight(fact):
    # end_date keeps only the first instant of that day (rows at 12:00 leave)
    assert ids(apply_filters(fact, FilterSpec(end_date="2024-12-31"), "overview")) == [1, 3]
    assert ids(apply_filters(fact, FilterSpec(end_date="2024-12-31", end_inclusive_day=True), "overview")) == [1, 2, 3]


def test_start_date_drops_missing_dates(fact):
    assert ids(apply_filters(fact, FilterSpec(start_date="2024-12-31"), "finance")) == [1, 2]


def test_membership_and_nan_token(fact):
    assert ids(apply_filters(fact, FilterSpec(platform=("A",)), "overview")) == [1, 4]
    assert ids(apply_filters(fact, FilterSpec(platform=("nan", "B")), "overview")) == [2, 3]
    assert ids(apply_filters(fact, FilterSpec(macro_bairro=("nan",)), "ops")) == [2]


def test_class_filter_only_overview_and_finance(fact):
    spec = FilterSpec(classe_pedido=("m1",))
    assert ids(apply_filters(fact, spec, "overview")) == [1, 3]
    assert ids(apply_filters(fact, spec, "ops")) == [1, 2, 3, 4]


def test_score_range_only_when_given_except_satisfaction(fact):
    assert ids(apply_filters(fact, FilterSpec(), "overview")) == [1, 2, 3, 4]
    # satisfaction always keeps scores within 1..5 (NULL and 7 leave)
    assert ids(apply_filters(fact, FilterSpec(), "satisfaction")) == [1, 2]
    assert ids(apply_filters(fact, FilterSpec(score_min=3), "overview")) == [1]


def test_delivery_status_ops_threshold_and_satisfaction(fact):
    late = FilterSpec(delivery_status="atrasado", threshold_min=5)
    assert ids(apply_filters(fact, late, "ops")) == [1, 4]
    on_time = FilterSpec(delivery_status="no_prazo", threshold_min=5)
    assert ids(apply_filters(fact, on_time, "ops")) == [2]
    # satisfaction: d > e without a threshold, and after the score filter
    assert ids(apply_filters(fact, FilterSpec(delivery_status="atrasado"), "satisfaction")) == [1]
    # unknown delay leaves in both branches
    assert 3 not in ids(apply_filters(fact, on_time, "ops"))


def test_filter_errors(fact):
    with pytest.raises(ValueError):
        apply_filters(fact, FilterSpec(score_min=4, score_max=2), "overview")
    with pytest.raises(ValueError):
        apply_filters(fact, FilterSpec(score_min=0.5), "overview")
    with pytest.raises(ValueError):
        apply_filters(fact, FilterSpec(delivery_status="late"), "ops")
    with pytest.raises(ValueError):
        apply_filters(fact, FilterSpec(start_date="31/12/2024"), "ops")
    with pytest.raises(MissingColumnError):
        apply_filters(fact.drop("platform"), FilterSpec(platform=("A",)), "ops")
    # a missing score column skips the score filter silently
    assert ids(apply_filters(fact.drop("satisfacao_nivel"), FilterSpec(score_min=3), "overview")) == [1, 2, 3, 4]


def test_date_filter_rejects_an_offset():
    import pytest

    from orderscope.operators.filters import parse_date_literal

    with pytest.raises(ValueError):
        parse_date_literal("2024-01-01T00:00:00+03:00", "start_date")
    assert parse_date_literal("2024-01-01T05:00:00", "start_date").hour == 5
