"""Datasets vs. pandas expressions written from the dataset definitions, on
random frames with missing keys and measures (the driver tables have none)."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from orderscope.operators.filters import FilterSpec
from orderscope.plans import finance, ops, overview, satisfaction

from conftest import FACT_COLUMNS, FACT_SCHEMA


def _random_orders(seed: int, n: int = 400) -> pd.DataFrame:
    rng = np.random.default_rng(seed)

    def maybe_null(values, p):
        return [None if rng.random() < p else v for v in values]

    start = dt.datetime(2024, 1, 1)
    return pd.DataFrame(
        {
            "order_id": np.arange(n, dtype="int64"),
            "order_datetime": maybe_null(
                [start + dt.timedelta(minutes=int(m)) for m in rng.integers(0, 60 * 24 * 90, n)], 0.05
            ),
            "platform": maybe_null(rng.choice(["iFood", "Rappi", "Uber"], n, p=[0.6, 0.3, 0.1]).tolist(), 0.05),
            "order_mode": maybe_null(rng.choice(["delivery", "pickup"], n).tolist(), 0.05),
            "status": maybe_null(rng.choice(["entregue", "cancelado", "Cancelled"], n).tolist(), 0.05),
            "macro_bairro": maybe_null(rng.choice(list("ABCDEFG"), n).tolist(), 0.08),
            "total_brl": maybe_null(np.round(rng.gamma(3, 20, n), 2).tolist(), 0.05),
            "num_itens": maybe_null(rng.integers(0, 7, n).astype(float).tolist(), 0.05),
            "tempo_preparo_minutos": maybe_null(rng.integers(5, 40, n).astype(float).tolist(), 0.05),
            "actual_delivery_minutes": maybe_null(rng.integers(10, 90, n).astype(float).tolist(), 0.1),
            "eta_minutes_quote": maybe_null(rng.integers(20, 60, n).astype(float).tolist(), 0.1),
            "distance_km": maybe_null(np.round(rng.uniform(0.5, 12, n), 1).tolist(), 0.05),
            "platform_commision_pct": maybe_null(np.round(rng.uniform(0.05, 0.3, n), 2).tolist(), 0.1),
            "satisfacao_nivel": maybe_null((rng.integers(0, 11, n) / 2.0).tolist(), 0.1),
            "cliente_id": maybe_null(rng.integers(0, 50, n).tolist(), 0.05),
        }
    )


@pytest.fixture(scope="module", params=[1, 2])
def frames(spark, request):
    pdf = _random_orders(request.param)

    def py(v):
        if v is None or (isinstance(v, float) and np.isnan(v)) or v is pd.NaT:
            return None
        if isinstance(v, pd.Timestamp):
            return v.to_pydatetime()
        if isinstance(v, np.integer):
            return int(v)
        if isinstance(v, np.floating):
            return float(v)
        return v

    longs = {i for i, c in enumerate(FACT_COLUMNS) if c in ("order_id", "cliente_id")}
    rows = [
        tuple(int(py(v)) if i in longs and py(v) is not None else py(v) for i, v in enumerate(r))
        for r in pdf[FACT_COLUMNS].astype(object).itertuples(index=False)
    ]
    return spark.createDataFrame(rows, FACT_SCHEMA), pdf


def _num(pdf, c):
    return pd.to_numeric(pdf[c], errors="coerce")


def test_counts_by_key(frames):
    sdf, pdf = frames
    got = {r.platform: r.orders for r in overview.by_platform(sdf).collect()}
    assert got == pdf.groupby("platform").size().to_dict()
    got = {r.status: r["count"] for r in overview.status_distribution(sdf).collect()}
    assert got == pdf["status"].fillna("nan").value_counts().to_dict()


def test_means_and_sums_by_area(frames):
    sdf, pdf = frames
    got = {r.macro_bairro: r.avg_receita for r in overview.macro_avg_revenue(sdf).collect()}
    want = pdf.groupby("macro_bairro")["total_brl"].mean().to_dict()
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])
    rows = {r.macro_bairro: (r.receita_bruta, r.receita_liquida) for r in finance.revenue_by_macro(sdf).collect()}
    net = _num(pdf, "total_brl") * (1 - _num(pdf, "platform_commision_pct"))
    gross_w = pdf.groupby("macro_bairro")["total_brl"].sum()
    net_w = net.groupby(pdf["macro_bairro"]).sum()
    for k in gross_w.index:
        assert rows[k] == pytest.approx((gross_w[k], net_w[k]))


def test_late_rate_by_area(frames):
    sdf, pdf = frames
    late = (_num(pdf, "actual_delivery_minutes") - _num(pdf, "eta_minutes_quote")) > 5
    g = pd.DataFrame({"k": pdf["macro_bairro"].fillna("nan"), "late": late}).groupby("k")["late"].agg(["sum", "count"])
    got = {r.macro_bairro: r for r in ops.late_rate_by_macro(sdf, FilterSpec(threshold_min=5)).collect()}
    assert set(got) == set(g.index)
    for k, row in g.iterrows():
        assert (got[k].late_count, got[k].on_time_count) == (row["sum"], row["count"] - row["sum"])
        assert got[k].late_rate == pytest.approx(row["sum"] / row["count"])


def test_percentiles_by_area(frames):
    sdf, pdf = frames
    v = _num(pdf, "actual_delivery_minutes")
    sub = pd.DataFrame({"k": pdf["macro_bairro"], "v": v}).dropna(subset=["v"])
    g = sub.groupby("k")["v"]
    got = {r.macro_bairro: r for r in ops.percentiles_by_macro(sdf).collect()}
    assert set(got) == set(g.groups)
    for k, s in g:
        assert got[k]["count"] == s.count() and got[k].mean == pytest.approx(s.mean())
        for name, p in (("p50", 0.5), ("p75", 0.75), ("p90", 0.9)):
            assert got[k][name] == pytest.approx(s.quantile(p), abs=1e-12)


def test_weekly_series_and_filters(frames):
    sdf, pdf = frames
    spec = FilterSpec(platform=("iFood", "nan"), start_date="2024-01-15", end_date="2024-03-01")
    got = overview.timeseries_orders(sdf, spec, freq="W").collect()
    dtc = pd.to_datetime(pdf["order_datetime"])
    mask = pdf["platform"].astype(str).replace("None", "nan").isin(["iFood", "nan"])
    mask &= (dtc >= "2024-01-15") & (dtc <= "2024-03-01")
    want = dtc[mask].to_frame("dt").set_index("dt").assign(v=1).resample("W")["v"].sum()
    assert [(r.date, r.orders) for r in got] == [(d.date(), int(c)) for d, c in want.items()]


def test_satisfaction_by_area_and_delivery_status(frames):
    sdf, pdf = frames
    s = _num(pdf, "satisfacao_nivel")
    d, e = _num(pdf, "actual_delivery_minutes"), _num(pdf, "eta_minutes_quote")
    keep = (s >= 1) & (s <= 5) & (d > e)
    g = pd.DataFrame({"k": pdf["macro_bairro"], "s": s})[keep].groupby("k")["s"]
    got = {r.macro_bairro: r for r in satisfaction.by_macro(sdf, FilterSpec(delivery_status="atrasado")).collect()}
    assert set(got) == set(g.groups)
    for k, grp in g:
        assert got[k]["count"] == grp.count() and got[k].avg_satisfacao == pytest.approx(grp.mean())


def test_kpi_rows(frames):
    sdf, pdf = frames
    k = overview.kpis(sdf).first()
    total, items = _num(pdf, "total_brl"), _num(pdf, "num_itens")
    ratio = (total / items).replace([np.inf, -np.inf], np.nan)
    assert k.total_pedidos == len(pdf)
    assert k.receita_total == pytest.approx(total.sum())
    assert k.ticket_medio == pytest.approx(ratio.mean())
    cancel = pdf["status"].astype(str).str.contains("cancel", case=False).sum()
    assert k.cancelados_pct == pytest.approx(cancel / len(pdf) * 100)
    o = ops.kpis(sdf, grace_min=3).first()
    d, e = _num(pdf, "actual_delivery_minutes"), _num(pdf, "eta_minutes_quote")
    both = d.notna() & e.notna()
    assert o.atraso_medio == pytest.approx((d - e).mean())
    assert o.on_time_rate_pct == pytest.approx((d[both] <= e[both] + 3).mean() * 100)
