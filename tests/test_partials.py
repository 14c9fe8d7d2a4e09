"""Partial states: the same rows as the single datasets, new files only."""

from __future__ import annotations

import datetime as dt
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from orderscope.operators.filters import FilterSpec, apply_filters
from orderscope.plans import finance, ops, overview, refresh, satisfaction
from orderscope.sources.partials import KLL_K, RANK_ERROR, PartialStore

from conftest import make_fact


def orders(first: int, n: int, seed: int) -> list[dict]:
    rng = random.Random(seed)
    some = lambda x: x if rng.random() < 0.85 else None
    out = []
    for i in range(first, first + n):
        at = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(60 * 24 * 40))
        at = rng.choice([at, at, at.replace(hour=0, minute=0)])
        out.append(
            dict(
                order_id=i, order_datetime=some(at), platform=some(rng.choice("PQR")), order_mode=some(rng.choice("xyz")),
                status=some(rng.choice(["ok", "cancelled", "CANCEL"])), macro_bairro=some(rng.choice(["north", "south"])),
                total_brl=some(rng.randrange(400, 9000) / 4), num_itens=some(float(rng.randrange(0, 5))), tempo_preparo_minutos=some(5.0),
                actual_delivery_minutes=some(float(rng.randrange(10, 90))), eta_minutes_quote=some(float(rng.randrange(10, 90))),
                distance_km=some(2.5), platform_commision_pct=some(0.125), satisfacao_nivel=some(rng.choice([0.5, 1.0, 3.5, 4.5, 5.0])),
            )
        )
    return out


def write(spark, folder, name, rows):
    make_fact(spark, rows).coalesce(1).write.parquet(f"{folder}/.{name}")
    part = next(f for f in os.listdir(f"{folder}/.{name}") if f.startswith("part-"))
    shutil.move(f"{folder}/.{name}/{part}", f"{folder}/{name}.parquet")
    shutil.rmtree(f"{folder}/.{name}")


SPECS = [
    None,
    FilterSpec(start_date="2024-01-05", end_date="2024-01-20", platform=("P", "nan"), classe_pedido=("x", "y")),
    FilterSpec(end_date="2024-01-20", end_inclusive_day=True, macro_bairro=("south",), delivery_status="no_prazo"),
    FilterSpec(start_date="2024-01-10 06:00", delivery_status="atrasado"),
    FilterSpec(platform=("nobody",)),
]
PAIRS = [
    (refresh.overview_kpis, overview.kpis), (refresh.timeseries_orders, overview.timeseries_orders),
    (refresh.timeseries_revenue_with_orders, overview.timeseries_revenue_with_orders), (refresh.by_platform, overview.by_platform),
    (refresh.top_macro_by_orders, overview.top_macro_by_orders), (refresh.status_distribution, overview.status_distribution),
    (refresh.macro_avg_revenue, overview.macro_avg_revenue), (refresh.ops_kpis, ops.kpis), (refresh.timeseries_delivery, ops.timeseries_delivery),
    (refresh.delay_heatmap_by_macro, ops.delay_heatmap_by_macro), (refresh.orders_by_hour, ops.orders_by_hour),
    (lambda s, p: refresh.late_rate(s, "platform", p), ops.late_rate_by_platform), (refresh.heatmap_hour_weekday, ops.heatmap_hour_weekday),
    (refresh.finance_kpis, finance.kpis), (refresh.timeseries_revenue, finance.timeseries_revenue), (refresh.margin_by_platform, finance.margin_by_platform),
    (lambda s, p: refresh.revenue_by(s, "macro_bairro", p), finance.revenue_by_macro), (refresh.revenue_by_class, finance.revenue_by_class),
    (refresh.satisfaction_kpis, satisfaction.kpis), (lambda s, p: refresh.satisfaction_by(s, "macro_bairro", p), satisfaction.by_macro),
    (lambda s, p: refresh.satisfaction_by(s, "platform", p), satisfaction.by_platform), (refresh.satisfaction_timeseries, satisfaction.timeseries),
]


def rows(df):
    return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()]


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("partials")
    folder = str(base / "fact")
    os.mkdir(folder)
    for i in range(3):
        write(spark, folder, f"a{i}", orders(1000 * i, 300, i))
    store = PartialStore(spark, folder, str(base / "state"))
    assert store.refresh() == 3
    write(spark, folder, "b", orders(9000, 200, 77))
    assert store.refresh() == 1 and store.refresh() == 0
    return folder, store


@pytest.mark.parametrize("spec", SPECS)
def test_states_answer_like_the_fact(spark, world, spec):
    folder, store = world
    fact, states = spark.read.parquet(folder), store.states()
    for from_states, from_fact in PAIRS:
        one, two = from_states(states, spec), from_fact(fact, spec)
        assert one.columns == two.columns and rows(one) == rows(two), from_fact.__qualname__


def test_one_scan_of_few_rows(world):
    _, store = world
    plan = refresh.dashboard(store.states())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Expand") == 1


def test_dashboard_panels(spark, world):
    folder, store = world
    found = refresh.dashboard(store.states()).collect()
    fact = spark.read.parquet(folder)
    want = {r["platform"]: r["orders"] for r in fact.groupBy("platform").agg(F.count(F.lit(1)).alias("orders")).collect()}
    assert {r["platform"]: r["orders"] for r in found if r["panel"] == "platform"} == want and None in want
    assert [r["orders"] for r in found if r["panel"] == "total"] == [1100]
    assert {r["panel"] for r in found} == {"total", "platform", "macro_bairro", "order_mode", "hour", "platform+macro_bairro"}


def test_new_files_alone_are_read_and_changed_ones_rebuild(spark, tmp_path):
    folder = str(tmp_path / "fact")
    os.mkdir(folder)
    seen = []

    def read(paths):
        seen.append(sorted(os.path.basename(p) for p in paths))
        return spark.read.parquet(*paths)

    write(spark, folder, "a", orders(0, 50, 1))
    store = PartialStore(spark, folder, str(tmp_path / "state"), read)
    with pytest.raises(ValueError):
        store.states()
    store.refresh()
    write(spark, folder, "b", orders(100, 60, 2))
    write(spark, folder, "c", orders(200, 70, 3))
    store.refresh()
    assert seen == [["fact"], ["b.parquet", "c.parquet"]]
    count = lambda: refresh.finance_kpis(store.states()).first()["total_pedidos"]
    assert count() == 180
    before = rows(refresh.dashboard(store.states()).orderBy("panel", "platform", "macro_bairro", "order_mode", "hour"))
    store.compact()
    assert rows(refresh.dashboard(store.states()).orderBy("panel", "platform", "macro_bairro", "order_mode", "hour")) == before
    assert len(store._batches(store._generation())) == 1 and store.refresh() == 0
    assert sum(r["count"] for r in refresh.percentiles_by_macro(store.sketches(), {"p": 0.5}).collect()) > 0
    # A refresh that died before its ledger entry counts for nothing.
    spark.range(3).write.parquet(f"{store.folder}/gen={store._generation()}/states/batch=dead")
    assert count() == 180
    os.remove(f"{folder}/b.parquet")
    write(spark, folder, "d", orders(300, 5, 4))
    assert store.refresh() == 3 and count() == 125 and seen[-1] == ["fact"]


def test_sketches_keep_their_rank_error(spark, tmp_path):
    rng = random.Random(4)
    folder = str(tmp_path / "fact")
    os.mkdir(folder)
    for part in range(4):
        made = [
            dict(order_id=i, order_datetime=dt.datetime(2024, 1, 1 + rng.randrange(20)), platform=rng.choice("PQ"), macro_bairro=rng.choice(["n", "s"]), actual_delivery_minutes=rng.lognormvariate(3, 1))
            for i in range(5000)
        ]
        write(spark, folder, f"p{part}", made)
    store = PartialStore(spark, folder, str(tmp_path / "state"))
    store.refresh()
    probs = {f"p{p}": p / 100 for p in (1, 10, 50, 75, 90, 99)}
    assert 0.005 < RANK_ERROR < 0.02 and KLL_K >= 200
    for days, platforms in (((None, None), ()), (("2024-01-03", "2024-01-12"), ("P",))):
        spec = FilterSpec(start_date=days[0], end_date=days[1], end_inclusive_day=True, platform=platforms)
        kept = apply_filters(spark.read.parquet(folder), spec, "ops")
        estimates = refresh.percentiles_by_macro(store.sketches(), probs, *days, platforms)
        checked = refresh.rank_check(estimates, kept, probs).collect()
        assert len(checked) == 2 and all(r[n] for r in checked for n in probs)
        assert {r["macro_bairro"]: r["count"] for r in checked} == {r["macro_bairro"]: r["count"] for r in kept.groupBy("macro_bairro").count().collect()}


@pytest.mark.parametrize("spec", [FilterSpec(score_min=2.0), FilterSpec(start_date="2024-01-01 10:30"), FilterSpec(delivery_status="atrasado", threshold_min=5.0)])
def test_what_the_states_cannot_answer(world, spec):
    with pytest.raises(ValueError):
        refresh.ops_kpis(world[1].states(), spec)
    with pytest.raises(ValueError):
        refresh.late_rate(world[1].states(), "platform", FilterSpec(threshold_min=5.0))
