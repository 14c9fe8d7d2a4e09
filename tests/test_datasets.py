import pytest
from pyspark.sql import functions as F

from orderscope.operators.filters import FilterSpec
from orderscope.plans import explore, finance, meta, ops, overview, satisfaction
from orderscope.sources.columns import MissingColumnError

from conftest import make_fact, ts


def test_pedidos_por_dia_uses_elapsed_days(spark):
    fact = make_fact(
        spark,
        [dict(order_id=1, order_datetime=ts("2024-01-01 23:00")), dict(order_id=2, order_datetime=ts("2024-01-02 01:00"))],
    )
    r = overview.kpis(fact).first()
    assert r.pedidos_por_dia == 2.0  # 0 elapsed days + 1, not 2 calendar days
    assert r.total_pedidos == 2 and r.receita_total == 0.0


def test_ticket_mean_skips_zero_items(spark):
    fact = make_fact(
        spark,
        [
            dict(order_id=1, total_brl=1.0, num_itens=0.0),
            dict(order_id=2, total_brl=0.0, num_itens=0.0),
            dict(order_id=3, total_brl=4.0, num_itens=2.0),
        ],
    )
    assert overview.kpis(fact).first().ticket_medio == 2.0
    # finance ticket is Σ total / Σ items
    assert finance.kpis(fact).first().ticket_medio == 2.5


def test_cancel_rate_regex_and_null_status(spark):
    fact = make_fact(
        spark,
        [dict(order_id=1, status="CANCELADO"), dict(order_id=2, status="entregue"), dict(order_id=3, status=None)],
    )
    assert overview.kpis(fact).first().cancelados_pct == pytest.approx(100 / 3)
    # a missing status is matched as the text "nan"
    assert overview.kpis(fact, cancel_match="^nan$").first().cancelados_pct == pytest.approx(100 / 3)
    dist = {r.status: r["count"] for r in overview.status_distribution(fact).collect()}
    assert dist == {"CANCELADO": 1, "entregue": 1, "nan": 1}
    assert overview.kpis(fact.drop("status")).first().cancelados_pct is None


def test_late_rate_unknown_delay_counts_on_time(spark):
    fact = make_fact(
        spark,
        [
            dict(order_id=1, macro_bairro="X", actual_delivery_minutes=25.0, eta_minutes_quote=20.0),
            dict(order_id=2, macro_bairro="X", actual_delivery_minutes=15.0, eta_minutes_quote=20.0),
            dict(order_id=3, macro_bairro="X", actual_delivery_minutes=None, eta_minutes_quote=20.0),
            dict(order_id=4, macro_bairro=None, actual_delivery_minutes=50.0, eta_minutes_quote=20.0),
        ],
    )
    rows = {r.macro_bairro: r for r in ops.late_rate_by_macro(fact).collect()}
    assert (rows["X"].late_count, rows["X"].on_time_count) == (1, 2)
    assert rows["X"].late_rate == pytest.approx(1 / 3)
    assert rows["nan"].late_count == 1  # missing area kept under "nan"
    # delivery_status is ignored by this dataset, threshold is not
    spec = FilterSpec(delivery_status="no_prazo", threshold_min=10)
    rows = {r.macro_bairro: r for r in ops.late_rate_by_macro(fact, spec).collect()}
    assert rows["X"].late_count == 0 and rows["nan"].late_count == 1
    total = sum(r.late_count + r.on_time_count for r in ops.late_rate_by_macro(fact).collect())
    assert total == 4
    rows = {r.macro_bairro: r.unknown_count for r in ops.late_rate_by_macro(fact, unknown_count=True).collect()}
    assert rows == {"X": 1, "nan": 0}


def test_delay_heatmap_keeps_all_null_group(spark):
    fact = make_fact(
        spark,
        [
            dict(order_id=1, macro_bairro="X", actual_delivery_minutes=25.0, eta_minutes_quote=20.0),
            dict(order_id=2, macro_bairro="Y", actual_delivery_minutes=None, eta_minutes_quote=20.0),
            dict(order_id=3, macro_bairro=None, actual_delivery_minutes=30.0, eta_minutes_quote=20.0),
        ],
    )
    rows = [(r.macro_bairro, r.avg_delay) for r in ops.delay_heatmap_by_macro(fact).collect()]
    assert rows == [("X", 5.0), ("Y", None)]


def test_item_class_by_count_and_synonyms(spark):
    fact = make_fact(
        spark,
        [
            dict(order_id=1, total_brl=10.0, num_itens=1.0),
            dict(order_id=2, total_brl=20.0, num_itens=3.0),
            dict(order_id=3, total_brl=40.0, num_itens=4.0),
            dict(order_id=4, total_brl=5.0, num_itens=None),
        ],
    )
    rows = [(r.classe, r.revenue) for r in finance.revenue_by_item_class(fact).collect()]
    assert rows == [("individual", 15.0), ("combo", 20.0), ("família", 40.0)]

    raw = fact.withColumn("tipo", fact.order_id.cast("string"))
    mapping = {"1": "Individual", "2": "1", "3": "combo", "4": "FAMÍLIA"}
    from pyspark.sql import functions as F

    tipo = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[F.col("tipo")]
    raw = raw.withColumn("tipo", tipo).unionByName(
        make_fact(spark, [dict(order_id=5, total_brl=1.0)]).withColumn("tipo", F.lit("x"))
    )
    rows = [(r.classe, r.revenue) for r in finance.revenue_by_item_class(raw, class_col="tipo").collect()]
    # synonyms are mapped after the sum: two "individual" rows, unknown classes last
    # raw "1" (order 2) sorts before raw "Individual" (order 1) within the rank
    assert rows == [("individual", 20.0), ("individual", 10.0), ("combo", 40.0), ("família", 5.0), ("x", 1.0)]
    merged = [(r.classe, r.revenue) for r in finance.revenue_by_item_class(raw, class_col="tipo", merge_synonyms=True).collect()]
    assert merged == [("individual", 30.0), ("combo", 40.0), ("família", 5.0), ("x", 1.0)]


def test_page_sort_is_stable_with_nulls_last(spark):
    df = spark.createDataFrame([(0, 1), (1, 2), (2, 1), (3, None), (4, 2)], "i long, k long")
    desc = [r.i for r in explore.page(df, sort="k", order=-1, row_key="i").collect()]
    asc = [r.i for r in explore.page(df, sort="k", order=1, row_key="i").collect()]
    assert desc == [1, 4, 0, 2, 3] and asc == [0, 2, 1, 4, 3]
    assert [r.i for r in explore.page(df, sort="k", order=1, offset=2, limit=2, row_key="i").collect()] == [1, 4]
    with pytest.raises(ValueError):
        explore.page(df, limit=0, row_key="i")
    with pytest.raises(MissingColumnError):
        explore.page(df, cols=["i"], sort="k", row_key="i")  # sort column must be projected


def test_search_is_unicode_case_insensitive(spark):
    df = spark.createDataFrame([(1, "São Paulo", None), (2, "Rio", "x")], "id long, city string, note string")
    assert explore.count(df, "SÃO").first()["count"] == 1
    assert explore.count(df, "^nan$").first()["count"] == 1  # NULL cell searched as "nan"
    assert explore.count(df).first()["count"] == 2
    meta_row = explore.page_meta(df, q="o", sort="id", order=1, limit=1).first()
    assert (meta_row.total, meta_row.returned, meta_row.order) == (2, 1, "asc")


def test_top_n_bounds(spark):
    fact = make_fact(spark, [dict(order_id=i, macro_bairro=f"m{i % 3}", cliente_id=i % 4, total_brl=float(i)) for i in range(12)])
    assert overview.top_macro_by_orders(fact, n=2).count() == 2
    with pytest.raises(ValueError):
        overview.top_macro_by_orders(fact, n=0)
    with pytest.raises(ValueError):
        finance.top_clients(fact, n=-1)
    assert finance.top_clients(fact, n=0).count() == 0
    top = [(r.cliente_id, r.spent) for r in finance.top_clients(fact, n=2).collect()]
    assert top == [(3, 21.0), (2, 18.0)]


def test_revenue_without_commission_column(spark):
    fact = make_fact(spark, [dict(order_id=1, platform="A", total_brl=10.0, platform_commision_pct=0.1)])
    r = finance.revenue_by_platform(fact).first()
    assert (r.receita_bruta, r.receita_liquida) == (10.0, 9.0)
    r = finance.revenue_by_platform(fact.drop("platform_commision_pct")).first()
    assert r.receita_liquida == 10.0
    with pytest.raises(MissingColumnError):
        finance.margin_by_platform(fact.drop("platform_commision_pct"))
    assert "net" not in finance.timeseries_revenue(fact.drop("platform_commision_pct").withColumn(
        "order_datetime", __import__("pyspark.sql.functions", fromlist=["x"]).lit(ts("2024-01-01"))
    )).columns


def test_margin_zero_gross_is_zero(spark):
    fact = make_fact(spark, [dict(order_id=1, platform="A", total_brl=0.0, platform_commision_pct=0.1)])
    assert finance.margin_by_platform(fact).first().margin_pct == 0.0


def test_ops_kpis_missing_columns_give_zero(spark):
    fact = make_fact(spark, [dict(order_id=1, actual_delivery_minutes=30.0, eta_minutes_quote=25.0)])
    r = ops.kpis(fact.drop("distance_km", "tempo_preparo_minutes")).first()
    assert r.distancia_media == 0.0 and r.atraso_medio == 5.0 and r.on_time_rate_pct == 0.0
    assert ops.kpis(fact, grace_min=5).first().on_time_rate_pct == 100.0


def test_orders_by_hour_share_sums_to_one(spark):
    fact = make_fact(spark, [dict(order_id=i, order_datetime=ts(f"2024-01-01 {i % 5:02d}:30")) for i in range(13)])
    rows = ops.orders_by_hour(fact).collect()
    assert [r.hour for r in rows] == [0, 1, 2, 3, 4]
    assert sum(r.share for r in rows) == pytest.approx(1.0)


def test_weekday_is_monday_zero(spark):
    # 2024-01-01 is a Monday, 2024-01-07 a Sunday
    fact = make_fact(
        spark,
        [
            dict(order_id=1, order_datetime=ts("2024-01-01 10:00"), actual_delivery_minutes=10.0),
            dict(order_id=2, order_datetime=ts("2024-01-07 10:00"), actual_delivery_minutes=30.0),
            dict(order_id=3, order_datetime=ts("2024-01-07 11:00"), actual_delivery_minutes=50.0),
        ],
    )
    rows = [(r.weekday, r["count"], r.median) for r in ops.delivery_by_weekday(fact).collect()]
    assert rows == [(0, 1, 10.0), (6, 2, 40.0)]
    heat = {(r.hour, r.weekday): r.value for r in ops.heatmap_hour_weekday(fact).collect()}
    assert heat == {(10, 0): 10.0, (10, 6): 30.0, (11, 6): 50.0}


def test_satisfaction_scatter_fixed_schema(spark):
    fact = make_fact(
        spark,
        [dict(order_id=1, order_datetime=ts("2024-01-01 10:00"), actual_delivery_minutes=10.0, satisfacao_nivel=4.0)],
    ).drop("platform")
    r = satisfaction.scatter_time_score(fact).first()
    assert r.date == "2024-01-01 10:00:00" and r.platform is None and r.macro_bairro == "nan"
    pruned = satisfaction.scatter_time_score(fact, prune_empty=True)
    assert "platform" not in pruned.columns and "eta_minutes" not in pruned.columns and "order_id" in pruned.columns


def test_meta_lists(spark):
    fact = make_fact(spark, [dict(order_id=1, platform="b"), dict(order_id=2, platform="a"), dict(order_id=3)])
    assert [r.platform for r in meta.platforms(fact).collect()] == ["a", "b"]
    empty = make_fact(spark, [])
    r = meta.date_range(empty).first()
    assert r.periodo_min is None and r.periodo_max is None


def test_every_dataset_runs_on_empty_input(spark):
    empty = make_fact(spark, [])
    frames = [
        overview.kpis(empty), overview.timeseries_orders(empty), overview.timeseries_revenue_with_orders(empty),
        overview.by_platform(empty), overview.top_macro_by_orders(empty), overview.status_distribution(empty),
        overview.ticket_histogram(empty), overview.macro_avg_revenue(empty), overview.macro_choropleth(empty),
        ops.kpis(empty), ops.timeseries_delivery(empty), ops.boxplot_delivery_by_macro(empty),
        ops.delay_heatmap_by_macro(empty), ops.scatter_distance_delivery(empty), ops.orders_by_hour(empty),
        ops.late_rate_by_macro(empty), ops.percentiles_by_macro(empty), ops.delivery_by_weekday(empty),
        ops.avg_delivery_by_hour(empty), ops.heatmap_hour_weekday(empty), ops.late_rate_by_platform(empty),
        finance.kpis(empty), finance.orders_count(empty), finance.timeseries_revenue(empty),
        finance.margin_by_platform(empty), finance.revenue_by_class(empty), finance.top_clients(empty),
        finance.revenue_by_platform(empty), finance.revenue_by_macro(empty), finance.revenue_by_item_class(empty),
        satisfaction.kpis(empty), satisfaction.by_macro(empty), satisfaction.scatter_time_score(empty),
        satisfaction.timeseries(empty), satisfaction.by_platform(empty),
    ]
    counts = [f.count() for f in frames]
    one_row = {0, 9, 21, 22, 30}  # KPI rows are always one row
    assert all(c == (1 if i in one_row else 0) for i, c in enumerate(counts)), counts
    k = overview.kpis(empty).first()
    assert k.total_pedidos == 0 and k.cancelados_pct == 0.0 and k.pedidos_por_dia is None
    s = satisfaction.kpis(empty).first()
    assert (s.nivel_medio, s.pct_muito_satisfeitos, s.total_avaliacoes) == (0.0, 0.0, 0)


def test_catalogue_counts(spark):
    fact = make_fact(spark, [dict(order_id=1, platform="a"), dict(order_id=2), dict(order_id=3, platform="b")])
    rows = {r.column: (r.dtype, r.non_null, r.rows) for r in explore.catalogue(fact).collect()}
    assert rows["order_id"] == ("bigint", 3, 3) and rows["platform"] == ("string", 2, 3)
    assert rows["total_brl"] == ("double", 0, 3) and len(rows) == len(fact.columns)


def test_elapsed_days_ignore_session_dst(spark):
    # 2024-03-10 02:30 does not exist in New York (clocks jump 02:00 → 03:00)
    fact = make_fact(
        spark,
        [dict(order_id=1, order_datetime=ts("2024-03-09 02:45")), dict(order_id=2, order_datetime=ts("2024-03-10 02:30"))],
    )
    tz = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        r = overview.kpis(fact).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", tz)
    assert r.pedidos_por_dia == 2.0  # 23h45 elapsed: 0 whole days + 1


def test_pages_match_the_full_sort(spark):
    from orderscope.operators.ranking import page

    df = spark.range(0, 3000).select(
        F_col("id"), ((F_col("id") * 7919) % 101).alias("k"), (F_col("id") % 3 == 0).alias("flag")
    )
    order = [F_col("k").desc_nulls_last(), F_col("id").asc_nulls_last()]
    ordered = [r.id for r in df.orderBy(*order).collect()]
    for offset, limit in ((0, 50), (1234, 700), (2990, 50), (3000, 5)):
        for slices in (None, 7):
            assert [r.id for r in page(df, order, offset, limit, slices=slices).collect()] == ordered[offset:offset + limit]


def test_page_moves_only_visible_columns_once(spark):
    df = spark.range(1000).selectExpr("id AS id_pedido", "id % 7 AS k", "repeat('x', 100) AS wide")
    got = explore.page(df, cols=["k"], sort="k", order=1, offset=10, limit=5, slices=4)  # key: the order id role
    assert got.columns == ["k"] and [r.k for r in got.collect()] == [0] * 5
    from pyspark.sql import functions as F

    moved = df.select("k", "id_pedido").repartitionByRange(4, "k", "id_pedido").sortWithinPartitions("k", "id_pedido")
    plan = moved.select("*", F.spark_partition_id())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in plan
    no_key = df.select("k", "wide")  # no order id: ordered by all visible columns
    assert [r.k for r in explore.page(no_key, offset=998, limit=10).collect()] == [6, 6]


def test_summary_of_an_empty_column(spark):
    df = spark.createDataFrame([(1, None)], "order_id long, x double")
    row = explore.feature_summary(df, "x").collect()
    assert len(row) == 1 and row[0]["count"] == 0.0 and row[0]["mean"] is None and row[0]["p50"] is None
    assert explore.feature_summary(df.limit(0), "x").first()["count"] == 0.0


def test_histogram_counts_what_it_leaves_out(spark):
    totals = [10.0, 20.0, float("inf"), float("-inf"), None]
    fact = make_fact(spark, [dict(order_id=i, total_brl=t, num_itens=1.0) for i, t in enumerate(totals)])
    left = overview.ticket_histogram_left_out(fact).first()
    assert (left.binned, left.infinite, left.missing) == (2, 2, 1)
    assert sum(r["count"] for r in overview.ticket_histogram(fact, bins=5).collect()) == 2


def F_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_patterns_validated_by_the_jvm(spark):
    df = spark.createDataFrame([(1, "abc")], "id long, t string")
    with pytest.raises(ValueError):
        explore.count(df, "(?P<x>a)")  # a Python-only named group
    with pytest.raises(ValueError):
        explore.count(df, "a(")
    assert explore.count(df, "a++").first()["count"] == 1  # possessive: Java-only syntax
    with pytest.raises(ValueError):
        overview.kpis(make_fact(spark, [dict(order_id=1, status="x")]), cancel_match="[")


def test_page_without_a_key_spreads_equal_rows(spark, tmp_path, monkeypatch):
    n, largest = 8000, []
    real = explore._page

    def spy(rows, ordering, offset, limit, slices):
        dealt = rows.repartitionByRange(slices, *ordering).groupBy(F.spark_partition_id()).count()
        largest.append(dealt.agg(F.max("count")).first()[0])
        return real(rows, ordering, offset, limit, slices)

    monkeypatch.setattr(explore, "_page", spy)
    made = spark.range(n, numPartitions=2).select(F.when(F.col("id") < 6000, "a").otherwise("b").alias("status"), F.create_map(F.lit("k"), F.lit(1)).alias("m"))
    made.write.parquet(path := str(tmp_path / "few"))
    for df in (made, spark.read.parquet(path)):
        got = explore.page(df, cols=["status"], offset=5998, limit=4, slices=8).collect()
        assert [r.status for r in got] == ["a", "a", "b", "b"]
        assert explore.page(df, cols=["m"], offset=7999, limit=4, slices=8).count() == 1
    assert max(largest) < n / 4
