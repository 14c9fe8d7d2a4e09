import os
import tempfile

from pyspark.sql import functions as F

from orderscope.plans import finance, overview
from orderscope.sources.mapping import star_fact
from orderscope.sources.readers import read_orders
from orderscope.sources.sinks import write_dataset
from orderscope.sources.store import materialised_fact

SF = "/root/testdata/sf0.001"


def _scratch() -> str:
    return tempfile.mkdtemp(prefix="orderscope-test-", dir=os.environ.get("TMPDIR", "/tmp"))


def test_csv_json_round_trip_through_aliases(spark):
    raw = spark.createDataFrame(
        [("1", "2024-03-01 10:00:00", "iFood", "Centro", "50.5", "2"),
         ("2", "2024-03-02 11:30:00", "Rappi", "Norte", "abc", "1"),
         ("3", "2024-03-02 12:00:00", "iFood", "Centro", "20", "0")],
        "id_pedido string, data_pedido string, plataforma string, macro_bairro_nome string, valor_total string, qtd_itens string",
    )
    base = _scratch()
    write_dataset(raw, f"{base}/csv", fmt="csv")
    write_dataset(raw, f"{base}/json", fmt="json")
    for fmt in ("csv", "json"):
        fact = read_orders(spark, f"{base}/{fmt}", fmt=fmt)
        assert {"order_id", "order_datetime", "platform", "macro_bairro", "total_brl", "num_itens"} <= set(fact.columns)
        rows = {r.platform: (r.orders) for r in overview.by_platform(fact).collect()}
        assert rows == {"iFood": 2, "Rappi": 1}
        k = overview.kpis(fact).first()
        assert k.receita_total == 70.5 and k.ticket_medio == 25.25  # "abc" → NULL; items 0 → excluded


def test_materialised_fact_equals_direct_build(spark):
    direct = star_fact(spark, SF)
    stored = materialised_fact(spark, SF, "star")
    assert sorted(stored.columns) == sorted(direct.columns)
    assert stored.count() == direct.count()
    cols = direct.columns
    assert stored.select(*cols).exceptAll(direct).count() == 0
    # second call reuses the committed table
    again = materialised_fact(spark, SF, "star")
    assert again.inputFiles() == stored.inputFiles()


def test_month_partitioned_fact_prunes_by_partition(spark):
    from orderscope.operators.filters import FilterSpec
    from orderscope.sources.store import write_fact

    path = f"{_scratch()}/fact_m"
    write_fact(star_fact(spark, SF), path, files=2, partition_by_month=True)
    fact = spark.read.parquet(path)
    assert "order_month" in fact.columns
    spec = FilterSpec(start_date="1997-01-01", end_date="1997-03-31")
    got = finance.kpis(fact, spec).first()
    want = finance.kpis(star_fact(spark, SF), spec).first()
    assert got.total_pedidos == want.total_pedidos > 0
    plan = fact.where(F.col("order_month") >= F.lit("1997-01-01").cast("date"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


def test_table_source_and_sink_round_trip(spark):
    name = "orderscope_test_orders"
    raw = spark.createDataFrame(
        [(1, "2024-01-01 10:00:00", "a", 10.0), (2, "2024-01-02 11:00:00", "b", 5.0)],
        "pedido_id long, created_at string, plataforma string, total double",
    )
    write_dataset(raw, name, fmt="table", mode="overwrite")
    fact = read_orders(spark, name, fmt="table")
    assert {"order_id", "order_datetime", "platform", "total_brl"} <= set(fact.columns)
    assert finance.kpis(fact).first().receita_total == 15.0
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def _copy_sources(spark) -> str:
    base = _scratch()
    for t in ("orders", "lineitem", "customer", "nation"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{base}/{t}.parquet")
    return base


def test_stored_fact_follows_its_sources(spark):
    base = _copy_sources(spark)
    before = finance.orders_count(materialised_fact(spark, base)).first()[0]
    more = spark.read.parquet(f"{base}/orders.parquet").limit(100).withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000)
    more.write.mode("append").parquet(f"{base}/orders.parquet")
    assert finance.orders_count(materialised_fact(spark, base)).first()[0] == before + 100


def test_stored_fact_sees_nested_source_files(spark):
    from orderscope.sources.store import MAPPING_TABLES, _source_signature

    base = _scratch()
    ev = spark.read.parquet(f"{SF}/events.parquet").withColumn("p", F.col("event_id") % 3)
    ev.write.partitionBy("p").parquet(f"{base}/events.parquet")
    first = _source_signature(spark, base, MAPPING_TABLES["events"])
    assert first == _source_signature(spark, base, MAPPING_TABLES["events"])
    ev.limit(10).write.mode("append").partitionBy("p").parquet(f"{base}/events.parquet")
    assert first != _source_signature(spark, base, MAPPING_TABLES["events"])


def test_null_variant_and_month_layout_come_from_the_stored_fact(spark):
    star = materialised_fact(spark, SF, "star")
    nulls = materialised_fact(spark, SF, "star_nulls")
    assert nulls.columns == star.columns and sorted(nulls.inputFiles()) == sorted(star.inputFiles())
    assert nulls.where("platform IS NULL AND order_id % 97 <> 0").isEmpty()
    assert nulls.where("platform IS NULL").count() == star.where("order_id % 97 = 0").count()
    month = materialised_fact(spark, SF, "star", partition_by_month=True)
    assert month.drop("order_month").exceptAll(star).isEmpty() and month.count() == star.count()


def test_scratch_checkpoint_folder_is_remembered():
    import subprocess
    import sys

    code = (
        "from orderscope.session import get_session, ensure_checkpoint_dir as e\n"
        "s = get_session('local[1]', shuffle_partitions=1)\n"
        "assert s.conf.get('spark.checkpoint.dir', None) is None\n"
        "assert e(s) == e(s.newSession()) and 'orderscope-ckpt-' in e(s)\n"
    )
    env = dict(os.environ, SPARK_CONF_DIR=_scratch())
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, env=env, timeout=120)
