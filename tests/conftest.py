from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

from orderscope.session import get_session  # noqa: E402

FACT_SCHEMA = (
    "order_id bigint, order_datetime timestamp_ntz, platform string, order_mode string, status string, "
    "macro_bairro string, total_brl double, num_itens double, tempo_preparo_minutos double, "
    "actual_delivery_minutes double, eta_minutes_quote double, distance_km double, "
    "platform_commision_pct double, satisfacao_nivel double, cliente_id bigint"
)
FACT_COLUMNS = [c.strip().split(" ")[0] for c in FACT_SCHEMA.split(",")]


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    return get_session("local[4]", app_name="orderscope-tests", shuffle_partitions=4)


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def make_fact(spark, rows: list[dict]):
    """Canonical fact from partial row dicts (missing fields are NULL)."""
    full = [tuple(r.get(c) for c in FACT_COLUMNS) for r in rows]
    return spark.createDataFrame(full, FACT_SCHEMA)
