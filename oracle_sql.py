"""DuckDB SQL for every checked query (driver tables are pre-registered views).

Written from the dataset definitions, not from the Spark code: the fact is
rebuilt with plain joins, buckets with DuckDB's own date functions, the
calendar with ``generate_series``, quantiles with ``quantile_cont``.
Double outputs are rounded half-up exactly as the Spark side does for the
comparison: money sums on a 4-decimal grid, everything else on a 2^-12 grid.
"""

from __future__ import annotations

# ---------------------------------------------------------------- facts

_LI = """li AS (
  SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS num_itens, CAST(max(l_discount) AS DOUBLE) AS pct
  FROM lineitem GROUP BY l_orderkey
)"""


def _star(nulls: bool = False) -> str:
    platform = "CASE WHEN o.o_orderkey % 97 <> 0 THEN c.c_mktsegment END" if nulls else "c.c_mktsegment"
    macro = "CASE WHEN o.o_orderkey % 89 <> 0 THEN n.n_name END" if nulls else "n.n_name"
    return f"""WITH {_LI},
fact AS (
  SELECT o.o_orderkey AS order_id,
         o.o_orderdate + to_minutes(CAST((o.o_orderkey % 24) * 60 + (o.o_orderkey * 7) % 60 AS BIGINT)) AS dt,
         {platform} AS platform,
         o.o_orderpriority AS order_mode,
         o.o_orderstatus AS status,
         {macro} AS macro_bairro,
         CAST(o.o_totalprice AS DOUBLE) AS total,
         li.num_itens AS items,
         CAST(10 + (o.o_orderkey * 7) % 31 AS DOUBLE) AS prep,
         CASE WHEN o.o_orderkey % 50 <> 0 THEN CAST(20 + (o.o_orderkey * 17) % 61 AS DOUBLE) END AS delivery,
         CAST(25 + (o.o_orderkey * 13) % 36 AS DOUBLE) AS eta,
         CAST(5 + (o.o_orderkey * 11) % 140 AS DOUBLE) / 10 AS distance_km,
         li.pct AS pct,
         CASE WHEN o.o_orderkey % 40 <> 0 THEN 1 + CAST((o.o_orderkey * 3) % 9 AS DOUBLE) / 2 END AS score,
         o.o_custkey AS cliente_id
  FROM orders o
  LEFT JOIN customer c ON c.c_custkey = o.o_custkey
  LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
  LEFT JOIN li ON li.l_orderkey = o.o_orderkey
)"""


_EVENTS = r"""WITH ev AS (
  SELECT *, TRY_CAST(regexp_extract(props, '"k"\s*:\s*(-?[0-9]+)', 1) AS BIGINT) AS k FROM events
),
fact AS (
  SELECT event_id AS order_id, ts AS dt, event_type AS platform, CAST(user_id AS VARCHAR) AS macro_bairro,
         value AS total, value AS delivery, CAST(k AS DOUBLE) AS eta, CAST(1 + k % 5 AS DOUBLE) AS score,
         user_id AS cliente_id
  FROM ev
)"""

_SPELL = "['Single', '1', 'COMBO', 'duo', 'Familia', '4+', 'individual', 'Outro']"
_BAD = "['abc', '1,5', '1d', 'nan', '', '  ']"


def _num(cell: str) -> str:
    """A text cell as a number; what is no plain number is missing."""
    return f"CASE WHEN NOT isnan(TRY_CAST({cell} AS DOUBLE)) THEN TRY_CAST({cell} AS DOUBLE) END"


RAW = f"""WITH {_LI},
raw AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id_pedido,
         CASE WHEN o_orderkey % 37 = 0 THEN ['bad', '', '2024-13-45'][o_orderkey % 3 + 1]
              ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS data_pedido,
         o_orderpriority AS modo_pedido, o_orderstatus AS order_status,
         CASE WHEN o_orderkey % 23 = 0 THEN {_BAD}[o_orderkey % 6 + 1]
              ELSE CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) END AS valor_total,
         CASE WHEN o_orderkey % 29 = 0 THEN {_BAD}[o_orderkey % 6 + 1]
              ELSE CAST(CAST(num_itens AS BIGINT) AS VARCHAR) END AS qtd_itens,
         CASE WHEN o_orderkey % 40 <> 0 THEN CAST(1 + o_orderkey % 5 AS VARCHAR) END AS nota,
         CAST(o_custkey AS VARCHAR) AS nome_cliente,
         {_SPELL}[o_orderkey % 8 + 1] AS tipo
  FROM orders LEFT JOIN li ON l_orderkey = o_orderkey
),
fact AS (
  SELECT id_pedido AS order_id, TRY_CAST(data_pedido AS TIMESTAMP) AS dt, modo_pedido AS order_mode,
         order_status AS status, {_num('valor_total')} AS total, {_num('qtd_itens')} AS items,
         {_num('nota')} AS score, nome_cliente AS cliente_id, tipo FROM raw
)"""


STAR = _star()
STAR_NULLS = _star(nulls=True)


def rs(x: str) -> str:
    """Sums of money (exact values have at most 4 decimals): 4-decimal grid."""
    return f"floor(({x}) * 10000 + 0.5) / 10000"


def rb(x: str) -> str:
    """Means, ratios, quantiles: binary grid of 2^-12, on which decimal data
    never falls exactly half-way."""
    return f"floor(({x}) * 4096 + 0.5) / 4096"


# Filter conditions (same settings as the Spark catalogue's FilterSpecs).
W_DATES_PLATFORM_SCORE = (
    "dt >= TIMESTAMP '1996-01-01' AND dt <= TIMESTAMP '1999-12-31' "
    "AND platform IN ('BUILDING', 'MACHINERY') AND score >= 2 AND score <= 5"
)
W_LATE = "delivery - eta > 5"
W_AREA = "macro_bairro IN ('NATION_1', 'NATION_4', 'NATION_7', 'NATION_12', 'NATION_18', 'NATION_23')"  # ops know no class
W_CLASS_AREA = f"order_mode IN ('1-URGENT', '2-HIGH') AND {W_AREA}"
W_SAT = "score >= 1 AND score <= 5"
W_ON_TIME_SCORE = "score >= 2.5 AND score <= 5 AND delivery <= eta AND dt <= TIMESTAMP '2000-06-30'"
W_NAN_PLATFORM = "coalesce(platform, 'nan') IN ('nan', 'BUILDING')"

# ---------------------------------------------------------------- buckets


def _series(fact: str, where: str, freq: str, measures: list[tuple[str, str, str | None, str]]) -> str:
    """Gap-filled series. measures: (name, aggregate, fill or None, rounding)."""
    if freq == "D":
        start, step, label = "CAST(dt AS DATE)", "INTERVAL 1 DAY", "CAST(s AS DATE)"
    elif freq == "W":
        start, step, label = "CAST(date_trunc('week', dt) AS DATE)", "INTERVAL 7 DAY", "CAST(s AS DATE) + 6"
    else:
        start, step, label = "CAST(date_trunc('month', dt) AS DATE)", "INTERVAL 1 MONTH", "last_day(CAST(s AS DATE))"
    aggs = ", ".join(f"{agg} AS {name}" for name, agg, _, _ in measures)
    outs = []
    for name, _, fill, rnd in measures:
        v = f"b.{name}" if fill is None else f"coalesce(b.{name}, {fill})"
        v = {"rs": rs, "rb": rb}[rnd](v) if rnd else v
        outs.append(f"{v} AS {name}")
    return f"""{fact},
b AS (SELECT {start} AS s, {aggs} FROM fact WHERE dt IS NOT NULL AND {where} GROUP BY 1),
sp AS (SELECT CAST(unnest(generate_series(CAST(min(s) AS TIMESTAMP), CAST(max(s) AS TIMESTAMP), {step})) AS DATE) AS s FROM b)
SELECT {label} AS date, {', '.join(outs)} FROM sp LEFT JOIN b USING (s)"""


def _calendar(
    fact: str, where: str, unit: str, step: str, label: str, measures: list[tuple[str, str, str | None, str]],
    kept: str = "true", extra: str = "", kind: str = "DATE",
) -> str:
    """Gap-filled series over any calendar: ``unit`` is the regular start that a
    time ``dt`` belongs to (it may use ``m0``, the least start without a multiple), ``step``
    leads from one start ``s`` to the next, ``label`` names it."""
    aggs = ", ".join(f"{agg} AS {name}" for name, agg, _, _ in measures)
    outs = []
    for name, _, fill, rnd in measures:
        v = f"b.{name}" if fill is None else f"coalesce(b.{name}, {fill})"
        outs.append(f"{ {'rs': rs, 'rb': rb}[rnd](v) if rnd else v } AS {name}")
    return f"""{fact},
k AS (SELECT *, CAST(dt AS DATE) AS d, min(CAST(dt AS DATE)) OVER () AS d0 FROM fact WHERE dt IS NOT NULL AND {where}),
b AS (SELECT CAST({unit} AS TIMESTAMP) AS s, {aggs} FROM k GROUP BY 1),
sp AS (SELECT s FROM (SELECT unnest(generate_series(min(s), max(s), {step})) AS s FROM b) WHERE {kept})
SELECT CAST({label} AS {kind}) AS date, {extra}{', '.join(outs)} FROM sp LEFT JOIN b USING (s)"""


# End of the week (Sunday) and number of the month that hold a day.
_SUNDAY = "({d} + CAST(7 - isodow({d}) AS INTEGER))"
_MONTH = "(year({d}) * 12 + month({d}) - 1)"


# Last and first business day of the month that holds a day.
_LAST_BUSINESS = "(last_day({d}) - CAST(greatest(isodow(last_day({d})) - 5, 0) AS INTEGER))"
_FIRST_BUSINESS = (
    "(CAST(date_trunc('month', {d}) AS DATE) + CASE isodow(date_trunc('month', {d})) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END)"
)
_BUSINESS_MONTH = f"(date_trunc('month', dt) - INTERVAL 1 MONTH * CAST(d < {_FIRST_BUSINESS.format(d='d')} AS INTEGER))"


def _month_date(number: str) -> str:
    return f"make_date(CAST(({number}) // 12 AS BIGINT), CAST(({number}) % 12 + 1 AS BIGINT), 1)"


def _every(n: int, x: str, x0: str) -> str:
    """``x0`` plus the least multiple of ``n`` that reaches ``x``."""
    return f"({x0} + {n} * CAST(ceil(({x} - {x0}) / {n}) AS BIGINT))"


_ORDERS = [("orders", "count(*)", "0", "")]
_REVENUE = [("receita_total", "coalesce(sum(total), 0.0)", "0.0", "rs"), ("orders", "count(*)", "0", "")]


def _hist(fact: str, where: str, bins: int, total: str = "total") -> str:
    return f"""{fact},
t AS (SELECT {total} / items AS x FROM fact WHERE items > 0 AND {where}),
tf AS (SELECT x FROM t WHERE x IS NOT NULL AND isfinite(x)),
m AS (SELECT min(x) AS mn, max(x) AS mx FROM tf),
bnd AS (SELECT CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo, CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi FROM m),
e AS (SELECT i, CASE WHEN i = {bins} THEN hi ELSE CAST(i AS DOUBLE) * ((hi - lo) / {bins}) + lo END AS edge
      FROM bnd, range(0, {bins + 1}) r(i) WHERE lo IS NOT NULL),
bin AS (SELECT a.i, a.edge AS lo, z.edge AS hi FROM e a JOIN e z ON z.i = a.i + 1)
SELECT {rb('bin.lo')} AS bin_start, {rb('bin.hi')} AS bin_end, CAST(count(x) AS BIGINT) AS count
FROM bin LEFT JOIN tf ON x >= bin.lo AND (x < bin.hi OR (bin.i = {bins - 1} AND x <= bin.hi))
GROUP BY bin.i, bin.lo, bin.hi"""


def _box(fact: str, key_expr: str, key: str, where: str) -> str:
    return f"""{fact}
SELECT {key_expr} AS {key}, count(*) AS count, {rb('min(delivery)')} AS min,
       {rb('quantile_cont(delivery, 0.25)')} AS q1, {rb('quantile_cont(delivery, 0.5)')} AS median,
       {rb('quantile_cont(delivery, 0.75)')} AS q3, {rb('max(delivery)')} AS max
FROM fact WHERE delivery IS NOT NULL AND {where} GROUP BY 1"""


def _value_chunks(fact: str, key: str, value: str, where: str, chunk: int, kind: str = "VARCHAR", empty: bool = True) -> str:
    """Sorted runs of each group's values, ``chunk`` runs to a row."""
    none = f"""
UNION ALL SELECT {key}, CAST(0 AS INTEGER), CAST(0 AS BIGINT), CAST(0 AS BIGINT), NULL, NULL, ''
FROM g GROUP BY {key} HAVING count(v) = 0""" if empty else ""
    return f"""{fact},
g AS (SELECT * FROM (SELECT {key}, {value} AS v FROM fact WHERE {where}) WHERE {key.split(' AS ')[-1]} IS NOT NULL),
c AS (SELECT {key.split(' AS ')[-1]} AS k, v, count(*) AS c FROM g WHERE v IS NOT NULL GROUP BY ALL),
r AS (SELECT *, (row_number() OVER (PARTITION BY k ORDER BY v) - 1) // {chunk} AS chunk,
             sum(c) OVER (PARTITION BY k ORDER BY v) - c AS rank FROM c)
SELECT k AS {key.split(' AS ')[-1]}, CAST(chunk AS INTEGER) AS chunk, CAST(min(rank) AS BIGINT) AS first_rank, CAST(sum(c) AS BIGINT) AS n,
       min(v) AS low, max(v) AS high, string_agg(CAST(v AS VARCHAR) || 'x' || c, ',' ORDER BY v) AS runs
FROM r GROUP BY k, chunk{none}"""


def _percentiles(fact: str) -> str:
    return f"""{fact}
SELECT macro_bairro, {rb('avg(delivery)')} AS mean, {rb('quantile_cont(delivery, 0.5)')} AS p50,
       {rb('quantile_cont(delivery, 0.75)')} AS p75, {rb('quantile_cont(delivery, 0.9)')} AS p90, count(*) AS count
FROM fact WHERE macro_bairro IS NOT NULL AND delivery IS NOT NULL GROUP BY 1"""


def _late(fact: str, key: str, thr: float) -> str:
    return f"""{fact}
SELECT coalesce({key}, 'nan') AS {key},
       CAST(count_if(delivery - eta > {thr}) AS BIGINT) AS late_count,
       CAST(count(*) - count_if(delivery - eta > {thr}) AS BIGINT) AS on_time_count,
       {rb(f'count_if(delivery - eta > {thr}) / count(*)')} AS late_rate
FROM fact GROUP BY 1"""


def _hour_orders(fact: str) -> str:
    return f"""{fact},
h AS (SELECT CAST(hour(dt) AS INTEGER) AS hour, count(*) AS orders FROM fact WHERE dt IS NOT NULL GROUP BY 1)
SELECT hour, orders, {rb('orders / (SELECT sum(orders) FROM h)')} AS share FROM h"""


def _heat(fact: str, value: str) -> str:
    return f"""{fact}
SELECT CAST(hour(dt) AS INTEGER) AS hour, CAST(isodow(dt) - 1 AS INTEGER) AS weekday, {rb(f'avg({value})')} AS value
FROM fact WHERE dt IS NOT NULL AND ({value}) IS NOT NULL GROUP BY 1, 2"""


def _gross_net(fact: str, key: str, where: str = "TRUE", limit: int | None = None) -> str:
    tail = f" ORDER BY sum(total) DESC NULLS LAST, {key} LIMIT {limit}" if limit else ""
    return f"""{fact}
SELECT {key}, {rs('coalesce(sum(total), 0)')} AS receita_bruta, {rs('coalesce(sum(total * (1 - pct)), 0)')} AS receita_liquida
FROM fact WHERE {key} IS NOT NULL AND {where} GROUP BY 1{tail}"""


def _search(cols: list[str], pattern: str) -> str:
    return " OR ".join(f"regexp_matches(coalesce({c}, 'nan'), '{pattern}', 'i')" for c in cols)


_TEXT_COLS = ["platform", "order_mode", "status", "macro_bairro"]

SQL: dict[str, str] = {
    # ------------------------------------------------------------ overview
    "overview_kpis": f"""{STAR}
SELECT count(*) AS total_pedidos, {rs('coalesce(sum(total), 0)')} AS receita_total,
       {rb('avg(total / nullif(items, 0))')} AS ticket_medio,
       {rb("CASE WHEN count(*) > 0 THEN count_if(regexp_matches(coalesce(status, 'nan'), 'p', 'i')) * 100.0 / count(*) ELSE 0 END")} AS cancelados_pct,
       {rb('count(*) / greatest((epoch_ms(max(dt)) - epoch_ms(min(dt))) // 86400000 + 1, 1)')} AS pedidos_por_dia,
       min(dt) AS periodo_min, max(dt) AS periodo_max
FROM fact""",
    "overview_kpis_filtered": f"""{STAR}
SELECT count(*) AS total_pedidos, {rs('coalesce(sum(total), 0)')} AS receita_total,
       {rb('avg(total / nullif(items, 0))')} AS ticket_medio,
       {rb("CASE WHEN count(*) > 0 THEN count_if(regexp_matches(coalesce(status, 'nan'), 'p', 'i')) * 100.0 / count(*) ELSE 0 END")} AS cancelados_pct,
       {rb('count(*) / greatest((epoch_ms(max(dt)) - epoch_ms(min(dt))) // 86400000 + 1, 1)')} AS pedidos_por_dia,
       min(dt) AS periodo_min, max(dt) AS periodo_max
FROM fact WHERE {W_DATES_PLATFORM_SCORE}""",
    "overview_kpis_filtered_direct": f"""{STAR}
SELECT count(*) AS total_pedidos, {rs('coalesce(sum(total), 0)')} AS receita_total,
       {rb('avg(total / nullif(items, 0))')} AS ticket_medio,
       {rb("CASE WHEN count(*) > 0 THEN count_if(regexp_matches(coalesce(status, 'nan'), 'p', 'i')) * 100.0 / count(*) ELSE 0 END")} AS cancelados_pct,
       {rb('count(*) / greatest((epoch_ms(max(dt)) - epoch_ms(min(dt))) // 86400000 + 1, 1)')} AS pedidos_por_dia,
       min(dt) AS periodo_min, max(dt) AS periodo_max
FROM fact WHERE {W_DATES_PLATFORM_SCORE}""",
    "overview_timeseries_orders": _series(STAR, "TRUE", "D", [("orders", "count(*)", "0", "")]),
    "overview_timeseries_orders_weekly": _series(STAR, "TRUE", "W", [("orders", "count(*)", "0", "")]),
    "overview_timeseries_orders_monthly": _series(STAR, "TRUE", "M", [("orders", "count(*)", "0", "")]),
    "overview_timeseries_revenue_with_orders": _series(
        STAR, "TRUE", "M", [("receita_total", "sum(total)", "0", "rs"), ("orders", "count(*)", "0", "")]
    ),
    "overview_timeseries_revenue_with_orders_weekly_filtered": _series(
        STAR, W_DATES_PLATFORM_SCORE, "W", [("receita_total", "sum(total)", "0", "rs"), ("orders", "count(*)", "0", "")]
    ),
    "overview_by_platform": f"""{STAR}
SELECT platform, count(*) AS orders FROM fact WHERE platform IS NOT NULL GROUP BY 1""",
    "overview_by_platform_nulls": f"""{STAR_NULLS}
SELECT platform, count(*) AS orders FROM fact WHERE platform IS NOT NULL GROUP BY 1""",
    "overview_top_macro_by_orders": f"""{STAR}
SELECT macro_bairro, count(*) AS orders FROM fact WHERE macro_bairro IS NOT NULL
GROUP BY 1 ORDER BY orders DESC, macro_bairro LIMIT 5""",
    "overview_status_distribution": f"""{STAR}
SELECT coalesce(status, 'nan') AS status, count(*) AS count FROM fact GROUP BY 1""",
    "overview_status_distribution_nan_platform": f"""{STAR_NULLS}
SELECT coalesce(status, 'nan') AS status, count(*) AS count FROM fact WHERE {W_NAN_PLATFORM} GROUP BY 1""",
    "overview_ticket_histogram": _hist(STAR, "TRUE", 15),
    "overview_ticket_histogram_filtered": _hist(STAR, W_CLASS_AREA, 40),
    "overview_ticket_histogram_infinite": _hist(
        STAR, "true", 15, total="CASE WHEN order_id % 101 = 0 THEN CAST('inf' AS DOUBLE) ELSE total END"
    ),
    "overview_ticket_histogram_left_out": f"""{STAR}
SELECT count_if(order_id % 101 <> 0 AND total IS NOT NULL)::BIGINT AS binned, count_if(order_id % 101 = 0)::BIGINT AS infinite,
       count_if(order_id % 101 <> 0 AND total IS NULL)::BIGINT AS missing
FROM fact WHERE items > 0""",
    "overview_macro_avg_revenue": f"""{STAR}
SELECT macro_bairro, {rb('avg(total)')} AS avg_receita FROM fact WHERE macro_bairro IS NOT NULL GROUP BY 1""",
    "overview_macro_choropleth": f"""{STAR}
SELECT macro_bairro, {rb('avg(total)')} AS value FROM fact WHERE macro_bairro IS NOT NULL GROUP BY 1""",
    "overview_macro_choropleth_orders": f"""{STAR}
SELECT macro_bairro, count(*) AS value FROM fact WHERE macro_bairro IS NOT NULL GROUP BY 1""",
    "overview_macro_choropleth_total": f"""{STAR}
SELECT macro_bairro, {rs('coalesce(sum(total), 0)')} AS value FROM fact WHERE macro_bairro IS NOT NULL GROUP BY 1""",
    "overview_timeseries_orders_events": _series(_EVENTS, "TRUE", "D", [("orders", "count(*)", "0", "")]),
    # ------------------------------------------------------------ ops
    "ops_kpis": f"""{STAR}
SELECT {rb('avg(prep)')} AS tempo_medio_preparo, {rb('avg(delivery)')} AS tempo_medio_entrega,
       {rb('avg(delivery - eta)')} AS atraso_medio, {rb('avg(distance_km)')} AS distancia_media,
       {rb('coalesce(100 * avg(CASE WHEN delivery IS NOT NULL AND eta IS NOT NULL THEN (CASE WHEN delivery <= eta + 0 THEN 1 ELSE 0 END) END), 0)')} AS on_time_rate_pct
FROM fact""",
    "ops_kpis_late": f"""{STAR}
SELECT {rb('avg(prep)')} AS tempo_medio_preparo, {rb('avg(delivery)')} AS tempo_medio_entrega,
       {rb('avg(delivery - eta)')} AS atraso_medio, {rb('avg(distance_km)')} AS distancia_media,
       {rb('coalesce(100 * avg(CASE WHEN delivery IS NOT NULL AND eta IS NOT NULL THEN (CASE WHEN delivery <= eta + 10 THEN 1 ELSE 0 END) END), 0)')} AS on_time_rate_pct
FROM fact WHERE {W_LATE}""",
    "ops_timeseries_delivery": _series(
        STAR, "delivery IS NOT NULL", "D", [("avg_delivery_minutes", "avg(delivery)", None, "rb")]
    ),
    "ops_timeseries_delivery_weekly": _series(
        STAR, "delivery IS NOT NULL", "W", [("avg_delivery_minutes", "avg(delivery)", None, "rb")]
    ),
    "ops_boxplot_delivery_by_macro": _box(STAR, "macro_bairro", "macro_bairro", "macro_bairro IS NOT NULL"),
    "ops_boxplot_values_by_macro": f"""{STAR}
SELECT macro_bairro, delivery AS delivery_minutes FROM fact WHERE macro_bairro IS NOT NULL AND delivery IS NOT NULL""",
    "ops_delay_heatmap_by_macro": f"""{STAR}
SELECT macro_bairro, {rb('avg(delivery - eta)')} AS avg_delay FROM fact WHERE macro_bairro IS NOT NULL GROUP BY 1""",
    "ops_scatter_distance_delivery": f"""{STAR}
SELECT distance_km AS distance_km, delivery AS delivery_minutes
FROM fact WHERE distance_km IS NOT NULL AND delivery IS NOT NULL""",
    "ops_orders_by_hour": _hour_orders(STAR),
    "ops_orders_by_hour_events": _hour_orders(_EVENTS),
    "ops_late_rate_by_macro": _late(STAR, "macro_bairro", 0),
    "ops_late_rate_by_macro_nulls": _late(STAR_NULLS, "macro_bairro", 10),
    "ops_percentiles_by_macro": _percentiles(STAR),
    "ops_percentiles_by_macro_sliced": _percentiles(STAR),
    "ops_percentiles_by_macro_events": _percentiles(_EVENTS),
    "ops_delivery_by_weekday": _box(STAR, "CAST(isodow(dt) - 1 AS INTEGER)", "weekday", "dt IS NOT NULL"),
    "ops_delivery_values_by_weekday": f"""{STAR}
SELECT CAST(isodow(dt) - 1 AS INTEGER) AS weekday, delivery AS delivery_minutes
FROM fact WHERE dt IS NOT NULL AND delivery IS NOT NULL""",
    "ops_avg_delivery_by_hour": f"""{STAR}
SELECT CAST(hour(dt) AS INTEGER) AS hour, {rb('avg(delivery)')} AS avg_delivery_minutes
FROM fact WHERE dt IS NOT NULL AND delivery IS NOT NULL GROUP BY 1""",
    "ops_heatmap_hour_weekday": _heat(STAR, "delivery"),
    "ops_heatmap_hour_weekday_delay": _heat(STAR, "delivery - eta"),
    "ops_heatmap_hour_weekday_events": _heat(_EVENTS, "delivery"),
    "ops_late_rate_by_platform": _late(STAR, "platform", 0),
    # ------------------------------------------------------------ finance
    "finance_kpis": f"""{STAR}
SELECT {rs('coalesce(sum(total), 0)')} AS receita_total, {rs('coalesce(sum(total * (1 - pct)), 0)')} AS receita_liquida,
       {rb('CASE WHEN coalesce(sum(items), 0) > 0 THEN coalesce(sum(total), 0) / sum(items) ELSE 0 END')} AS ticket_medio,
       count(*) AS total_pedidos
FROM fact""",
    "finance_kpis_by_month_filtered": f"""{STAR}
SELECT {rs('coalesce(sum(total), 0)')} AS receita_total, {rs('coalesce(sum(total * (1 - pct)), 0)')} AS receita_liquida,
       {rb('CASE WHEN coalesce(sum(items), 0) > 0 THEN coalesce(sum(total), 0) / sum(items) ELSE 0 END')} AS ticket_medio,
       count(*) AS total_pedidos
FROM fact WHERE {W_DATES_PLATFORM_SCORE}""",
    "finance_orders_count": f"""{STAR}
SELECT count(*) AS total_pedidos FROM fact""",
    "finance_orders_count_filtered": f"""{STAR}
SELECT count(*) AS total_pedidos FROM fact WHERE {W_CLASS_AREA}""",
    "finance_timeseries_revenue": _series(
        STAR, "total IS NOT NULL", "D",
        [("gross", "sum(total)", "0", "rs"), ("net", "sum(total * (1 - pct))", "0", "rs")],
    ),
    "finance_timeseries_revenue_monthly": _series(
        STAR, "total IS NOT NULL", "M",
        [("gross", "sum(total)", "0", "rs"), ("net", "sum(total * (1 - pct))", "0", "rs")],
    ),
    "finance_margin_by_platform": f"""{STAR}
SELECT platform, {rb('avg(total)')} AS gross, {rb('avg(total * (1 - pct))')} AS net,
       {rb('coalesce(avg(total * (1 - pct)) / nullif(avg(total), 0), 0)')} AS margin_pct
FROM fact WHERE platform IS NOT NULL GROUP BY 1""",
    "finance_revenue_by_class": f"""{STAR}
SELECT order_mode AS class, {rs('coalesce(sum(total), 0)')} AS revenue FROM fact WHERE order_mode IS NOT NULL GROUP BY 1""",
    "finance_revenue_by_class_extra": f"""{RAW}
SELECT tipo AS class, {rs('coalesce(sum(total), 0)')} AS revenue FROM fact GROUP BY 1""",
    "finance_revenue_by_item_class_synonyms": f"""{RAW},
g AS (SELECT lower(tipo) AS raw, coalesce(sum(total), 0) AS revenue FROM fact GROUP BY tipo)
SELECT CASE WHEN raw IN ('individual', '1', 'single', 'simples') THEN 'individual'
            WHEN raw IN ('combo', '2', 'duo', 'par') THEN 'combo'
            WHEN raw IN ('família', 'familia', 'family', '4+', '4') THEN 'família'
            ELSE raw END AS classe, {rs('revenue')} AS revenue
FROM g""",
    "finance_kpis_decimal": f"""{RAW},
k AS (SELECT CAST(sum(TRY_CAST(valor_total AS DECIMAL(18, 2))) AS DOUBLE) AS t FROM raw WHERE valor_total NOT IN ('1d'))
SELECT {rs('max(t)')} AS receita_total, 0.0::DOUBLE AS receita_liquida,
       {rb('max(t) / sum(items)')} AS ticket_medio, count(*) AS total_pedidos
FROM fact, k""",
    # ------------------------------------------------------------ ingest
    "ingest_aliases": f"""{RAW}
SELECT order_id, dt AS order_datetime, order_mode, status, total AS total_brl, items AS num_itens,
       score AS satisfacao_nivel, cliente_id FROM fact""",
    "ingest_coercion_report": f"""{RAW},
both_ AS (SELECT * FROM raw JOIN fact ON id_pedido = order_id)
SELECT 'order_id' AS role, 'id_pedido' AS "column", count(id_pedido) AS present, 0::BIGINT AS coerced_to_null FROM both_
UNION ALL SELECT 'order_datetime', 'data_pedido', count(data_pedido), count(data_pedido) - count(dt) FROM both_
UNION ALL SELECT 'order_mode', 'modo_pedido', count(modo_pedido), 0 FROM both_
UNION ALL SELECT 'status', 'order_status', count(order_status), 0 FROM both_
UNION ALL SELECT 'total_brl', 'valor_total', count(valor_total), count(valor_total) - count(total) FROM both_
UNION ALL SELECT 'num_itens', 'qtd_itens', count(qtd_itens), count(qtd_itens) - count(items) FROM both_
UNION ALL SELECT 'satisfacao_nivel', 'nota', count(nota), count(nota) - count(score) FROM both_
UNION ALL SELECT 'cliente_id', 'nome_cliente', count(nome_cliente), 0 FROM both_""",
    "finance_revenue_by_class_status": f"""{STAR}
SELECT status AS class, {rs('coalesce(sum(total), 0)')} AS revenue FROM fact WHERE status IS NOT NULL GROUP BY 1""",
    "finance_top_clients": f"""{STAR}
SELECT cliente_id, {rs('coalesce(sum(total), 0)')} AS spent FROM fact WHERE cliente_id IS NOT NULL
GROUP BY 1 ORDER BY coalesce(sum(total), 0) DESC, cliente_id LIMIT 10""",
    "finance_revenue_by_platform": _gross_net(STAR, "platform"),
    "finance_revenue_by_macro": _gross_net(STAR, "macro_bairro"),
    "finance_revenue_by_macro_top5_filtered": _gross_net(STAR, "macro_bairro", W_CLASS_AREA, limit=5),
    "finance_revenue_by_macro_direct": _gross_net(STAR, "macro_bairro"),
    "finance_revenue_by_item_class": f"""{STAR}
SELECT CASE WHEN coalesce(items, 0) <= 1 THEN 'individual' WHEN coalesce(items, 0) <= 3 THEN 'combo' ELSE 'família' END AS classe,
       {rs('coalesce(sum(total), 0)')} AS revenue
FROM fact GROUP BY 1""",
    # explicit class column: sum per raw value, then lower-case and map synonyms
    "finance_revenue_by_item_class_explicit": f"""{STAR},
g AS (SELECT order_mode AS raw, coalesce(sum(total), 0) AS revenue FROM fact WHERE order_mode IS NOT NULL GROUP BY 1)
SELECT CASE
         WHEN lower(raw) IN ('individual', '1', 'single', 'simples') THEN 'individual'
         WHEN lower(raw) IN ('combo', '2', 'duo', 'par') THEN 'combo'
         WHEN lower(raw) IN ('família', 'familia', 'family', '4+', '4') THEN 'família'
         ELSE lower(raw) END AS classe,
       {rs('revenue')} AS revenue
FROM g""",
    # ------------------------------------------------------------ satisfaction
    "satisfaction_kpis": f"""{STAR}
SELECT {rb('CASE WHEN count(*) > 0 THEN avg(score) ELSE 0 END')} AS nivel_medio,
       {rb('CASE WHEN count(*) > 0 THEN avg(CASE WHEN score >= 4.5 THEN 1 ELSE 0 END) * 100 ELSE 0 END')} AS pct_muito_satisfeitos,
       count(score) AS total_avaliacoes,
       strftime(min(dt), '%Y-%m-%d %H:%M:%S') AS periodo_min, strftime(max(dt), '%Y-%m-%d %H:%M:%S') AS periodo_max
FROM fact WHERE {W_SAT}""",
    "satisfaction_by_macro": f"""{STAR}
SELECT macro_bairro, {rb('avg(score)')} AS avg_satisfacao, count(score) AS count
FROM fact WHERE {W_SAT} AND macro_bairro IS NOT NULL GROUP BY 1""",
    "satisfaction_scatter_time_score": f"""{STAR}
SELECT order_id, strftime(dt, '%Y-%m-%d %H:%M:%S') AS date, coalesce(platform, 'nan') AS platform,
       coalesce(macro_bairro, 'nan') AS macro_bairro, delivery AS delivery_minutes, score AS satisfacao,
       eta AS eta_minutes
FROM fact WHERE {W_SAT} AND delivery IS NOT NULL""",
    "satisfaction_timeseries": _series(
        STAR, W_SAT, "M", [("avg_satisfacao", "avg(score)", "0", "rb"), ("count", "count(score)", "0", "")]
    ),
    "satisfaction_timeseries_weekly": _series(
        STAR, W_SAT, "W", [("avg_satisfacao", "avg(score)", "0", "rb"), ("count", "count(score)", "0", "")]
    ),
    "satisfaction_by_platform": f"""{STAR}
SELECT platform, {rb('avg(score)')} AS avg_satisfacao, count(score) AS count
FROM fact WHERE {W_SAT} AND platform IS NOT NULL GROUP BY 1""",
    "satisfaction_by_platform_on_time": f"""{STAR}
SELECT platform, {rb('avg(score)')} AS avg_satisfacao, count(score) AS count
FROM fact WHERE {W_ON_TIME_SCORE} AND platform IS NOT NULL GROUP BY 1""",
    # ------------------------------------------------------------ meta
    "meta_platforms": f"""{STAR}
SELECT DISTINCT platform FROM fact WHERE platform IS NOT NULL""",
    "meta_macros": f"""{STAR}
SELECT DISTINCT macro_bairro FROM fact WHERE macro_bairro IS NOT NULL""",
    "meta_date_range": f"""{STAR}
SELECT strftime(min(dt), '%Y-%m-%d %H:%M:%S') AS periodo_min, strftime(max(dt), '%Y-%m-%d %H:%M:%S') AS periodo_max FROM fact""",
    # ------------------------------------------------------------ explore
    "explore_count": f"""{STAR}
SELECT count(*) AS count FROM fact WHERE {_search(_TEXT_COLS, 'build|^f$')}""",
    "explore_page": f"""{STAR}
SELECT order_id, platform, macro_bairro, total AS total_brl, status FROM fact
WHERE {_search(_TEXT_COLS, 'a')}
ORDER BY total DESC NULLS LAST, order_id LIMIT 200 OFFSET 100""",
    "overview_timeseries_orders_3d": _calendar(
        STAR, "true", "d0 + CAST((d - d0) // 3 * 3 AS INTEGER)", "INTERVAL 3 DAY", "s", _ORDERS),
    "overview_timeseries_orders_2w": _calendar(
        STAR, "true", f"DATE '1970-01-01' + CAST({_every(14, _SUNDAY.format(d='d') + " - DATE '1970-01-01'", '(' + _SUNDAY.format(d='d0') + " - DATE '1970-01-01')")} AS INTEGER)",
        "INTERVAL 14 DAY", "s", _ORDERS,
        extra="CAST(s AS DATE) - 13 AS bucket_start, CAST(s AS DATE) + 1 AS bucket_end, CAST((CAST(s AS DATE) - CAST(min(s) OVER () AS DATE)) // 14 AS BIGINT) AS step, "),
    "overview_timeseries_orders_week_wed": _calendar(
        STAR, W_CLASS_AREA, "d + CAST((10 - isodow(d)) % 7 AS INTEGER)", "INTERVAL 7 DAY", "s", _ORDERS),
    "overview_timeseries_revenue_2m": _calendar(
        STAR, "true", _month_date(_every(2, _MONTH.format(d="d"), _MONTH.format(d="d0"))), "INTERVAL 2 MONTH", "last_day(s)", _REVENUE),
    "overview_timeseries_orders_month_start": _calendar(
        STAR, "true", "date_trunc('month', dt)", "INTERVAL 1 MONTH", "s", _ORDERS,
        extra="CAST(s AS DATE) AS bucket_start, CAST(s + INTERVAL 1 MONTH AS DATE) AS bucket_end, row_number() OVER (ORDER BY s) - 1 AS step, "),
    "overview_timeseries_orders_quarter": _calendar(
        STAR, "true", "date_trunc('quarter', dt)", "INTERVAL 3 MONTH", "last_day(s + INTERVAL 2 MONTH)", _ORDERS),
    "overview_timeseries_revenue_quarter_feb": _calendar(
        STAR, W_DATES_PLATFORM_SCORE, "date_trunc('quarter', date_trunc('month', dt) + INTERVAL 1 MONTH) - INTERVAL 1 MONTH",
        "INTERVAL 3 MONTH", "last_day(s + INTERVAL 2 MONTH)", _REVENUE),
    "overview_timeseries_orders_quarter_start": _calendar(
        STAR, "true", "date_trunc('quarter', dt)", "INTERVAL 3 MONTH", "s", _ORDERS),
    "overview_timeseries_orders_year": _calendar(
        STAR, "true", "date_trunc('year', dt)", "INTERVAL 1 YEAR", "last_day(s + INTERVAL 11 MONTH)", _ORDERS),
    "finance_timeseries_revenue_year_mar": _calendar(
        STAR, "total IS NOT NULL", "date_trunc('year', date_trunc('month', dt) - INTERVAL 3 MONTH) + INTERVAL 3 MONTH",
        "INTERVAL 1 YEAR", "last_day(s + INTERVAL 11 MONTH)",
        [("gross", "sum(total)", "0.0", "rs"), ("net", "coalesce(sum(total * (1 - pct)), 0.0)", "0.0", "rs")]),
    "ops_timeseries_delivery_business_days": _calendar(
        STAR, f"delivery IS NOT NULL AND {W_AREA}", "d - CAST(greatest(isodow(d) - 5, 0) AS INTEGER)", "INTERVAL 1 DAY", "s",
        [("avg_delivery_minutes", "avg(delivery)", None, "rb")], kept="isodow(s) < 6"),
    "overview_timeseries_orders_business_month": _calendar(
        STAR, "true", f"date_trunc('month', dt) + INTERVAL 1 MONTH * CAST(d > {_LAST_BUSINESS.format(d='d')} AS INTEGER)",
        "INTERVAL 1 MONTH", _LAST_BUSINESS.format(d="s"), _ORDERS,
        extra=f"{_LAST_BUSINESS.format(d='(s - INTERVAL 1 MONTH)')} + 1 AS bucket_start, {_LAST_BUSINESS.format(d='s')} + 1 AS bucket_end, row_number() OVER (ORDER BY s) - 1 AS step, "),
    "overview_timeseries_revenue_business_month_start": _calendar(
        STAR, "true", _BUSINESS_MONTH, "INTERVAL 1 MONTH", _FIRST_BUSINESS.format(d="s"), _REVENUE),
    "finance_timeseries_revenue_business_quarter_feb": _calendar(
        STAR, "total IS NOT NULL", f"date_trunc('quarter', {_BUSINESS_MONTH} - INTERVAL 1 MONTH) + INTERVAL 1 MONTH",
        "INTERVAL 3 MONTH", _FIRST_BUSINESS.format(d="s"),
        [("gross", "sum(total)", "0.0", "rs"), ("net", "coalesce(sum(total * (1 - pct)), 0.0)", "0.0", "rs")]),
    "ops_timeseries_delivery_semi_month": _calendar(
        STAR, f"delivery IS NOT NULL AND {W_AREA}",
        "CASE WHEN d = last_day(d) THEN d WHEN day(d) >= 15 THEN CAST(date_trunc('month', d) AS DATE) + 14 ELSE CAST(date_trunc('month', d) AS DATE) - 1 END",
        "INTERVAL 1 DAY", "s", [("avg_delivery_minutes", "avg(delivery)", None, "rb")], kept="day(s) = 15 OR CAST(s AS DATE) = last_day(s)"),
    "satisfaction_timeseries_semi_month_start": _calendar(
        STAR, W_SAT, "CAST(date_trunc('month', d) AS DATE) + CASE WHEN day(d) >= 15 THEN 14 ELSE 0 END",
        "INTERVAL 1 DAY", "s", [("avg_satisfacao", "avg(score)", "0.0", "rb"), ("count", "count(score)", "0", "")], kept="day(s) IN (1, 15)"),
    "overview_timeseries_orders_6h_events": _calendar(
        _EVENTS, "true", "date_trunc('day', dt) + INTERVAL 6 HOUR * (hour(dt) // 6)", "INTERVAL 6 HOUR", "s", _ORDERS, kind="TIMESTAMP"),
    "overview_timeseries_orders_90min_events": _calendar(
        _EVENTS, "true", "CAST(d0 AS TIMESTAMP) + INTERVAL 1 MINUTE * (datediff('minute', CAST(d0 AS TIMESTAMP), dt) // 90 * 90)",
        "INTERVAL 90 MINUTE", "s", _ORDERS, kind="TIMESTAMP"),
    "satisfaction_timeseries_2q": _calendar(
        STAR, W_SAT, _month_date(_every(6, "((" + _MONTH.format(d="d") + ") // 3 * 3 + 2)", "((" + _MONTH.format(d="d0") + ") // 3 * 3 + 2)")),
        "INTERVAL 6 MONTH", "last_day(s)", [("avg_satisfacao", "avg(score)", "0.0", "rb"), ("count", "count(score)", "0", "")]),
    "ops_value_chunks_by_macro": _value_chunks(STAR, "macro_bairro", "delivery", "true", 16),
    "ops_value_chunks_by_macro_empty": _value_chunks(
        STAR, "macro_bairro", "CASE WHEN macro_bairro <> 'NATION_3' THEN delivery END", "true", 4096),
    "ops_value_chunks_by_weekday": _value_chunks(
        STAR, "CAST(isodow(dt) - 1 AS INTEGER) AS weekday", "delivery", f"delivery IS NOT NULL AND {W_LATE}", 20, empty=False),
    "ops_percentiles_from_chunks": _box(STAR, "macro_bairro", "macro_bairro", "macro_bairro IS NOT NULL"),
    "ops_count_between_from_chunks": f"""{STAR}
SELECT macro_bairro, count(CASE WHEN delivery BETWEEN 30 AND 45 THEN 1 END) AS count FROM fact
WHERE macro_bairro IS NOT NULL AND {W_AREA} GROUP BY 1""",
    "explore_page_unindexed": f"""{STAR}
SELECT order_id, platform, macro_bairro, total AS total_brl, status FROM fact
WHERE {_search(_TEXT_COLS, 'a')}
ORDER BY total DESC NULLS LAST, order_id LIMIT 200 OFFSET 100""",
    "explore_page_across_slices": f"""{STAR}
SELECT order_id, platform, macro_bairro, total AS total_brl, status FROM fact
WHERE {_search(_TEXT_COLS, 'a')}
ORDER BY total DESC NULLS LAST, order_id LIMIT 1500 OFFSET 700""",
    "explore_page_observed": f"""{STAR},
hits AS (SELECT * FROM fact WHERE {_search(_TEXT_COLS, 'a')}),
n AS (SELECT count(*) AS total FROM hits)
SELECT order_id, platform, macro_bairro, hits.total AS total_brl, status, n.total,
       CAST(greatest(least(n.total - 100, 200), 0) AS BIGINT) AS returned
FROM hits, n ORDER BY hits.total DESC NULLS LAST, order_id LIMIT 200 OFFSET 100""",
    "explore_page_asc": f"""{STAR}
SELECT order_id, platform, macro_bairro, total AS total_brl, status FROM fact
ORDER BY status ASC NULLS LAST, order_id LIMIT 500 OFFSET 0""",
    "explore_page_deep": f"""{STAR}
SELECT order_id, platform, macro_bairro, total AS total_brl, status FROM fact
ORDER BY total ASC NULLS LAST, order_id LIMIT 1000 OFFSET 9000""",
    "explore_page_sliced": f"""{STAR}
SELECT order_id, platform, macro_bairro, total AS total_brl, status FROM fact
WHERE {_search(_TEXT_COLS, 'a')}
ORDER BY total DESC NULLS LAST, order_id LIMIT 900 OFFSET 300""",
    "explore_page_raw": """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
ORDER BY l_quantity ASC NULLS LAST, l_orderkey, l_linenumber LIMIT 500 OFFSET 1000""",
    "explore_page_meta": f"""{STAR},
n AS (SELECT count(*) AS total FROM fact WHERE {_search(_TEXT_COLS, 'a')})
SELECT total, CAST(greatest(least(total - 100, 200), 0) AS BIGINT) AS returned, CAST(100 AS INTEGER) AS "offset",
       CAST(200 AS INTEGER) AS "limit", 'order_id,platform,macro_bairro,total_brl,status' AS "columns",
       'total_brl' AS sorted_by, 'desc' AS "order"
FROM n""",
    "explore_boolean_summary": f"""{STAR},
v AS (SELECT delivery > eta AS late, count(*) AS n FROM fact WHERE delivery > eta IS NOT NULL GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique",
       (SELECT late FROM v ORDER BY n DESC, late LIMIT 1) AS top, max(n) AS freq
FROM v""",
    "explore_summary_empty": """SELECT 0.0::DOUBLE AS count, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min,
       NULL::DOUBLE AS p25, NULL::DOUBLE AS p50, NULL::DOUBLE AS p75, NULL::DOUBLE AS max""",
    "explore_date_summary": f"""{STAR}
SELECT strftime(dt, '%Y-%m-%d %H:%M:%S') AS value, count(*) AS count FROM fact GROUP BY 1
ORDER BY count DESC, value LIMIT 20""",
    "explore_numeric_summary": f"""{STAR}
SELECT {rb('CAST(count(total) AS DOUBLE)')} AS count, {rb('avg(total)')} AS mean, {rb('stddev_samp(total)')} AS std,
       {rb('min(total)')} AS min, {rb('quantile_cont(total, 0.25)')} AS p25, {rb('quantile_cont(total, 0.5)')} AS p50,
       {rb('quantile_cont(total, 0.75)')} AS p75, {rb('max(total)')} AS max
FROM fact""",
    "explore_column_counts": f"""{STAR},
c AS (SELECT count(*) AS n, count(order_id) AS c1, count(dt) AS c2, count(platform) AS c3, count(order_mode) AS c4,
             count(status) AS c5, count(macro_bairro) AS c6, count(total) AS c7, count(items) AS c8, count(prep) AS c9,
             count(delivery) AS c10, count(eta) AS c11, count(distance_km) AS c12, count(pct) AS c13,
             count(score) AS c14, count(cliente_id) AS c15 FROM fact)
SELECT col AS "column", CAST(non_null AS BIGINT) AS non_null, n AS "rows" FROM (
  SELECT 'order_id' AS col, c1 AS non_null, n FROM c UNION ALL SELECT 'order_datetime', c2, n FROM c
  UNION ALL SELECT 'platform', c3, n FROM c UNION ALL SELECT 'order_mode', c4, n FROM c
  UNION ALL SELECT 'status', c5, n FROM c UNION ALL SELECT 'macro_bairro', c6, n FROM c
  UNION ALL SELECT 'total_brl', c7, n FROM c UNION ALL SELECT 'num_itens', c8, n FROM c
  UNION ALL SELECT 'tempo_preparo_minutos', c9, n FROM c UNION ALL SELECT 'actual_delivery_minutes', c10, n FROM c
  UNION ALL SELECT 'eta_minutes_quote', c11, n FROM c UNION ALL SELECT 'distance_km', c12, n FROM c
  UNION ALL SELECT 'platform_commision_pct', c13, n FROM c UNION ALL SELECT 'satisfacao_nivel', c14, n FROM c
  UNION ALL SELECT 'cliente_id', c15, n FROM c)""",
    "explore_top_values": f"""{STAR}
SELECT coalesce(macro_bairro, 'nan') AS value, count(*) AS count FROM fact GROUP BY 1 ORDER BY count DESC, value LIMIT 20""",
    # ------------------------------------------------------------ streaming
    "stream_events_daily_windows": f"""SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS window_start,
       CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY AS window_end, count(*) AS orders,
       {rb('avg(value)')} AS avg_delivery_minutes
FROM events WHERE ts IS NOT NULL GROUP BY 1, 2""",
    "stream_events_hour_histogram": """SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS window_start,
       CAST(hour(ts) AS INTEGER) AS hour, count(*) AS orders
FROM events WHERE ts IS NOT NULL GROUP BY 1, 2""",
}

# The column listing: the types are Spark's names of the canonical types.
_DTYPES = {
    "order_id": "bigint", "order_datetime": "timestamp_ntz", "cliente_id": "bigint",
    "platform": "string", "order_mode": "string", "status": "string", "macro_bairro": "string",
}
_LISTED = ", ".join(f"('{c}', '{t}')" for c, t in _DTYPES.items())
SQL["explore_columns"] = f"""SELECT l."column", coalesce(t.dtype, 'double') AS dtype, l.non_null, l."rows"
FROM ({SQL['explore_column_counts']}) l LEFT JOIN (VALUES {_LISTED}) t(name, dtype) ON l."column" = t.name"""

# Answers from partial states: the same rows as the single datasets.
_SAME_ROWS = {
    "refresh_overview_kpis": "overview_kpis", "refresh_timeseries_orders": "overview_timeseries_orders",
    "refresh_timeseries_revenue_with_orders": "overview_timeseries_revenue_with_orders",
    "refresh_by_platform": "overview_by_platform", "refresh_top_macro_by_orders": "overview_top_macro_by_orders",
    "refresh_status_distribution": "overview_status_distribution", "refresh_macro_avg_revenue": "overview_macro_avg_revenue",
    "refresh_ops_kpis": "ops_kpis", "refresh_timeseries_delivery": "ops_timeseries_delivery",
    "refresh_delay_heatmap_by_macro": "ops_delay_heatmap_by_macro", "refresh_orders_by_hour": "ops_orders_by_hour",
    "refresh_late_rate_by_macro": "ops_late_rate_by_macro", "refresh_late_rate_by_platform": "ops_late_rate_by_platform",
    "refresh_heatmap_hour_weekday": "ops_heatmap_hour_weekday", "refresh_finance_kpis": "finance_kpis",
    "refresh_timeseries_revenue": "finance_timeseries_revenue", "refresh_margin_by_platform": "finance_margin_by_platform",
    "refresh_revenue_by_platform": "finance_revenue_by_platform",
    "refresh_revenue_by_macro_top5_filtered": "finance_revenue_by_macro_top5_filtered",
    "refresh_revenue_by_class": "finance_revenue_by_class", "refresh_satisfaction_kpis": "satisfaction_kpis",
    "refresh_satisfaction_by_macro": "satisfaction_by_macro", "refresh_satisfaction_by_platform": "satisfaction_by_platform",
    "refresh_satisfaction_timeseries": "satisfaction_timeseries",
}
SQL |= {name: SQL[single] for name, single in _SAME_ROWS.items()}
_DATES_PLATFORM = W_DATES_PLATFORM_SCORE.split(" AND score")[0]
SQL |= {
    "refresh_timeseries_orders_weekly_filtered": _series(STAR, _DATES_PLATFORM, "W", _ORDERS),
    "refresh_dashboard": f"""{STAR},
g AS (SELECT *, hour(dt) AS hour FROM fact)
SELECT CASE grouping(platform, macro_bairro, order_mode, hour) WHEN 15 THEN 'total' WHEN 7 THEN 'platform' WHEN 11 THEN 'macro_bairro'
         WHEN 13 THEN 'order_mode' WHEN 14 THEN 'hour' ELSE 'platform+macro_bairro' END AS panel,
       platform, macro_bairro, order_mode, CAST(hour AS INTEGER) AS hour, count(*) AS orders,
       {rs('coalesce(sum(total), 0.0)')} AS receita_bruta, {rs('coalesce(sum(total * (1 - pct)), 0.0)')} AS receita_liquida,
       {rb('avg(delivery)')} AS avg_delivery_minutes, CAST(count_if(delivery > eta) AS BIGINT) AS late_count, {rb('avg(score)')} AS avg_satisfacao
FROM g GROUP BY GROUPING SETS ((), (platform), (macro_bairro), (order_mode), (hour), (platform, macro_bairro))""",
    "refresh_percentiles_kll": f"""{STAR}
SELECT macro_bairro, count(*) AS count, true AS p50, true AS p75, true AS p90 FROM fact
WHERE macro_bairro IS NOT NULL AND delivery IS NOT NULL AND platform IN ('BUILDING', 'MACHINERY')
  AND dt >= TIMESTAMP '1996-01-01' AND dt < TIMESTAMP '2000-01-01' GROUP BY 1""",
}
SQL |= {
    "ingest_csv": SQL["ingest_aliases"],
    "ingest_json": SQL["ingest_aliases"],
    "ingest_second_date": _series(RAW, "true", "M", _ORDERS),
    "ingest_override": f"""{RAW}
SELECT {rs('coalesce(sum(items), 0)')} AS receita_total, 0.0::DOUBLE AS receita_liquida, 1.0::DOUBLE AS ticket_medio, count(*) AS total_pedidos
FROM fact""",
    "ops_kpis_override": f"""{STAR}
SELECT {rb('avg(prep)')} AS tempo_medio_preparo, {rb('avg(prep)')} AS tempo_medio_entrega,
       {rb('avg(prep - eta)')} AS atraso_medio, {rb('avg(distance_km)')} AS distancia_media,
       {rb('coalesce(100 * avg(CASE WHEN prep <= eta THEN 1 WHEN prep > eta THEN 0 END), 0)')} AS on_time_rate_pct
FROM fact""",
    "overview_top_macro_override": f"""{STAR}
SELECT order_mode AS macro_bairro, count(*) AS orders FROM fact WHERE order_mode IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""",
    "finance_revenue_by_class_absent": SQL["finance_revenue_by_class"],
    "finance_revenue_by_item_class_absent": SQL["finance_revenue_by_item_class"],
    "satisfaction_scatter_pruned": f"""{STAR}
SELECT order_id, strftime(dt, '%Y-%m-%d %H:%M:%S') AS date, coalesce(platform, 'nan') AS platform,
       delivery AS delivery_minutes, score AS satisfacao, eta AS eta_minutes
FROM fact WHERE {W_SAT} AND delivery IS NOT NULL""",
}
SQL |= {
    "explore_top_values_pruned": f"""{STAR}
SELECT coalesce(CAST(cliente_id AS VARCHAR), 'nan') AS value, count(*) AS count FROM fact GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
    "explore_top_values_pruned_events": """SELECT coalesce(CAST(user_id AS VARCHAR), 'nan') AS value, count(*) AS count
FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12""",
}
SQL |= {
    f"explore_search_indexed{name}": f"""{STAR}
SELECT count(*) AS orders, count(DISTINCT macro_bairro) AS areas FROM fact WHERE {_search(_TEXT_COLS, q)}"""
    for name, q in (("", "nation_1[0-9]|machin"), ("_none", "no such text"), ("_all", "build|^f$"))
}
# Spark's type names are stated; counts and bounds are computed.
_ORDERS_TYPES = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
}
SQL |= {
    "explore_table_summary": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS dtype, count({c}) AS non_null, count(*) AS rows,
       CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS greatest FROM orders"""
        for c, t in _ORDERS_TYPES.items()
    ),
    "explore_table_summary_events": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS non_null, count(*) AS rows FROM events"""
        for c in ("event_id", "ts", "user_id", "event_type", "value", "props")
    ),
}
SQL["stream_events_corrections"] = f"""
WITH o AS (
  SELECT CASE WHEN event_id % 20 = 0 THEN ts + INTERVAL 1 DAY ELSE ts END AS ts,
         CASE WHEN event_id % 10 = 0 THEN value + 5.25 ELSE value END AS v
  FROM events)
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, count(*) AS orders, {rb('avg(v)')} AS avg_value FROM o GROUP BY 1"""
