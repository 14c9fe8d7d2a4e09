"""The global dashboard filters (dates, platform, area, order class, score,
late / on time) as one conjunctive predicate.

The four dashboards apply near-identical filters; the differences are
captured by ``variant``:

=============  =====  =========================  ==========================
variant        class  score range                late / on time
=============  =====  =========================  ==========================
overview       yes    only if a bound is given   no
finance        yes    only if a bound is given   no
ops            no     only if a bound is given   (d − e) > thr / ≤ thr
satisfaction   no     always (1..5 default)      d > e / d ≤ e (no thr)
=============  =====  =========================  ==========================

All predicates are written on the canonical columns so that, when those are
raw Parquet columns, Catalyst pushes them into the scan (``PushedFilters``).
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderscope.functions.expressions import NULL_TOKEN
from orderscope.sources.columns import MissingColumnError, has

VARIANTS = ("overview", "finance", "ops", "satisfaction")
DELIVERY_STATES = ("atrasado", "no_prazo")
SCORE_LOW, SCORE_HIGH = 1.0, 5.0


@dataclass(frozen=True)
class FilterSpec:
    """Shared filter parameters. Dates are ``yyyy-mm-dd`` (or ISO datetime)
    text; ``end_date`` means midnight at the start of that day unless
    ``end_inclusive_day`` is set, which keeps the whole day."""

    start_date: str | None = None
    end_date: str | None = None
    platform: tuple[str, ...] | None = None
    macro_bairro: tuple[str, ...] | None = None
    classe_pedido: tuple[str, ...] | None = None
    score_min: float | None = None
    score_max: float | None = None
    delivery_status: str | None = None
    threshold_min: float | None = None
    end_inclusive_day: bool = False

    def without_delivery_status(self) -> FilterSpec:
        return replace(self, delivery_status=None)

    def date_bounds(self) -> tuple[_dt.datetime | None, _dt.datetime | None, bool]:
        """(lower inclusive, upper, upper_is_exclusive) as Python datetimes."""
        lo = parse_date_literal(self.start_date, "start_date") if self.start_date else None
        hi = parse_date_literal(self.end_date, "end_date") if self.end_date else None
        if hi is not None and self.end_inclusive_day:
            return lo, hi + _dt.timedelta(days=1), True
        return lo, hi, False


def parse_date_literal(text: str, name: str) -> _dt.datetime:
    try:
        value = _dt.datetime.fromisoformat(str(text).strip())
    except ValueError as exc:
        raise ValueError(f"{name} invalid, use yyyy-mm-dd: {text!r}") from exc
    if value.tzinfo is not None:
        raise ValueError(f"{name} must be a wall-clock time without an offset: {text!r}")
    return value


def ts_literal(value: _dt.datetime) -> Column:
    """A ``timestamp_ntz`` literal (folded at plan time, pushable)."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def _membership(col: str, values: tuple[str, ...]) -> Column:
    vals = [str(v) for v in values]
    if NULL_TOKEN in vals:
        return F.coalesce(F.col(col).cast("string"), F.lit(NULL_TOKEN)).isin(vals)
    return F.col(col).cast("string").isin(vals)


def _check_score_bound(value: float | None, name: str) -> None:
    if value is not None and not (SCORE_LOW <= float(value) <= SCORE_HIGH):
        raise ValueError(f"{name} must be within 1..5")


def filter_predicates(df: DataFrame, spec: FilterSpec, variant: str) -> list[Column]:
    """Validate the spec against the fact and return the conjuncts."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown filter variant {variant!r}")
    preds: list[Column] = []

    lo, hi, hi_exclusive = spec.date_bounds()
    if lo is not None or hi is not None:
        if not has(df, "order_datetime"):
            raise MissingColumnError("date column not found for the date filter")
        dt = F.col("order_datetime")
        if lo is not None:
            preds.append(dt >= ts_literal(lo))
        if hi is not None:
            preds.append(dt < ts_literal(hi) if hi_exclusive else dt <= ts_literal(hi))
        if has(df, "order_month"):
            # Fact stored under order_month= directories: the implied bounds
            # on the partition column let the scan skip whole months.
            month = F.col("order_month")
            if lo is not None:
                preds.append(month >= F.trunc(F.to_date(ts_literal(lo)), "month"))
            if hi is not None:
                preds.append(month <= F.trunc(F.to_date(ts_literal(hi)), "month"))

    for role, values in (("platform", spec.platform), ("macro_bairro", spec.macro_bairro)):
        if values:
            if not has(df, role):
                raise MissingColumnError(f"{role} column not found for the filter")
            preds.append(_membership(role, tuple(values)))

    if variant in ("overview", "finance") and spec.classe_pedido:
        if not has(df, "order_mode"):
            raise MissingColumnError("order class column not found for the filter")
        preds.append(_membership("order_mode", tuple(spec.classe_pedido)))

    if spec.delivery_status and variant in ("ops", "satisfaction"):
        if spec.delivery_status not in DELIVERY_STATES:
            raise ValueError("delivery_status must be atrasado or no_prazo")
        if not (has(df, "actual_delivery_minutes") and has(df, "eta_minutes_quote")):
            raise MissingColumnError("delivery_status needs delivery and eta columns")
        d, e = F.col("actual_delivery_minutes"), F.col("eta_minutes_quote")
        if variant == "ops":
            thr = F.lit(float(spec.threshold_min or 0.0))
            late = (d - e) > thr
            on_time = (d - e) <= thr
        else:
            late, on_time = d > e, d <= e
        preds.append(late if spec.delivery_status == "atrasado" else on_time)

    _check_score_bound(spec.score_min, "score_min")
    _check_score_bound(spec.score_max, "score_max")
    bounded = spec.score_min is not None or spec.score_max is not None
    if bounded or variant == "satisfaction":
        smin = SCORE_LOW if spec.score_min is None else float(spec.score_min)
        smax = SCORE_HIGH if spec.score_max is None else float(spec.score_max)
        if smin > smax:
            raise ValueError("score_min cannot be greater than score_max")
        if has(df, "satisfacao_nivel"):
            preds.append(F.col("satisfacao_nivel").between(F.lit(smin), F.lit(smax)))
    return preds


def apply_filters(df: DataFrame, spec: FilterSpec | None, variant: str) -> DataFrame:
    preds = filter_predicates(df, spec or FilterSpec(), variant)
    if not preds:
        return df
    return df.where(reduce(lambda a, b: a & b, preds))
