"""Inventory math as Column factories (V1, V2, V5, V6, V7)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cost-model defaults.
HOLDING_RATE_ANNUAL = 0.25
GOODWILL_MULTIPLIER = 1.2
COST_SHARE, MARGIN_SHARE = 0.6, 0.4


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(x))


def protection_interval_days(lead_time, review=1) -> Column:
    """V1: L + R."""
    return _c(lead_time) + _c(review)


def reorder_point(p_alpha_lt) -> Column:
    """V2: ROP = Q_alpha(demand over L+R)."""
    return _c(p_alpha_lt)


def safety_stock(p_alpha_lt, p50_lt) -> Column:
    """V2: ROP - median demand over L+R (median stands in for the mean)."""
    return _c(p_alpha_lt) - _c(p50_lt)


def order_up_to_level(p_alpha_lt) -> Column:
    return _c(p_alpha_lt)


def holding_cost(units, unit_cost, annual_rate=HOLDING_RATE_ANNUAL) -> Column:
    """V5: pro-rated daily holding cost."""
    return _c(units) * _c(unit_cost) * (_c(annual_rate) / F.lit(365.0))


def stockout_cost(short, unit_margin, mult=GOODWILL_MULTIPLIER) -> Column:
    """V5: lost margin x units short x goodwill multiplier."""
    return F.greatest(F.lit(0.0), _c(short)) * _c(unit_margin) * _c(mult)


def unit_cost(price) -> Column:
    """V6: 60 % of the median price."""
    return F.lit(COST_SHARE) * _c(price)


def unit_margin(price) -> Column:
    """V6: 40 % of the median price."""
    return F.lit(MARGIN_SHARE) * _c(price)


def exceedance_prob(x, p10, p50, p90) -> Column:
    """V7 closed form: P(D > x) for the piecewise-linear daily demand curve
    implied by (p10, p50, p90): an atom at max(p10, 0) for u < 0.1, linear to
    p50 at u = 0.5, linear beyond to p50 + 1.25 (p90 - p50) at u = 1."""
    x, p50, p90 = _c(x), _c(p50), _c(p90)
    lo = F.greatest(_c(p10), F.lit(0.0))
    top = p50 + F.lit(1.25) * (p90 - p50)
    return (F.when(x < lo, F.lit(1.0))
            .when((x < p50) & (p50 > lo), F.lit(0.9) - F.lit(0.4) * (x - lo) / (p50 - lo))
            .when((x < top) & (p90 > p50), F.lit(0.5) - F.lit(0.4) * (x - p50) / (p90 - p50))
            .otherwise(F.lit(0.0)))


def days_to_stockout(on_hand, daily, cap=99) -> Column:
    """V7: int(min(on_hand / daily, cap))."""
    return F.least(_c(on_hand) / _c(daily), F.lit(float(cap))).cast("int")
