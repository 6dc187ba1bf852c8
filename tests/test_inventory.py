"""Closed-form inventory cases (V1-V5, V7, V8)."""

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelfcast.functions import inventory as I
from shelfcast.operators import inventory as INV
from shelfcast.operators import panel as P


def test_protection_interval_and_rop(spark):
    r = spark.range(1).select(I.protection_interval_days(F.lit(3), 1).alias("pi"),
                              I.reorder_point(F.lit(118.0)).alias("rop"),
                              I.safety_stock(F.lit(118.0), F.lit(80.0)).alias("ss")).first()
    assert (r.pi, r.rop, r.ss) == (4, 118.0, 38.0)


def test_order_quantity_cap_beats_moq(spark):
    df = spark.createDataFrame([(118.0, 100.0)], "s double, ip double")
    r = INV.order_quantity(df, "s", "ip", moq=30.0, pack=1.0, cap=10.0).first()
    assert r.final_qty == 10.0
    assert r.qty_flags == ["below_moq_rounded_up", "exceeds_budget_cap"]


def test_order_quantity_zero_above_s(spark):
    df = spark.createDataFrame([(118.0, 200.0)], "s double, ip double")
    r = INV.order_quantity(df, "s", "ip").first()
    assert (r.raw_qty, r.final_qty, r.qty_flags) == (0.0, 0.0, [])


def test_pack_rounding_half_even(spark):
    df = spark.createDataFrame([(25.0, 0.0), (35.0, 0.0)], "s double, ip double")
    rows = INV.order_quantity(df, "s", "ip", pack=10.0).orderBy("s").collect()
    assert [r.final_qty for r in rows] == [20.0, 40.0]


def test_costs(spark):
    r = spark.range(1).select(I.holding_cost(F.lit(365.0), F.lit(10.0)).alias("h"),
                              I.stockout_cost(F.lit(-3.0), F.lit(5.0)).alias("s0"),
                              I.stockout_cost(F.lit(2.0), F.lit(5.0)).alias("s1")).first()
    assert r.h == pytest.approx(2.5) and r.s0 == 0.0 and r.s1 == pytest.approx(12.0)


def test_exceedance_prob(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 2.0, 6.0, 10.0, 14.0, 30.0)], "x double")
    out = df.select("x", I.exceedance_prob("x", F.lit(2.0), F.lit(6.0), F.lit(10.0)).alias("p")) \
            .orderBy("x").collect()
    assert [round(r.p, 6) for r in out] == [1.0, 0.9, 0.5, 0.1, 0.0, 0.0]


def test_ledger_by_hand(spark):
    """Ten units on hand, four wanted a day, two days of lead time. 'fix' orders
    3, 3 and 3 units, then nothing; 'up' orders up to 12."""
    cols = ("series string, arm string, t int, demand double, fixed_order double, order_up_to double, policy string, "
            "initial_on_hand double, lead_time_days int, unit_cost double, unit_margin double")
    rows = []
    for t in range(5):
        rows.append(("x", "fix", t, 4.0, 3.0 if t < 3 else 0.0, None, "fixed", 10.0, 2, 365.0, 5.0))
        rows.append(("x", "up", t, 4.0, None, 12.0, "order_up_to", 10.0, 2, 365.0, 5.0))
    led = INV.replay(spark.createDataFrame(rows, cols))
    got = {arm: [(r.on_hand_start, r.on_hand_end, r.order_placed, r.stockout_units)
                 for r in led.where(F.col("arm") == arm).orderBy("day").collect()] for arm in ("fix", "up")}
    assert got["fix"] == [(10, 6, 3, 0), (6, 2, 3, 0), (5, 1, 3, 0), (4, 0, 0, 0), (3, 0, 0, 1)]
    assert got["up"] == [(10, 6, 6, 0), (6, 2, 4, 0), (8, 4, 4, 0), (8, 4, 4, 0), (8, 4, 4, 0)]
    tot = {r.arm: r for r in INV.policy_totals(led).collect()}
    # A unit kept for a day costs 25 % of 365 over 365 days; a unit short 5 * 1.2.
    assert tot["fix"].total_holding_cost == pytest.approx(9 * 0.25) and tot["fix"].total_stockout_cost == pytest.approx(6.0)
    assert tot["up"].total_holding_cost == pytest.approx(20 * 0.25) and tot["up"].stockout_days == 0


def test_interval_quantiles_prefix_windows(spark):
    # 10 days of demand 1..10, protection 3 days -> window sums 6, 9, ..., 27
    panel = spark.createDataFrame([("s", i, float(i)) for i in range(1, 11)], "k string, day int, y double")
    params = spark.createDataFrame([("s", 3)], "k string, protection_days int")
    r = INV.interval_quantiles(panel, params, "k", "day", "y", alpha=0.9).first()
    sums = [float(sum(range(i - 2, i + 1))) for i in range(3, 11)]
    assert r.n_windows == len(sums)
    assert r.mean_lt == pytest.approx(sum(sums) / len(sums))
    assert r.p50_lt == pytest.approx((sums[3] + sums[4]) / 2)


def test_window_totals_have_no_longest_window(spark):
    panel = spark.range(120).select(F.lit(1).alias("k"), F.date_add(F.lit("2001-01-01").cast("date"), F.col("id").cast("int")).alias("day"),
                                    F.lit(2.0).alias("y"))
    params = spark.createDataFrame([(1, 35)], "k int, protection_days int")
    got = INV.rolling_window_totals(panel, params, "k", "day", "y").collect()
    assert len(got) == 120 - 34 and {r.total for r in got} == {70.0}


def test_window_totals_are_counted_without_a_second_shuffle(spark):
    """Counts equal those of every window by itself, for sparse and short series."""
    rng = random.Random(5)
    rows = [(k, dt.date(2001, 1, 1) + dt.timedelta(days=i), float(rng.choice((0, 0, 0, 1, 4)))) for k, n in ((1, 80), (2, 9), (3, 2), (4, 30))
            for i in range(n)]
    panel = spark.createDataFrame(rows, "k int, day date, y double")
    need = {1: 7, 2: 9, 3: 5, 4: 1}
    params = spark.createDataFrame(list(need.items()), "k int, protection_days int")
    want = collections.Counter()
    for k, p in need.items():
        ys = [y for s, _, y in rows if s == k]
        want.update((k, sum(ys[i:i + p])) for i in range(len(ys) - p + 1))
    counts = INV.window_total_counts(panel, params, "k", "day", "y")
    assert {(r.k, r.total): r.n for r in counts.collect()} == dict(want)
    totals = INV.rolling_window_totals(panel, params, "k", "day", "y")
    assert collections.Counter((r.k, r.total) for r in totals.collect()) == want
    plan = totals._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_lags_come_with_the_dense_rows(spark):
    days = [(1, 0, 2.0), (1, 3, 5.0), (1, 4, 1.0), (1, 20, 7.0), (2, 18, 4.0)]
    act = spark.createDataFrame([(k, dt.date(2001, 1, 1) + dt.timedelta(days=d), y) for k, d, y in days], "k int, day date, n_items double")
    got = P.densify(act, "2001-01-25", "k", carry=(), lags=(1, 7))
    plain = P.add_lags(P.densify(act, "2001-01-25", "k", carry=()), "k", "day", "n_items", (1, 7))
    first = lambda r: r[:2]
    assert sorted(map(tuple, got.collect()), key=first) == sorted(map(tuple, plain.collect()), key=first)
