"""Feature panel: leakage inertness (D9), no future rows (F2), forbidden
columns (D8), lag = manual shift, determinism across shuffle partitions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import panel as P

ORIGIN = "2018-06-01"


def _synthetic(spark, spike: bool):
    """Two sellers, 2 items on weekdays and 1 on weekends, price 100, freight
    10, approved +2h, carrier +1d, customer +5d; optional spike after origin."""
    rows, day = [], dt.date(2018, 3, 1)
    oid = 0
    while day <= dt.date(2018, 7, 15):
        n = 1 if day.weekday() >= 5 else 2
        for seller in ("a", "b"):
            for _ in range(n):
                oid += 1
                ts = dt.datetime.combine(day, dt.time(10))
                rows.append((str(oid), seller, "delivered", ts, ts + dt.timedelta(hours=2),
                             ts + dt.timedelta(days=1), ts + dt.timedelta(days=5), 100.0, 10.0))
        if spike and day > dt.date(2018, 6, 1):
            for _ in range(40):
                oid += 1
                ts = dt.datetime.combine(day, dt.time(11))
                rows.append((str(oid), "a", "delivered", ts, ts, ts, ts + dt.timedelta(days=1), 999.0, 10.0))
        day += dt.timedelta(days=1)
    return spark.createDataFrame(rows, "order_id string, seller_id string, order_status string, "
                                       "purchase_ts timestamp_ntz, approved_ts timestamp_ntz, carrier_ts timestamp_ntz, "
                                       "delivered_ts timestamp_ntz, price double, freight double")


LT = dict(status="order_status", delivered_value="delivered", purchase="purchase_ts", approved="approved_ts",
          carrier="carrier_ts", delivered="delivered_ts")


def _features(spark, spike):
    return P.build_features(_synthetic(spark, spike), ORIGIN, "seller_id", "purchase_ts", "price", "freight",
                            LT, holidays=P.holiday_table(spark))


def test_post_origin_spike_is_inert(spark):
    a, b = _features(spark, False), _features(spark, True)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_no_future_rows_and_lead_times(spark):
    f = _features(spark, True)
    assert P.future_rows(f, "day", ORIGIN).first()[0] == 0
    r = f.agg(F.max("lt_mean").alias("m"), F.min("lt_n").alias("n")).first()
    assert r.m <= 5.001 and r.n >= 0


def test_forbidden_columns(spark):
    cols = _features(spark, False).columns
    assert not [c for c in cols if any(w in c.lower() for w in ("discount", "promo", "weather"))]


def test_lag_equals_shift_and_rolling(spark):
    f = _features(spark, False).filter(F.col("seller_id") == "a").orderBy("day").toPandas()
    assert (f["lag_1"].iloc[1:].to_numpy() == f["n_items"].iloc[:-1].to_numpy()).all()
    exp = f["n_items"].shift(1).rolling(7).std()
    got = f["roll_std_7"]
    assert ((exp.isna() & got.isna()) | ((exp - got).abs() < 1e-9)).all()


@pytest.mark.parametrize("levels", [(0.0, 0.0), (1e8, 1e8), (0.0, 1e8)])
def test_rolling_survives_a_change_of_level(spark, levels):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(1)
    y = pd.Series(np.repeat(levels, 200) + rng.uniform(0, 1, 400))
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(y)], "k string, d int, y double")
    got = P.add_rolling(df, "k", "d", "y").orderBy("d").toPandas()
    for k in (7, 28):
        for name, exact in (("mean", y.shift(1).rolling(k).apply(np.mean)), ("std", y.shift(1).rolling(k).apply(lambda v: np.std(v, ddof=1)))):
            mine = got[f"roll_{name}_{k}"]
            assert (mine.isna() == exact.isna()).all()
            assert ((mine - exact).abs() / exact.abs().clip(lower=1)).max() < 1e-6


def test_easter_and_movable_feasts(spark):
    from pyspark.sql import functions as F

    def other_form(y):
        a, b, c = y % 19, y // 100, y % 100
        h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
        r = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
        m = (a + 11 * h + 22 * r) // 451
        return dt.date(y, (h + r - 7 * m + 114) // 31, (h + r - 7 * m + 114) % 31 + 1)

    got = spark.range(1583, 2600).select(F.col("id").cast("int").alias("y")).select("y", P.easter(F.col("y")).alias("e")).collect()
    assert all(r.e == other_form(r.y) for r in got)
    days = spark.createDataFrame([(dt.date(2018, 2, 13),), (dt.date(2018, 3, 30),), (dt.date(2018, 4, 1),), (dt.date(2018, 5, 31),),
                                  (dt.date(2018, 5, 1),), (None,)], "d date")
    assert [r[0] for r in days.select(P.movable_feast(F.col("d"))).collect()] == [
        "carnival", "good_friday", "easter", "corpus_christi", None, None]


def test_bag_difference_counts_repeats(spark):
    from shelfcast.operators.quality import bag_difference
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(1, None), (3, "y"), (3, "y")], "k int, v string")
    assert tuple(bag_difference(a, b).first()) == (2, 2) and tuple(bag_difference(a, a).first()) == (0, 0)
    assert tuple(bag_difference(a.limit(0), b.limit(0)).first()) == (0, 0)


def test_dead_zone_truncation(spark):
    rows = [(d, 10.0 if d < 100 else 0.5) for d in range(130)]
    base = dt.date(2020, 1, 1)
    panel = spark.createDataFrame([("s", base + dt.timedelta(days=d), y) for d, y in rows],
                                  "k string, day date, n_items double")
    cut = P.activity_cutoff(panel).first()["cutoff"]
    assert cut == base + dt.timedelta(days=99)
