"""Direct-forecast features know nothing of the forecast days; exact quantiles
of large groups; weekly folds and baselines."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import forecast as FC
from shelfcast.operators import ordering as O
from shelfcast.operators import panel as P


def _panel(spark, change_after):
    day0 = dt.date(2024, 1, 1)
    rows = []
    for k in ("a", "b"):
        for i in range(100):
            after = i > change_after
            rows.append((k, day0 + dt.timedelta(days=i), 99.0 if after else float(i % 5),
                         1e6 if after else (None if i % 3 else 10.0 + i)))
    return spark.createDataFrame(rows, "k string, day date, y double, price double")


def test_direct_features_ignore_the_forecast_days(spark):
    end = dt.date(2024, 1, 1) + dt.timedelta(days=85)      # 14 days are left
    seen = [P.direct_features(_panel(spark, n), "k", "day", "y", 14, known=("price",)).filter(F.col("day") > F.lit(end))
            .drop("y", "price") for n in (85, 1000)]
    assert seen[0].count() == 28
    assert seen[0].exceptAll(seen[1]).isEmpty() and seen[1].exceptAll(seen[0]).isEmpty()


def test_exact_quantiles(spark):
    rng = random.Random(5)
    rows = [(g, rng.choice([rng.random(), 0.25, None])) for g in "xyz" for _ in range(501)] + [("one", 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    for q in (0.0, 0.1, 0.5, 0.9, 1.0):
        exp = {r.g: r.p for r in df.groupBy("g").agg(F.percentile("v", F.lit(q)).alias("p")).collect()}
        got = {r.g: r.quantile for r in O.quantiles(df, "v", q, ("g",)).collect()}
        assert got == pytest.approx(exp)


def test_weekly_folds_and_baselines(spark):
    week0 = dt.date(2024, 1, 1)
    p = spark.createDataFrame([("s", week0 + dt.timedelta(days=7 * i), float(i)) for i in range(20)], "k string, week date, y double")
    folds = FC.folds(p, "week", FC.WEEKLY_FOLDS, 7)
    f = {r.fold: r for r in folds.collect()}
    assert f["fold_3"].train_end == week0 + dt.timedelta(days=7 * 17) and f["fold_3"].test_end == week0 + dt.timedelta(days=7 * 19)
    rows = FC.baselines(p, folds, "k", "week", "y", season=4, window=4, step_days=7).filter("fold = 'fold_3'").orderBy("horizon").collect()
    assert [(r.horizon, r.pred_naive, r.pred_snaive, r.pred_ma) for r in rows] == [(1, 17.0, 14.0, 15.5), (2, 17.0, 15.0, 15.5)]
