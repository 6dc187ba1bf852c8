"""Steps that read the rows with demand only, against the dense panel."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import forecast as FC
from shelfcast.operators import inventory as INV
from shelfcast.operators import panel as P
from shelfcast.operators import parts as PT

START, END = dt.date(2024, 1, 1), dt.date(2024, 6, 3)      # Mondays


def _activity(spark, step):
    """Series of several starts, one on the last day, one of a null key, some values unknown."""
    rng = random.Random(step)
    n = (END - START).days // step
    rows = [(k, START + dt.timedelta(days=step * i), None if rng.random() < 0.05 else float(rng.randint(0, 3)), float(i))
            for k, first in ((1, 0), (2, 9), (3, n), (None, 4)) for i in range(first, n + 1) if i == first or rng.random() < 0.2]
    return spark.createDataFrame(rows, "k int, day date, y double, c double")


def _rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("step, lookback", [(1, None), (1, 40), (7, None), (7, 6)])
def test_predictions_from_rows_with_demand_equal_the_dense_ones(spark, step, lookback):
    act = _activity(spark, step)
    dense = P.densify(act, END, "k", y="y", carry=(), step_days=step)
    folds = FC.folds(dense, "day", FC.DAILY_FOLDS if step == 1 else FC.WEEKLY_FOLDS, step)
    slot = None if step == 1 else F.pmod(F.floor(F.datediff("day", F.lit(START)) / 7), F.lit(4))
    get = lambda p: FC.backtest_predictions(p, folds, "k", y="y", lookback=lookback, season=7 if step == 1 else 4, window=28 if step == 1 else 4,
                                            step_days=step, slot=slot, cycle=7 if step == 1 else 4)
    got = _rows(get(act))
    assert got == _rows(get(dense)) and len(got) > 10
    expected = FC.baselines(dense.where("k IS NOT NULL"), folds, "k", y="y", season=7 if step == 1 else 4, window=28 if step == 1 else 4, step_days=step)
    names = ("fold", "k", "day", "horizon", "actual", "pred_naive", "pred_snaive", "pred_ma")
    assert _rows(get(act).where("k IS NOT NULL").select(*names)) == _rows(expected.select(*names))


def test_fold_quantiles_count_periods_without_demand(spark):
    act = spark.createDataFrame([(1, START, 5.0), (1, START + dt.timedelta(days=98), 5.0)], "k int, day date, y double")
    fold = FC.folds_of_span(spark.createDataFrame([(START, END)], "_first date, _last date"), [("f", 56, 55, 42)])
    r = FC.backtest_predictions(act, fold, "k", y="y").where("horizon = 1").first()
    assert (r.pred_p50_raw, r.pred_p90_raw, r.actual) == (0.0, 0.0, 0.0)      # 15 Tuesdays, all without demand
    counts = {r._y: r._n for r in FC.value_counts(act.withColumnRenamed("y", "_y"), fold, "k", "day", F.lit(0), 1).collect()}
    assert counts == {0.0: (END - START).days - 56 + 1 - 2, 5.0: 2}


@pytest.mark.parametrize("step", [1, 7])
def test_scale_and_active_series(spark, step):
    act = _activity(spark, step)
    dense = P.densify(act, END, "k", y="y", carry=(), step_days=step, lags=(4,))
    folds = FC.folds(dense, "day", FC.WEEKLY_FOLDS, step)
    scales, active = FC.training_stats(act, folds, "k", y="y", lag=4, step_days=step)
    train = dense.join(folds, F.col("day") <= F.col("train_end"))
    assert _rows(scales) == _rows(train.groupBy("fold").agg(F.avg(F.abs(F.col("y") - F.col("lag_4")))))
    days = F.datediff("train_end", "calendar_start") / step + 1
    mean = train.groupBy("fold", "k", days.alias("d")).agg(F.sum("y").alias("s")).select("fold", "k", (F.col("s") / F.col("d")).alias("m"))
    assert _rows(active) == _rows(mean.where("m >= 0.1"))


@pytest.mark.parametrize("options", [dict(windows=(7, 28)), dict(windows=(4, 8, 12), min_mean=1, min_std=2, fill_std=0.0)])
def test_rolling_from_rows_with_demand(spark, options):
    act = _activity(spark, 1).withColumn("y", F.when(F.col("k") == 2, F.col("y") + 1e8).otherwise(F.col("y")))
    got = P.densify(act, END, "k", y="y", carry=("c",), lags=(1, 3, 12), carry_lags=("c",), **options)
    plain = P.add_rolling(P.add_lags(P.densify(act, END, "k", y="y", carry=("c",)).fillna(0.0, subset=["c"]), "k", "day", "y", (1, 3, 12)), "k", "day", "y", **options)
    plain = P.add_lags(plain, "k", "day", "c", (1,), prefix="c_lag")
    names = [c for c in got.columns if c not in ("k", "day", "c")]
    both = [{(r.k, r.day): r for r in df.collect()} for df in (got, plain)]
    assert both[0].keys() == both[1].keys()
    for at, r in both[0].items():
        for c in names:
            a, b = r[c], both[1][at][c]
            assert (a is None and b is None) or a == pytest.approx(b, rel=1e-9, abs=1e-6), (at, c)


def test_dense_weeks_are_not_sorted(spark):
    act = _activity(spark, 7)
    d = P.densify(act, END, "k", y="y", carry=("c",), carry_lags=("c",), **PT.WEEKLY)
    plan = PT.weekly_features(d, "k", "day", "y", lag_domain=("c",))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan[:plan.index("Generate")] and "Sort" not in plan[:plan.index("Generate")]


def test_window_counts_of_days_with_demand(spark):
    act = _activity(spark, 1).where("k IS NOT NULL AND y IS NOT NULL").withColumn("end", F.lit(END))
    dense = P.densify(act, END, "k", y="y", carry=())
    length = spark.createDataFrame([(1, 5), (2, 30), (3, 2)], "k int, protection_days int")
    assert _rows(INV.window_total_counts(act, length, "k", y="y", last="end")) == _rows(INV.window_total_counts(dense, length, "k", y="y"))
    assert _rows(P.activity_totals(act, END, "day", "y")) == _rows(P.daily_totals(dense, "day", "y").select("day", "total"))


def test_weekly_extract_takes_any_return(spark):
    from shelfcast.plans import q_parts as Q
    day = dt.datetime(2000, 1, 3)
    lines = spark.createDataFrame([(1, day, 1.0, "N"), (1, day, 1.0, "R"), (2, day, 1.0, None)],
                                  "l_partkey int, l_shipdate timestamp_ntz, l_quantity double, l_returnflag string")
    assert {r.part_id: r.had_return for r in Q.weekly_extract({"lineitem": lines}).collect()} == {1: 1, 2: 0}
