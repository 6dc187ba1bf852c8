"""Folds, baselines, the empirical quantile model and the backtest metrics
table (F6, W10, M1-M3, M4a, M5, M6, M10, E10).

All folds are evaluated in one plan: the rows with demand are range-joined to
a broadcast fold table (a handful of rows) and reduced to per-(fold, series)
counts. ``step_days`` is the length of a period: 1 for
the daily track, 7 for the weekly one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M

# Fold offsets in days before the panel's last day
# (name, train_end, test_start, test_end).
DAILY_FOLDS = [("fold_1", 56, 55, 42), ("fold_2", 42, 41, 28),
               ("fold_3", 28, 27, 14), ("holdout", 14, 13, 0)]

# The same of the weekly track, in weeks before the last week.
WEEKLY_FOLDS = [("fold_1", 6, 5, 4), ("fold_2", 4, 3, 2), ("fold_3", 2, 1, 0)]


def folds(panel: DataFrame, day: str = "day", spec=DAILY_FOLDS, step_days: int = 1) -> DataFrame:
    """fold table relative to the last day of ``panel`` (offsets of
    ``spec`` in periods): one global min/max aggregate expanded into one row
    per fold (no join)."""
    return folds_of_span(panel.agg(F.max(day).alias("_last"), F.min(day).alias("_first")), spec, step_days)


def folds_of_span(span: DataFrame, spec=DAILY_FOLDS, step_days: int = 1) -> DataFrame:
    """``folds`` from one row with a panel's ``_first`` and ``_last`` day."""
    spec = [(n, *(x * step_days for x in offsets)) for n, *offsets in spec]
    last, first = F.col("_last"), F.col("_first")
    rows = F.array(*[F.struct(F.lit(n).alias("fold"), F.date_sub(last, a).alias("train_end"),
                              F.date_sub(last, b).alias("test_start"),
                              F.date_sub(last, c).alias("test_end"),
                              first.alias("calendar_start")) for n, a, b, c in spec])
    return span.select(F.inline(rows))


def split(panel: DataFrame, fold_df: DataFrame, day: str = "day", lookback: int | None = None) -> DataFrame:
    """tag panel rows with (fold, role) for all folds at once: role
    'train' for ``day <= train_end`` (optionally only the last ``lookback``
    days), 'test' for ``test_start <= day <= test_end``. A range join against
    a broadcast fold table: a filter per row, no shuffle."""
    d, f = F.col(day), F.broadcast(fold_df)
    lo = (F.date_sub("train_end", lookback - 1) if lookback else F.lit(None))
    train = (d <= F.col("train_end")) & (F.lit(lookback is None) | (d >= lo))
    test = d.between(F.col("test_start"), F.col("test_end"))
    return (panel.join(f.drop("calendar_start"), train | test, "inner")
            .withColumn("role", F.when(test, F.lit("test")).otherwise(F.lit("train"))))


#: Days of a bin of the interval join.
BIN_DAYS = 32


def rolling_origins(panel: DataFrame, n: int, step_days: int, train_days: int, test_days: int, day: str = "day") -> DataFrame:
    """F6 for any number of origins: ``origin`` 0..n-1 (0 ends with the last
    day) with a ``role`` and its days ``first_day``..``last_day``."""
    k = F.col("origin")
    end = F.date_sub("_last", (k * step_days + test_days).cast("int"))
    role = lambda name, a, b: F.struct(F.lit(name).alias("role"), a.alias("first_day"), b.alias("last_day"))
    return (panel.agg(F.max(day).alias("_last")).where("_last IS NOT NULL")
            .select("_last", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("origin"))
            .select("origin", end.alias("train_end"), F.inline(F.array(
                role("train", F.date_sub(end, train_days - 1), end), role("test", F.date_add(end, 1), F.date_add(end, test_days))))))


def interval_join(panel: DataFrame, intervals: DataFrame, day: str = "day", first: str = "first_day", last: str = "last_day",
                  bin_days: int = BIN_DAYS) -> DataFrame:
    """Every row of ``panel`` with every interval that holds its day, columns
    of both. Intervals are dealt into bins of days and joined by bin number, so
    the join is an equality join whatever the number of intervals; the exact
    days are checked after it. The panel's scan gets the days of all intervals
    together as a plain filter."""
    span = intervals.agg(F.min(first).alias("a"), F.max(last).alias("b")).first()
    bin_of = lambda c: F.floor(F.unix_date(c) / bin_days)
    dealt = intervals.select("*", F.explode(F.sequence(bin_of(F.col(first)), bin_of(F.col(last)))).alias("_bin"))
    rows = panel.where(F.col(day).between(F.lit(span.a), F.lit(span.b))).withColumn("_bin", bin_of(F.col(day)))
    return rows.join(dealt, "_bin").where(F.col(day).between(F.col(first), F.col(last))).drop("_bin")


def horizon(day: str = "day", train_end: str = "train_end", step_days: int = 1) -> Column:
    """Periods since train end (1..h), by date, not row ordinal (Q4)."""
    gap = F.datediff(F.col(day), F.col(train_end))
    return gap if step_days == 1 else F.floor(gap / step_days).cast("int")


def baselines(panel: DataFrame, fold_df: DataFrame, key: str, day: str = "day",
              y: str = "n_items", season: int = 7, window: int = 28,
              mode: str = "seasonal", step_days: int = 1) -> DataFrame:
    """M1 naive, M2 seasonal naive, M3 moving average for every (fold, series,
    test day). Values before a series' first day count as 0 (whole-calendar
    semantics, Q3). ``mode='mirrored'`` reproduces the source application's
    indexing (h=1 -> last value); the default takes the value one season back."""
    rows = split(panel.select(key, day, y), fold_df, day, lookback=max(window, season) * step_days)
    pw = Window.partitionBy("fold", key)
    te = F.col("train_end")
    lastv = [F.coalesce(F.max(F.when(F.col(day) == F.date_sub(te, k * step_days), F.col(y))).over(pw),
                        F.lit(0.0)) for k in range(season)]
    h = horizon(day, step_days=step_days)
    idx = (((h - 1) % season) if mode == "mirrored" else ((-h) % season + season) % season)
    tail = F.col(day).between(F.date_sub(te, (window - 1) * step_days), te)
    return (rows.select("*", h.alias("horizon"),
                        F.array(*lastv).alias("_last"),
                        (F.coalesce(F.sum(F.when(tail, F.col(y))).over(pw), F.lit(0.0))
                         / F.lit(float(window))).alias("pred_ma"))
            .filter(F.col("role") == "test")
            .select("fold", key, day, "horizon", F.col(y).alias("actual"),
                    F.col("_last")[0].alias("pred_naive"),
                    F.element_at("_last", (idx + 1).cast("int")).alias("pred_snaive"),
                    "pred_ma", "train_end"))


def rearrange(df: DataFrame, cols=("pred_p10_raw", "pred_p50_raw", "pred_p90_raw"),
              out=("pred_p10", "pred_p50", "pred_p90"), lo: float = 0.0) -> DataFrame:
    """M6: row-wise sort of the quantiles, then clip at ``lo``; also flags a
    crossing in the raw values (counted before rearrangement)."""
    s = F.transform(F.array_sort(F.array(*[F.col(c) for c in cols])),
                    lambda x: F.greatest(x, F.lit(lo)))
    cross = F.lit(False)
    for a, b in zip(cols, cols[1:]):
        cross = cross | (F.col(a) > F.col(b))
    return df.select("*", *[s[i].alias(o) for i, o in enumerate(out)],
                     cross.cast("int").alias("crossing"))


def _from(first: Column, at: Column, step_days: int) -> Column:
    """First day of a series with a row every ``step_days`` from ``first`` that is not before ``at``."""
    steps = F.greatest(F.ceil(F.datediff(at, first) / step_days), F.lit(0))
    return F.date_add(first, (steps * step_days).cast("int"))


def value_counts(act: DataFrame, fold_df: DataFrame, key: str, day: str, slot: Column, cycle: int,
                 lookback: int | None = None, step_days: int = 1) -> DataFrame:
    """How often each value ``_y`` occurs among the training rows of a (fold,
    series, slot). ``act`` has the rows with demand; the periods without it
    are counted, as the periods of the series less its rows, not made."""
    te, d = F.col("train_end"), F.col(day)
    f = F.broadcast(fold_df)
    begin, known = F.col("_first"), d <= te
    if lookback is not None:
        since = F.date_sub(te, (lookback - 1) * step_days)
        begin, known = _from(begin, since, step_days), known & (d >= since)
    active = act.join(f, known).groupBy("fold", key, slot.alias("_dow"), "_y").agg(F.count(F.lit(1)).alias("_n"))
    active = active.select("fold", key, "_dow", F.inline(F.array(F.struct("_y", "_n"), F.struct(F.lit(0.0).alias("_y"), (-F.col("_n")).alias("_n")))))
    span = act.groupBy(key).agg(F.min(day).alias("_first")).join(f, F.col("_first") <= te).withColumn("_begin", begin)
    periods = F.floor(F.datediff(te, "_begin") / step_days) + 1
    span = span.select("fold", key, "_begin", periods.alias("_periods"), F.explode(F.sequence(F.lit(0), F.lit(cycle - 1))).alias("_i"))
    days = span.where("_i < _periods").withColumn(day, F.date_add("_begin", F.col("_i") * step_days)).select(
        "fold", key, slot.alias("_dow"), F.lit(0.0).alias("_y"), (F.floor((F.col("_periods") - 1 - F.col("_i")) / cycle) + 1).alias("_n"))
    return active.unionByName(days).groupBy("fold", key, "_dow", "_y").agg(F.sum("_n").alias("_n")).where("_n > 0")


def backtest_predictions(activity: DataFrame, fold_df: DataFrame, key: str, day: str = "day",
                         y: str = "n_items", lookback: int | None = None, mode: str = "seasonal",
                         season: int = 7, window: int = 28, qs=(0.1, 0.5, 0.9),
                         min_obs: int = 3, step_days: int = 1, slot: Column | None = None, cycle: int = 7) -> DataFrame:
    """Baselines (M1-M3) and rearranged empirical quantiles (M4a, M6) side by
    side per (fold, series, test day).

    ``activity`` has at most one row per series and period; a period without a
    row, from the series' first one on, has no demand (0). Only these rows are
    shuffled, once by series, and the dense panel is never made: periods
    without demand are counted, and only test rows are laid out.

    The quantiles are those of the target by (series, slot) -- the slot is the
    day of week unless another expression is given, the same every ``cycle``
    periods -- over the whole training history (or its last ``lookback`` days), backing off to the
    series and then to the fold with fewer than ``min_obs`` rows. Every
    quantile is taken from counts of (fold, series, slot, value).
    Direct multi-horizon (M5): only what is known at the train end is used."""
    slot = F.weekday(day) if slot is None else slot
    act = activity.select(key, day, F.col(y).cast("double").alias("_y")).repartition(key)
    f = fold_df.select("fold", "train_end", "test_start", "test_end")
    te, d = F.col("train_end"), F.col(day)
    qarr = F.array(*[F.lit(q) for q in qs])
    counts = value_counts(act, f, key, day, slot, cycle, max(lookback, window, season) if lookback else None, step_days)

    def quantiles(df, by, tag):
        return df.groupBy(*by).agg(F.sum("_n").alias(f"_n_{tag}"), F.percentile("_y", qarr, F.col("_n")).alias(f"_q_{tag}"))

    by_dow = quantiles(counts, ("fold", key, "_dow"), "sd")
    by_series = quantiles(counts, ("fold", key), "s")
    by_fold = quantiles(counts.groupBy("fold", "_y").agg(F.sum("_n").alias("_n")), ("fold",), "g").drop("_n_g")
    # Baselines need the last season and window before the train end only.
    tail = d.between(F.date_sub(te, (window - 1) * step_days), te)
    lastv = [F.coalesce(F.max(F.when(d == F.date_sub(te, k * step_days), F.col("_y"))), F.lit(0.0)) for k in range(season)]
    tested = d.between(F.col("test_start"), F.col("test_end"))
    near = act.join(F.broadcast(f), (d > F.date_sub(te, max(window, season) * step_days)) & ((d <= te) | tested))
    seeds = act.groupBy(key).agg(F.min(day).alias("_first")).join(F.broadcast(f), F.col("_first") <= F.col("test_end"))
    known = near.unionByName(seeds, allowMissingColumns=True).groupBy("fold", key, *f.columns[1:]).agg(
        F.max("_first").alias("_first"), F.array(*lastv).alias("_last"),
        (F.coalesce(F.sum(F.when(tail, F.col("_y"))), F.lit(0.0)) / F.lit(float(window))).alias("pred_ma"),
        F.map_from_entries(F.collect_list(F.when(tested, F.struct(d, F.col("_y"))))).alias("_seen"))
    first_test = _from(F.col("_first"), F.col("test_start"), step_days)
    step = F.expr(f"INTERVAL {step_days} DAYS")
    test = known.where(first_test <= F.col("test_end")).select(
        "fold", key, "train_end", "_last", "pred_ma", "_seen", F.explode(F.sequence(first_test, F.col("test_end"), step)).alias(day))
    actual = F.when(F.map_contains_key("_seen", d), F.try_element_at("_seen", d)).otherwise(F.lit(0.0))
    out = (test.select("fold", key, day, "train_end", "_last", "pred_ma", actual.alias("actual"), slot.alias("_dow"))
           .join(by_dow, ["fold", key, "_dow"], "left").join(by_series, ["fold", key], "left")
           .join(F.broadcast(by_fold), "fold", "left"))
    qv = (F.when(F.col("_n_sd") >= min_obs, F.col("_q_sd"))
          .when(F.col("_n_s") >= min_obs, F.col("_q_s")).otherwise(F.col("_q_g")))
    h = horizon(day, step_days=step_days)
    idx = (((h - 1) % season) if mode == "mirrored" else ((-h) % season + season) % season)
    names = [f"pred_p{int(round(q * 100))}_raw" for q in qs]
    # A null series has no baselines, as it joins nothing.
    own = lambda c: F.when(F.col(key).isNotNull(), c).otherwise(F.lit(0.0))
    res = out.select("fold", key, day, h.alias("horizon"), "actual", own(F.col("_last")[0]).alias("pred_naive"),
                     own(F.element_at("_last", (idx + 1).cast("int"))).alias("pred_snaive"),
                     own(F.col("pred_ma")).alias("pred_ma"), "train_end",
                     *[qv[i].alias(n) for i, n in enumerate(names)])
    return rearrange(res)


def training_stats(activity: DataFrame, fold_df: DataFrame, key: str, day: str = "day", y: str = "n_items",
                   lag: int = 7, min_daily: float = 0.10, step_days: int = 1):
    """MASE scale per fold (E2: the mean change over ``lag`` periods) and the
    active-series set (A6) from the rows with demand, as in
    ``backtest_predictions``. A change is not 0 only at a row, or ``lag``
    periods after one; one window over these rows finds both, and all other
    changes are only counted."""
    back, f = lag * step_days, F.broadcast(fold_df)
    act = activity.select(key, day, F.col(y).alias("_y"))
    at = Window.partitionBy(key).orderBy(F.unix_date(day))
    before, after = at.rangeBetween(-back, -back), at.rangeBetween(back, back)
    old = F.when(F.count(F.lit(1)).over(before) > 0, F.max("_y").over(before)).otherwise(F.lit(0.0))
    first = F.min(day).over(Window.partitionBy(key))
    near = act.select(key, day, "_y", first.alias("_first"), old.alias("_old"), (F.count(F.lit(1)).over(after) == 0).alias("_alone"))
    moves = near.select(F.col(day).alias("_from"), F.inline(F.array(
        F.struct(F.col(day).alias("_at"), F.abs(F.col("_y") - F.col("_old")).alias("_d"), (F.datediff(day, "_first") >= back).alias("_counts")),
        F.struct(F.date_add(day, back).alias("_at"), F.abs("_y").alias("_d"), F.col("_alone").alias("_counts"))))).where("_counts")
    changes = moves.join(f, F.col("_at") <= F.col("train_end")).groupBy("fold").agg(
        F.sum("_d").alias("_ad"), F.count_if(F.col("_d").isNull()).alias("_unknown"))
    periods = F.greatest(F.floor(F.datediff("train_end", "_first") / step_days) - lag + 1, F.lit(0))
    spans = act.groupBy(key).agg(F.min(day).alias("_first")).join(f, F.col("_first") <= F.col("train_end"))
    scales = spans.groupBy("fold").agg(F.sum(periods).alias("_all")).join(F.broadcast(changes), "fold", "left").select(
        "fold", (F.coalesce("_ad", F.lit(0.0)) / F.nullif(F.col("_all") - F.coalesce("_unknown", F.lit(0)), F.lit(0))).alias("mase_scale"))
    n_days = F.datediff("train_end", "calendar_start") / step_days + 1
    active = (act.join(f, F.col(day) <= F.col("train_end")).groupBy("fold", key, n_days.alias("_days")).agg(F.sum("_y").alias("_s"))
              .select("fold", key, (F.col("_s") / F.col("_days")).alias("train_mean"))
              .filter(F.col("train_mean") >= min_daily))
    return scales, active


MODELS = [("naive", "pred_naive"), ("snaive", "pred_snaive"), ("ma", "pred_ma"),
          ("q_p50", "pred_p50")]


def backtest_metrics(preds: DataFrame, scales: DataFrame, active: DataFrame, key: str) -> DataFrame:
    """Long metric table ``(fold, model, metric, value)``: point metrics
    for every model (MAE, RMSE, sMAPE, WAPE, bias, MASE) and the quantile
    diagnostics (coverage overall/active, pinball, width, shares, crossings).
    Models are unpivoted first so one grouped aggregate computes them all."""
    a = F.col("actual")
    p = preds.join(active.select("fold", key, F.lit(1).alias("_act")), ["fold", key], "left")
    long = p.select("fold", "actual", F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(c).alias("pred")) for m, c in MODELS])).alias("_m"))
    point = (long.groupBy("fold", F.col("_m.model").alias("model"))
             .agg(M.mae(a, "_m.pred").alias("mae"), M.rmse(a, "_m.pred").alias("rmse"),
                  M.smape(a, "_m.pred").alias("smape"), M.wape(a, "_m.pred").alias("wape"),
                  M.bias(a, "_m.pred").alias("bias"))
             .join(F.broadcast(scales), "fold", "left")
             .withColumn("mase", M.mase(F.col("mae"), F.col("mase_scale"))))
    point_long = point.select("fold", "model", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
        for m in ("mae", "rmse", "smape", "wape", "bias", "mase")])).alias("_v"))
    act = F.col("_act").isNotNull()
    qm = p.groupBy("fold").agg(
        M.coverage(a, "pred_p10", "pred_p90").alias("coverage"),
        F.avg(F.when(act, M.covered(a, "pred_p10", "pred_p90"))).alias("coverage_active"),
        M.share(act).alias("active_share"),
        M.share(a == 0).alias("zero_actual_share"),
        M.share((F.col("pred_p90") - F.col("pred_p10")) < 1e-9).alias("degenerate_share"),
        M.interval_width("pred_p10", "pred_p90").alias("width"),
        M.pinball(a, "pred_p10", 0.1).alias("pinball_p10"),
        M.pinball(a, "pred_p50", 0.5).alias("pinball_p50"),
        M.pinball(a, "pred_p90", 0.9).alias("pinball_p90"),
        M.share(a <= F.col("pred_p10")).alias("coverage_p10_one_sided"),
        M.share(a <= F.col("pred_p90")).alias("coverage_p90_one_sided"),
        F.sum("crossing").cast("double").alias("crossings"))
    qcols = ["coverage", "coverage_active", "active_share", "zero_actual_share",
             "degenerate_share", "width", "pinball_p10", "pinball_p50", "pinball_p90",
             "coverage_p10_one_sided", "coverage_p90_one_sided", "crossings"]
    q_long = qm.select("fold", F.lit("q").alias("model"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
        for m in qcols])).alias("_v"))
    return (point_long.unionByName(q_long)
            .select("fold", "model", F.col("_v.metric").alias("metric"),
                    F.col("_v.value").alias("value")))
