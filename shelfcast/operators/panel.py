"""Series x period demand panel and its leakage-free features.

A1 daily_activity, A2 lead_time_stats, P2 densify, W1 add_lags,
W2/W3 add_rolling, W4/W5 add_calendar, W9 add_ratio, F1/F2 origin rules,
F3 valid_sequence, F5 truncate_dead_zone, W6 trailing median, J3 attach.

Physical shape: activity is aggregated (partial + final hash aggregate),
shuffled once by the series key for densification, and every window
afterwards (lags, both rolling frames) reuses that partitioning, so the
panel costs two shuffles of *aggregated* rows, never a shuffle of raw lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _d(x) -> Column:
    return x if isinstance(x, Column) else F.to_date(F.lit(str(x)))


def origin_end(origin) -> Column:
    """Exclusive upper bound for 'known by the end of the origin day' (F1):
    ``ts < origin + 1 day`` keeps the same rows as ``ts <= origin 23:59:59``
    at second resolution and is also exact for sub-second data."""
    return F.date_add(_d(origin), 1).cast("timestamp_ntz")


def valid_sequence(purchase: str, approved: str, carrier: str, delivered: str) -> Column:
    """approved and carrier known, purchase <= approved <= carrier <=
    delivered. A NULL comparison drops the row (violators are excluded,
    never repaired)."""
    p, a, c, d = (F.col(x) for x in (purchase, approved, carrier, delivered))
    return (a.isNotNull() & c.isNotNull() & (a >= p) & (c >= a) & (d >= c))


def daily_activity(lines: DataFrame, origin, key: str, ts: str, price: str,
                   freight: str, day: str = "day") -> DataFrame:
    """A1: items, mean price and mean freight per (series, day), truncated at
    the origin (F1). The filter sits below the aggregate so it reaches the scan."""
    return (lines.filter(F.col(ts) < origin_end(origin))
            .groupBy(F.col(key), F.to_date(F.col(ts)).alias(day))
            .agg(F.count(F.lit(1)).cast("double").alias("n_items"),
                 F.avg(price).alias("avg_price"),
                 F.avg(freight).alias("avg_freight")))


def lead_time_days(start: str, end: str) -> Column:
    """Fractional days between two NTZ timestamps."""
    return F.expr(f"timestampdiff(MICROSECOND, {start}, {end})") / F.lit(86400e6)


def lead_time_stats(lines: DataFrame, origin, key: str, status: str, delivered_value: str,
                    purchase: str, approved: str, carrier: str, delivered: str) -> DataFrame:
    """A2 (with F3, F4): per-series lead-time snapshot as of ``origin`` from
    orders purchased AND delivered by then that pass the sequence checks.
    Weighted per item; mean, sample std, p50/p90 (linear interpolation), n."""
    end = origin_end(origin)
    lt = (lines.filter((F.col(status) == delivered_value) & (F.col(purchase) < end)
                       & (F.col(delivered) < end)
                       & valid_sequence(purchase, approved, carrier, delivered))
          .select(key, lead_time_days(purchase, delivered).alias("lt_days")))
    return (lt.groupBy(key)
            .agg(F.avg("lt_days").alias("lt_mean"),
                 F.stddev_samp("lt_days").alias("lt_std"),
                 F.percentile("lt_days", F.lit(0.5)).alias("lt_p50"),
                 F.percentile("lt_days", F.lit(0.9)).alias("lt_p90"),
                 F.count(F.lit(1)).alias("lt_n")))


def densify(activity: DataFrame, origin, key, day: str = "day", y: str = "n_items",
            carry=("avg_price", "avg_freight"), step_days: int = 1, lags=(), windows=(),
            min_mean: int | None = None, min_std: int | None = None, fill_std=None, carry_lags=()) -> DataFrame:
    """Dense series x day grid from each series' own first day through
    the origin, zero-filled. Each activity row generates the empty days after
    it and the next activity row (``lead`` in one window), the first one itself
    too, so no calendar cross join and no join back to the activity: one
    shuffle by ``key``.

    ``lags`` adds lag_k of ``y`` (W1) and ``windows`` the columns of
    ``add_rolling`` (W2/W3, previous rows only) from the same window: the value
    k periods back is one of the last k activity rows' or 0, so only the
    activity is sorted, never the dense rows. An activity row knows the values
    of the periods up to it and what they add up to; the rows that it generates
    look them up and count the zeros between. ``carry_lags`` adds <column>_lag1
    of carried columns, 0 where a period lacks it."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(F.unix_date(day) if windows else F.col(day))
    step = F.expr(f"INTERVAL {step_days} DAYS")
    far = max((*lags, *windows, 0))
    own = [y, *carry]
    known = [*keys, F.col(day).alias("_day"), F.struct(*own).alias("_own"), F.lead(F.struct(F.col(day).alias("_day"), *own)).over(w).alias("_next"),
             (F.row_number().over(w) == 1).alias("_is_first")]
    if far:
        near = F.collect_list(F.struct(F.col(day), F.col(y).cast("double").alias("y"))).over(w.rowsBetween(-far, 0))
        known += [F.map_from_entries(near).alias("_near"), F.first(day).over(w).alias("_first")]
    for j in range(max((*windows, 0))):
        last, v = w.rangeBetween(-j * step_days, 0), F.col(y).cast("double")
        known += [F.count(F.lit(1)).over(last).alias(f"_rows{j}"), F.count(v).over(last).alias(f"_m{j}"),
                  F.sum(v).over(last).alias(f"_sum{j}"), F.var_pop(v).over(last).alias(f"_var{j}")]
    g = activity.select(*known)
    if far:
        def back(j):
            at = F.date_sub(F.col("_day"), (j * step_days).cast("int"))
            return F.when(at >= F.col("_first"), F.when(F.map_contains_key("_near", at), F.try_element_at("_near", at)).otherwise(F.lit(0.0)))

        # Values by periods back: number 0 is the row's own, null before the first day.
        known = {"_back": F.transform(F.sequence(F.lit(0), F.lit(far)), back)}
        if windows:
            known["_parts"] = F.array(*[_part(*[F.col(f"_{c}{j}") for c in ("rows", "m", "sum", "var")]) for j in range(max(windows))])
        g = g.withColumns(known).drop("_near", *[f"_{c}{j}" for c in ("rows", "m", "sum", "var") for j in range(max((*windows, 0)))])
    begin, end = F.when(F.col("_is_first"), F.col("_day")).otherwise(F.date_add("_day", step_days)), F.coalesce("_next._day", _d(origin))
    g = g.where(begin <= end).select("*", F.explode(F.sequence(begin, end, step)).alias("_d"))
    at_next, at_own = F.coalesce(F.col("_d") == F.col("_next._day"), F.lit(False)), F.col("_d") == F.col("_day")
    if far or carry_lags:
        g = g.withColumn("_gap", F.floor(F.datediff("_d", "_day") / step_days).cast("int"))
    gap = F.col("_gap")
    if windows:
        # A window is the rows with demand in it, as the last of them knows, and zeros.
        # Steps of their own keep the generated code small: every part is computed once.
        none = _part(F.lit(0), F.lit(0), F.lit(0.0), F.lit(0.0))
        g = g.withColumns({f"_s{k}": F.coalesce(F.get("_parts", F.when(gap > 0, k - gap)), none) for k in windows}).drop("_parts")
        g = g.withColumn("_before", F.floor(F.datediff("_d", "_first") / step_days))
        g = g.withColumns({f"_n{k}": F.nullif(F.least("_before", F.lit(k)) - F.col(f"_s{k}.unknown"), F.lit(0.0)) for k in windows})
        for k in windows:
            part, n = F.col(f"_s{k}"), F.col(f"_n{k}")
            # The squares about the mean of both parts.
            square = part["sq"] + part["level"] * (n - part["n"]) / n
            std = F.when(n >= max(k if min_std is None else min_std, 2), F.sqrt(square / (n - 1)))
            if fill_std is not None:
                std = F.coalesce(std, F.lit(float(fill_std)))
            g = g.withColumns({f"roll_mean_{k}": F.when(n >= (k if min_mean is None else min_mean), part["sum"] / n), f"roll_std_{k}": std})

    def at(c, empty):
        return F.when(at_next, F.col(f"_next.{c}")).when(at_own, F.col(f"_own.{c}")).otherwise(empty)

    out = [*[F.col(k) for k in keys], F.col("_d").alias(day), at(y, F.lit(0.0)).alias(y)]
    out += [at(c, F.lit(None)).alias(c) for c in carry]
    out += [F.col(f"roll_{s}_{k}") for k in windows for s in ("mean", "std")]
    for k in lags:
        out.append(F.when(gap > k, F.lit(0.0)).otherwise(F.get("_back", k - gap)).alias(f"lag_{k}"))
    for c in carry_lags:
        out.append(F.when(gap == 1, F.coalesce(f"_own.{c}", F.lit(0.0))).when(gap > 1, F.lit(0.0)).alias(f"{c}_lag1"))
    return g.select(*out)


def _part(rows: Column, n: Column, total: Column, var: Column) -> Column:
    """Known and unknown values, the sum, the squares about the mean and the sum's square over n."""
    total = F.coalesce(total, F.lit(0.0))
    return F.struct(n.cast("double").alias("n"), (rows - n).cast("double").alias("unknown"), total.alias("sum"),
                    F.coalesce(var * n, F.lit(0.0)).alias("sq"), F.coalesce(total * total / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("level"))


def add_lags(panel: DataFrame, key: str, day: str, y: str, lags=(1, 7, 14, 28),
             prefix: str = "lag_") -> DataFrame:
    """``lag(y, k)`` per series; rows are dense so k rows = k periods."""
    w = Window.partitionBy(key).orderBy(day)
    return panel.select("*", *[F.lag(y, k).over(w).alias(f"{prefix}{k}") for k in lags])


def direct_features(panel: DataFrame, key: str, day: str, y: str, ahead: int, lags=(0, 7, 14), windows=(7, 28),
                    known=()) -> DataFrame:
    """Features of a direct forecast up to ``ahead`` periods out: all that a
    row sees of ``y`` and of the ``known`` columns (their last value that is
    not null) is at least ``ahead`` periods old, so every row of the
    ``ahead`` periods after a train end is known at the train end."""
    w = Window.partitionBy(key).orderBy(day)
    cols = [F.lag(y, ahead + k).over(w).alias(f"lag_{ahead + k}") for k in lags]
    for k in windows:
        fr = w.rowsBetween(-(ahead + k - 1), -ahead)
        cols += [F.avg(y).over(fr).alias(f"roll_mean_{k}"), F.stddev_samp(y).over(fr).alias(f"roll_std_{k}")]
    past = w.rowsBetween(Window.unboundedPreceding, -ahead)
    cols += [F.last(c, ignorenulls=True).over(past).alias(f"last_{c}") for c in known]
    return panel.select("*", *cols)


def add_level(panel: DataFrame, key: str, day: str, y: str, out: str, ahead: int) -> DataFrame:
    """Mean of all that a series has shown up to ``ahead`` periods before a row."""
    past = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, -ahead)
    return panel.select("*", F.avg(y).over(past).alias(out))


def add_rolling(panel: DataFrame, key: str, day: str, y: str, windows=(7, 28),
                min_mean: int | None = None, min_std: int | None = None,
                fill_std=None, exclude_current: bool = True) -> DataFrame:
    """Rolling mean and sample std over the previous ``k`` rows
    (current row excluded). ``min_mean``/``min_std`` default to ``k`` (a full
    window is required, the daily track); the weekly track uses 1/2 and
    ``fill_std=0``. Requires a dense panel (one row per period, non-null y).

    Each sliding frame (a few dozen rows) is aggregated by itself: differences
    of running sums would lose a small spread after a change of level. Every
    expression shares the lag window's partitioning and sort (one exchange)."""
    w = Window.partitionBy(key).orderBy(day)
    cols = []
    for k in windows:
        fr = w.rowsBetween(-k, -1) if exclude_current else w.rowsBetween(-(k - 1), 0)
        n = F.count(y).over(fr)
        std = F.when(n >= (k if min_std is None else min_std), F.stddev_samp(F.col(y).cast("double")).over(fr))
        if fill_std is not None:
            std = F.coalesce(std, F.lit(float(fill_std)))
        cols += [F.when(n >= (k if min_mean is None else min_mean), F.avg(y).over(fr)).alias(f"roll_mean_{k}"),
                 std.alias(f"roll_std_{k}")]
    return panel.select("*", *cols)


# Fixed-date national holidays of the source calendar (month, day).
FIXED_HOLIDAYS = [(1, 1), (4, 21), (5, 1), (9, 7), (10, 12), (11, 2), (11, 15), (12, 25)]


# Days from Easter Sunday to the movable feasts of the calendar.
MOVABLE_FEASTS = {"carnival": -47, "good_friday": -2, "easter": 0, "corpus_christi": 60}


def easter(year: Column) -> Column:
    """Easter Sunday of a Gregorian year in integer arithmetic on columns: the
    paschal full moon from the golden number and the century's corrections,
    then the Sunday after it."""
    def quotient(a, b):
        return F.floor(a / F.lit(b)).cast("int")

    golden = F.pmod(year, F.lit(19)) + 1
    century = quotient(year, 100) + 1
    leap_days = quotient(3 * century, 4) - 12
    lunar_cycle = quotient(8 * century + 5, 25) - 5
    sunday = quotient(5 * year, 4) - leap_days - 10
    epact = F.pmod(11 * golden + 20 + lunar_cycle - leap_days, F.lit(30))
    epact = F.when((epact == 24) | ((epact == 25) & (golden > 11)), epact + 1).otherwise(epact)
    moon = F.when(epact > 23, 74 - epact).otherwise(44 - epact)          # days from the last of February
    return F.date_add(F.make_date(year, F.lit(3), F.lit(1)), moon + 6 - F.pmod(sunday + moon, F.lit(7)))


def movable_feast(day: Column, feasts=MOVABLE_FEASTS) -> Column:
    """Name of the movable feast of a day, null on other days."""
    gap = F.datediff(day, easter(F.year(day)))
    return F.coalesce(*[F.when(gap == days, F.lit(name)) for name, days in feasts.items()])


def holiday_table(spark, month_days=FIXED_HOLIDAYS) -> DataFrame:
    """W5 input: a tiny (month, day_of_month) table; data, not a library."""
    return spark.createDataFrame(month_days, "h_month int, h_dom int")


def add_calendar(panel: DataFrame, day: str = "day", holidays: DataFrame | None = None,
                 extended: bool = False) -> DataFrame:
    """day_of_week (Mon=0), is_weekend, month, is_holiday; with
    ``extended`` also ISO week, quarter, day of month. The holiday flag is a
    join against a broadcast table of bounded size (one row per holiday)."""
    d = F.col(day)
    cols = [F.weekday(d).alias("day_of_week"),
            F.weekday(d).isin(5, 6).cast("int").alias("is_weekend"),
            F.month(d).alias("month")]
    if extended:
        cols += [F.weekofyear(d).alias("week_of_year"), F.quarter(d).alias("quarter"),
                 F.dayofmonth(d).alias("day_of_month")]
    out = panel.select("*", *cols)
    if holidays is None:
        return out.withColumn("is_holiday", F.lit(0))
    h = F.broadcast(holidays.select("h_month", "h_dom").distinct()
                    .withColumn("_hol", F.lit(1)))
    return (out.join(h, (F.month(d) == h.h_month) & (F.dayofmonth(d) == h.h_dom), "left")
            .withColumn("is_holiday", F.coalesce(F.col("_hol"), F.lit(0)))
            .drop("h_month", "h_dom", "_hol"))


def add_ratio(df: DataFrame, num: str, den: str, out: str) -> DataFrame:
    """Num / den with a zero denominator mapped to NULL (ANSI-safe)."""
    return df.withColumn(out, F.col(num) / F.nullif(F.col(den), F.lit(0.0)))


def attach_series_stats(panel: DataFrame, stats: DataFrame, key: str,
                        count_col: str = "lt_n") -> DataFrame:
    """Left join per-series stats; missing count -> 0. ``stats`` has one
    row per key and is co-partitioned with the panel on ``key``."""
    return (panel.join(stats, key, "left")
            .withColumn(count_col, F.coalesce(F.col(count_col), F.lit(0)).cast("int")))


def build_features(lines: DataFrame, origin, key: str, ts: str, price: str, freight: str,
                   lt_cols: dict, holidays: DataFrame | None = None,
                   lags=(1, 7, 14, 28), windows=(7, 28)) -> DataFrame:
    """Whole daily feature panel at ``origin``: A1 + A2 (one pass over the
    lines) -> P2 -> W1/W2 -> W4/W5 -> W9 -> J3. Every input is truncated at
    the origin, so rows after it cannot change any output (D9). Catalyst plans
    the line aggregate once for each of its two readers; jobs at scale write it
    first and use ``features_from``."""
    act, hist = activity_and_lead_times(lines, origin, key, ts, price, freight, **lt_cols)
    return features_from(act, hist, origin, key, holidays, lags, windows)


def features_from(act: DataFrame, hist: DataFrame, origin, key: str, holidays: DataFrame | None = None,
                  lags=(1, 7, 14, 28), windows=(7, 28)) -> DataFrame:
    """``build_features`` from the activity and the lead-time histogram."""
    panel = densify(act, origin, key)
    panel = add_lags(panel, key, "day", "n_items", lags)
    panel = add_rolling(panel, key, "day", "n_items", windows)
    panel = add_calendar(panel, "day", holidays)
    panel = add_ratio(panel, "avg_price", "avg_freight", "price_over_freight_ratio")
    return attach_series_stats(panel, lead_time_stats_from_hist(hist, key), key)


def daily_totals(panel: DataFrame, day: str, y: str) -> DataFrame:
    return panel.groupBy(day).agg(F.sum(y).alias("total"))


def trailing_median(daily: DataFrame, day: str, value: str, window: int = 90,
                    min_periods: int = 30, out: str = "trail_median") -> DataFrame:
    """Median of the last ``window`` rows (current included) once at least
    ``min_periods`` exist. Unpartitioned on purpose: the input has one row
    per calendar day, so its size is bounded by the calendar, not the data."""
    fr = Window.orderBy(day).rowsBetween(-(window - 1), 0)
    med = F.percentile(F.col(value), F.lit(0.5)).over(fr)
    return daily.withColumn(out, F.when(F.count(value).over(fr) >= min_periods, med))


def activity_totals(activity: DataFrame, origin, day: str = "day", y: str = "n_items") -> DataFrame:
    """``daily_totals`` of the panel that ``densify`` would make, from the
    activity: one row per day of the calendar."""
    daily = activity.groupBy(day).agg(F.sum(y).alias("total")).withColumn("_all", F.lit(0))
    return densify(daily, origin, "_all", day, "total", carry=()).drop("_all")


def activity_cutoff(panel: DataFrame, day: str = "day", y: str = "n_items", frac: float = 0.2,
                    window: int = 90, min_periods: int = 30) -> DataFrame:
    """Last day whose total volume is >= frac x trailing median (one row)."""
    return cutoff_of_totals(daily_totals(panel, day, y), day, frac, window, min_periods)


def cutoff_of_totals(totals: DataFrame, day: str = "day", frac: float = 0.2, window: int = 90, min_periods: int = 30) -> DataFrame:
    t = trailing_median(totals, day, "total", window, min_periods)
    thr = F.coalesce(F.lit(frac) * F.col("trail_median"), F.lit(0.0))
    return t.filter(F.col("total") >= thr).agg(F.max(day).alias("cutoff"))


def truncate_dead_zone(panel: DataFrame, day: str = "day", y: str = "n_items",
                       frac: float = 0.2, window: int = 90, min_periods: int = 30) -> DataFrame:
    """drop the dead zone after the last day with real volume. The cutoff
    is a one-row result joined back by broadcast (a scalar filter)."""
    cut = F.broadcast(activity_cutoff(panel, day, y, frac, window, min_periods))
    return panel.join(cut, F.col(day) <= F.col("cutoff"), "inner").drop("cutoff")


def future_rows(panel: DataFrame, day: str, origin) -> DataFrame:
    """F2 post-condition as a row: number of rows after the origin (must be 0)."""
    return panel.agg(F.count_if(F.col(day) > _d(origin)).alias("rows_after_origin"))


def line_aggregates(lines: DataFrame, origin, key: str, ts: str, price: str, freight: str,
                    status: str, delivered_value: str, purchase: str, approved: str,
                    carrier: str, delivered: str, day: str = "day") -> DataFrame:
    """A1 and A2 inputs from ONE pass over the joined lines: a grouping-sets
    aggregate over (key, day) -- the daily activity -- and (key, lead-time
    value) -- a lead-time histogram. Spark expands each row into both sets
    and aggregates them in one shuffle. Written once, the large line/order
    join runs once for both. Split with ``activity_from`` / ``histogram_from``."""
    end = origin_end(origin)
    known = F.col(ts) < end
    lt_ok = ((F.col(status) == delivered_value) & (F.col(purchase) < end) & (F.col(delivered) < end)
             & valid_sequence(purchase, approved, carrier, delivered))
    src = lines.filter(known | lt_ok).select(
        F.col(key), F.when(known, F.to_date(F.col(ts))).alias(day), known.alias("_known"),
        F.col(price).alias("_price"), F.col(freight).alias("_freight"),
        F.when(lt_ok, lead_time_days(purchase, delivered)).alias("lt_days"))
    g = (src.groupingSets([[key, day], [key, "lt_days"]], key, day, "lt_days")
         .agg(F.count_if("_known").alias("_n"),
              F.avg(F.when(F.col("_known"), F.col("_price"))).alias("avg_price"),
              F.avg(F.when(F.col("_known"), F.col("_freight"))).alias("avg_freight"),
              F.count("lt_days").alias("lt_count"), F.grouping_id().alias("_gid")))
    return g


# grouping_id bits over (key, day, lt_days): 1 = lt_days rolled up, 2 = day rolled up
def activity_from(g: DataFrame, key: str, day: str = "day") -> DataFrame:
    return (g.filter((F.col("_gid") == 1) & F.col(day).isNotNull() & (F.col("_n") > 0))
            .select(key, day, F.col("_n").cast("double").alias("n_items"), "avg_price", "avg_freight"))


def histogram_from(g: DataFrame, key: str) -> DataFrame:
    return (g.filter((F.col("_gid") == 2) & F.col("lt_days").isNotNull())
            .select(key, "lt_days", "lt_count"))


def activity_and_lead_times(lines: DataFrame, origin, key: str, ts: str, price: str, freight: str,
                            day: str = "day", **lt_cols):
    """``(activity, lead_time_histogram)`` from one line aggregate."""
    g = line_aggregates(lines, origin, key, ts, price, freight, day=day, **lt_cols)
    return activity_from(g, key, day), histogram_from(g, key)


def lead_time_stats_from_hist(hist: DataFrame, key: str) -> DataFrame:
    """A2 from a (key, value, count) histogram: frequency-weighted mean,
    sample std, exact p50/p90 (``percentile`` with a frequency column) and n."""
    c, v = F.col("lt_count"), F.col("lt_days")
    n = F.sum(c)
    s1 = F.sum(c * v)
    s2 = F.sum(c * v * v)
    var = F.greatest(F.lit(0.0), (s2 - s1 * s1 / n) / (n - 1))
    return hist.groupBy(key).agg(
        (s1 / n).alias("lt_mean"), F.when(n > 1, F.sqrt(var)).alias("lt_std"),
        F.percentile(v, F.lit(0.5), c).alias("lt_p50"), F.percentile(v, F.lit(0.9), c).alias("lt_p90"),
        n.alias("lt_n"))
