"""Weekly parts track and vendor reporting (P1, W3, W7, W8, W12, W13, C8,
A7, A8, J4, J9, O5, V12, V13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import running


def flag01(c) -> Column:
    """Yes/Y/true -> 1, anything else -> 0 (strings or booleans, Q10)."""
    s = F.lower(F.col(c).cast("string"))
    return F.when(s.isin("yes", "y", "true", "1"), F.lit(1)).otherwise(F.lit(0))


def series_key(*cols) -> Column:
    """``site_part`` series key from column names or Columns."""
    return F.concat_ws("_", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])


def category_codes(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Sorted distinct values -> 0..k-1, NULL -> -1. The dictionary has
    one row per distinct value; it is joined back without a hint so AQE
    broadcasts it only when its measured size is small (sort-merge beyond).
    The code assignment ranks the distinct values over range
    partitions, one row per category, never in one task."""
    out = out or f"{col}_code"
    d = df.select(col).distinct().filter(F.col(col).isNotNull())
    codes = running(d, [F.asc(col)], rank="_rank").select(col, (F.col("_rank") - 1).cast("int").alias(out))
    return (df.join(codes, col, "left")
            .withColumn(out, F.coalesce(F.col(out), F.lit(-1))))


#: Arguments of ``densify`` for the features of a weekly panel.
WEEKLY = dict(lags=(1, 2, 4, 8, 12), windows=(4, 8, 12), min_mean=1, min_std=2, fill_std=0.0, step_days=7)


def weekly_features(panel: DataFrame, key: str, week: str, y: str, lags=(1, 2, 4, 8, 12),
                    windows=(4, 8, 12), lag_domain=()) -> DataFrame:
    """W1/W3/W4/W7 on the weekly panel: lags, rolling mean (min 1) and std
    (min 2, NULL -> 0) of previous weeks, calendar, lagged domain columns.
    One partitioning by ``key`` serves every window. A panel that
    ``densify`` made with ``WEEKLY`` has all but the calendar: its dense rows
    are not sorted again."""
    from .panel import add_rolling
    w = Window.partitionBy(key).orderBy(week)
    d = F.col(week)
    calendar = [F.weekofyear(d).alias("week_of_year"), F.month(d).alias("month"), F.quarter(d).alias("quarter")]
    names = [f"lag_{k}" for k in lags] + [f"roll_{s}_{k}" for k in windows for s in ("mean", "std")] + [f"{c}_lag1" for c in lag_domain]
    if set(names) <= set(panel.columns):
        return panel.select("*", *calendar)
    cols = [F.lag(y, k).over(w).alias(f"lag_{k}") for k in lags]
    cols += [F.lag(c, 1).over(w).alias(f"{c}_lag1") for c in lag_domain]
    rolled = add_rolling(panel, key, week, y, windows, min_mean=1, min_std=2, fill_std=0.0)
    return rolled.select("*", *cols, *calendar)


def extend_future(panel: DataFrame, key: str, week: str, y: str, steps=(7, 14),
                  keep=()) -> DataFrame:
    """Append next-period rows (+7, +14 days) after each series' last
    row with unknown target, so features for them are computed by the same
    window pass as history (every lag and rolling stat is current, Q6)."""
    last = panel.groupBy(key).agg(F.max(week).alias("_last"))
    fut = last.select(key, F.explode(F.array(*[F.date_add("_last", s) for s in steps])).alias(week))
    for c in panel.columns:
        if c not in (key, week):
            fut = fut.withColumn(c, F.lit(None).cast(panel.schema[c].dataType))
    return (panel.withColumn("is_future", F.lit(0))
            .unionByName(fut.select(*panel.columns).withColumn("is_future", F.lit(1))))


def latest_row(df: DataFrame, key: str, order: str) -> DataFrame:
    """Last row per series; ``order`` is unique within a series."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def vendor_scorecard(pos: DataFrame, parts: DataFrame) -> DataFrame:
    """A7 for all (part, supplier) at once: orders, qty, mean lead days,
    on-time %, mean delay vs promise, max unit cost, max risk class."""
    j = pos.join(parts.select("part_id", "supplier_risk_class"), "part_id", "left")
    return (j.groupBy("part_id", "supplier_id")
            .agg(F.count(F.lit(1)).alias("n_orders"), F.sum("ordered_qty").alias("total_qty"),
                 F.avg(F.datediff("receipt_date", "order_date")).alias("avg_lead_days"),
                 (F.lit(100.0) * F.count_if(F.col("receipt_date") <= F.col("promised_date"))
                  / F.count(F.lit(1))).alias("on_time_pct"),
                 F.avg(F.datediff("receipt_date", "promised_date")).alias("avg_delay_days"),
                 F.max("unit_cost").alias("max_unit_cost"),
                 F.max("supplier_risk_class").alias("risk_class")))


def incident_stats(incidents: DataFrame, keys=("part_id", "supplier_id")) -> DataFrame:
    """Incident count and scrap per key."""
    return incidents.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_incidents"),
                                        F.sum("scrap_qty").alias("scrap_qty"))


def scorecard_with_quality(card: DataFrame, inc: DataFrame, keys=("part_id", "supplier_id")) -> DataFrame:
    """J4 + A8: left join of two pre-aggregated sides (no fan-out); missing
    incidents -> 0; defect % = scrap / qty x 100 (0 when undefined)."""
    j = card.join(inc, list(keys), "left")
    return (j.withColumn("n_incidents", F.coalesce("n_incidents", F.lit(0)))
            .withColumn("scrap_qty", F.coalesce("scrap_qty", F.lit(0.0)))
            .withColumn("defect_pct", F.coalesce(F.try_divide(F.col("scrap_qty") * 100.0,
                                                              F.col("total_qty")), F.lit(0.0))))


def latest_n(df: DataFrame, keys, order: Column, tie: Column, n: int, salt_col: str,
             salts: int = 16) -> DataFrame:
    """Newest ``n`` rows per key group for all groups at once, exact and
    skew-safe. Phase 1 ranks inside (group, salt) sub-groups, salt = hash of
    ``salt_col`` (default: the tie column) mod ``salts``, keeping each
    sub-group's top n; phase 2 ranks the at most n x salts survivors per
    group. ``salt_col`` should be a row id (unique within the group). A group holding a third of all rows is thus sorted by ``salts``
    tasks, never one."""
    keys = list(keys)
    salt = F.pmod(F.xxhash64(F.col(salt_col)), F.lit(salts))
    w1 = Window.partitionBy(*keys, "_salt").orderBy(order, tie)
    part = (df.withColumn("_salt", salt).withColumn("_rn", F.row_number().over(w1))
            .filter(F.col("_rn") <= n).drop("_rn", "_salt"))
    w2 = Window.partitionBy(*keys).orderBy(order, tie)
    return part.withColumn("_rn", F.row_number().over(w2)).filter(F.col("_rn") <= n).drop("_rn")


def planner(df: DataFrame, risk: str, p50: str, p90: str, on_hand: str | None = None,
            threshold: float = 0.5, moq=0.0, pack=1.0, cap=None) -> DataFrame:
    """Keep risk > threshold, order up to P90 from on-hand (default 0)
    under the quantity rules of V3 (whole packs, least order, cap; qty_flags
    names those that applied), drop non-positive quantities."""
    from .inventory import order_quantity
    oh = F.coalesce(F.col(on_hand), F.lit(0.0)) if on_hand else F.lit(0.0)
    planned = order_quantity(df.filter(F.col(risk) > threshold), p90, oh, moq, pack, cap)
    return planned.withColumnRenamed("final_qty", "recommended_qty").filter(F.col("recommended_qty") > 0)
