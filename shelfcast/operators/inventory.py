"""Inventory operators over tables.

Every series is planned and replayed at once; nothing loops on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import inventory as I


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(x))


def order_quantity(df: DataFrame, order_up_to, position, moq=0.0, pack=1.0, cap=None,
                   pack_mode: str = "nearest") -> DataFrame:
    """V3: raw = max(0, S - IP); pack rounding (half-even to the nearest pack,
    only when pack > 1; ``pack_mode='up'`` rounds up instead, Q17); MOQ bump
    when 0 < q < MOQ (flag); budget cap (flag) wins over MOQ; both rounded to
    2 decimals half-even. Adds raw_qty, final_qty, qty_flags."""
    S, ip, moq_c, pack_c = _c(order_up_to), _c(position), _c(moq), _c(pack)
    raw = F.greatest(F.lit(0.0), S - ip)
    rounded = (F.ceil(raw / pack_c) if pack_mode == "up" else F.bround(raw / pack_c, 0))
    q1 = F.when(pack_c > 1, pack_c * rounded.cast("double")).otherwise(raw)
    below = (q1 > 0) & (q1 < moq_c)
    q2 = F.when(below, moq_c).otherwise(q1)
    if cap is None:
        over, q3 = F.lit(False), q2
    else:
        cap_c = _c(cap)
        over = cap_c.isNotNull() & (q2 > cap_c)
        q3 = F.when(over, cap_c).otherwise(q2)
    flags = F.filter(F.array(F.when(below, F.lit("below_moq_rounded_up")),
                             F.when(over, F.lit("exceeds_budget_cap"))), lambda x: x.isNotNull())
    return df.select("*", F.bround(raw, 2).alias("raw_qty"), F.bround(q3, 2).alias("final_qty"),
                     flags.alias("qty_flags"))


#: Width of the range frame in which a window of P rows is P steps of ceil(_FRAME / P).
_FRAME = 1 << 40


def rolling_window_totals(panel: DataFrame, params: DataFrame, key: str, day: str, y: str,
                          until: Column | None = None) -> DataFrame:
    """Sum of ``y`` over each full window of ``protection_days`` consecutive
    days per series (V4 input). Per-series window lengths vary, so the sums
    are prefix-sum differences ``cum(t) - cum(t - P)``. The earlier prefix is
    the last one at least P rows back: rows are spaced so that P steps fill one
    range frame of a fixed width. Any window length, one shuffle by ``key``."""
    w = Window.partitionBy(key).orderBy(day)
    p = panel.select(key, day, y)
    if until is not None:
        p = p.filter(until)
    p = p.join(params.select(key, "protection_days"), key, "inner")
    cum = F.sum(y).over(w.rowsBetween(Window.unboundedPreceding, 0))
    staged = p.select(key, day, "protection_days", cum.alias("_cum"), F.row_number().over(w).alias("_rn"))
    days = F.col("protection_days").cast("long")
    staged = staged.filter(days > 0).withColumn("_at", F.col("_rn") * F.floor((F.lit(_FRAME) + days - 1) / days))
    back = Window.partitionBy(key).orderBy("_at").rangeBetween(Window.unboundedPreceding, -_FRAME)
    return (staged.withColumn("_prev", F.last("_cum").over(back)).filter(F.col("_rn") >= F.col("protection_days"))
            .select(key, day, "protection_days", (F.col("_cum") - F.coalesce("_prev", F.lit(0.0))).alias("total")))


def window_total_counts(panel: DataFrame, params: DataFrame, key: str, day: str = "day", y: str = "n_items",
                        until: Column | None = None, last: str | None = None) -> DataFrame:
    """How often each total occurs among the full windows of ``protection_days``
    days of a series (``total``, ``n``). A total changes only where a day with
    demand enters or leaves its window, so only those days (``y`` not 0) are
    shuffled and sorted, and a total counts for the days up to the next
    change. ``panel`` has one row per series and day without gaps, or, with
    ``last`` (a column: the last day of the row's series), only its first day and the days with demand."""
    number = lambda c: (F.unix_date(c) if panel.schema[c].dataType.typeName() == "date" else F.col(c)).cast("long")
    p = panel if until is None else panel.filter(until)
    p = p.select(key, number(day).alias("_at"), F.col(y).cast("double").alias("_y"), number(last or day).alias("_end"))
    span = p.groupBy(key).agg(F.min("_at").alias("_first"), F.max("_end").alias("_last"))
    days = F.col("protection_days").cast("long")
    ends = span.join(params.select(key, "protection_days"), key).select(
        key, "protection_days", days.alias("_days"), (F.col("_first") + days - 1).alias("_begin"), "_last").where(
        "_days > 0 AND _begin <= _last")
    moves = F.array(F.struct(F.greatest("_at", "_begin").alias("_at"), F.col("_y").alias("_d")),
                    F.struct((F.col("_at") + F.col("_days")).alias("_at"), (-F.col("_y")).alias("_d")))
    changes = p.where("_y <> 0").drop("_end").join(ends, key).select(key, "protection_days", "_last", F.inline(moves)).where("_at <= _last")
    start = ends.select(key, "protection_days", "_last", F.col("_begin").alias("_at"), F.lit(0.0).alias("_d"))
    order = Window.partitionBy(key).orderBy("_at")
    until_next = F.coalesce(F.lead("_at").over(order), F.col("_last") + 1) - F.col("_at")
    totals = changes.unionByName(start).select(
        key, "protection_days", F.sum("_d").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("total"), until_next.alias("_n"))
    return totals.where("_n > 0").groupBy(key, "protection_days", "total").agg(F.sum("_n").alias("n"))


def interval_quantiles(panel: DataFrame, params: DataFrame, key: str, day: str = "day",
                       y: str = "n_items", alpha: float | Column = 0.9,
                       until: Column | None = None, approx: bool = False) -> DataFrame:
    """V4 (re-aimed, deterministic): quantiles of demand summed over the
    protection interval L+R, taken from the empirical distribution of every
    full (L+R)-day window in the series' history -- never the sum of daily
    quantiles. ``params`` holds ``protection_days`` per series. ``approx``
    switches to ``percentile_approx`` for continuous, very large groups."""
    if not approx:
        return quantiles_of_counts(window_total_counts(panel, params, key, day, y, until), key, alpha)
    tot = rolling_window_totals(panel, params, key, day, y, until)
    q = F.percentile_approx("total", F.array(F.lit(0.1), F.lit(0.5), _c(alpha)), 10000).cast("array<double>")
    return _interval_columns(tot.groupBy(key, "protection_days").agg(
        q.alias("_q"), F.avg("total").alias("mean_lt"), F.count(F.lit(1)).alias("n_windows")), key)


def quantiles_of_counts(counts: DataFrame, key: str, alpha: float | Column = 0.9) -> DataFrame:
    """``interval_quantiles`` from the counts of window totals."""
    n = F.sum("n")
    q = F.percentile("total", F.array(F.lit(0.1), F.lit(0.5), _c(alpha)), F.col("n"))
    return _interval_columns(counts.groupBy(key, "protection_days").agg(
        q.alias("_q"), (F.sum(F.col("total") * F.col("n")) / n).alias("mean_lt"), n.alias("n_windows")), key)


def _interval_columns(df: DataFrame, key: str) -> DataFrame:
    return (df.select(key, F.col("protection_days").cast("double").alias("protection_days"),
                    F.col("_q")[0].alias("p10_lt"), F.col("_q")[1].alias("p50_lt"),
                    F.col("_q")[2].alias("p_alpha_lt"), "mean_lt", "n_windows"))


_OUT = ("struct<day:int,on_hand_start:double,demand:double,units_sold:double,stockout_units:double,"
        "order_placed:double,on_hand_end:double,holding_cost:double,stockout_cost:double>")


def _fold_expr(rate: float, mult: float) -> str:
    """SQL ``aggregate`` over a series' ordered days: state = (on hand,
    orders placed so far, ledger rows). An order placed on day t arrives on
    day t + L; the pipeline is the orders placed in [t-L+1, t-1]."""
    t = "size(acc.ord)"
    arrival = f"IF({t} - _lead >= 0, acc.ord[{t} - _lead], 0D)"
    start = f"(acc.oh + {arrival})"
    end = f"greatest(0D, {start} - x.demand)"
    lo = f"greatest({t} - _lead + 1, 0)"
    pipe = f"aggregate(slice(acc.ord, {lo} + 1, {t} - {lo}), 0D, (s, v) -> s + v)"
    order = (f"CASE WHEN _policy = 'order_up_to' THEN greatest(0D, _S - ({end} + {pipe})) "
             f"ELSE coalesce(x.fixed, 0D) END")
    row = (f"named_struct('day', {t}, 'on_hand_start', {start}, 'demand', x.demand, "
           f"'units_sold', least({start}, x.demand), "
           f"'stockout_units', greatest(0D, x.demand - {start}), 'order_placed', {order}, "
           f"'on_hand_end', {end}, 'holding_cost', {end} * _unit_cost * ({rate}D / 365D), "
           f"'stockout_cost', greatest(0D, x.demand - {start}) * _unit_margin * {mult}D)")
    return (f"aggregate(_days, named_struct('oh', _on_hand0, 'ord', CAST(array() AS array<double>), "
            f"'out', CAST(array() AS array<{_OUT}>)), "
            f"(acc, x) -> named_struct('oh', {end}, "
            f"'ord', concat(acc.ord, array(greatest(0D, {order}))), "
            f"'out', concat(acc.out, array({row})))).out")


def replay(demand: DataFrame, keys=("series", "arm"), rate: float = I.HOLDING_RATE_ANNUAL,
           mult: float = I.GOODWILL_MULTIPLIER) -> DataFrame:
    """V8 ledger replay for every (series, arm) at once. Input rows:
    ``keys, t (0..n-1), demand, fixed_order, order_up_to, policy ('fixed' |
    'order_up_to'), initial_on_hand, lead_time_days, unit_cost, unit_margin``.
    One group holds one series' planning window (bounded by the horizon,
    never the whole history); the sequential fold runs as a SQL higher-order
    ``aggregate`` inside the JVM."""
    keys = list(keys)
    g = (demand.groupBy(*keys)
         .agg(F.array_sort(F.collect_list(F.struct(F.col("t"), F.col("demand").cast("double").alias("demand"),
                                                    F.col("fixed_order").cast("double").alias("fixed"))))
              .alias("_days"),
              F.first("order_up_to").cast("double").alias("_S"), F.first("policy").alias("_policy"),
              F.first("initial_on_hand").cast("double").alias("_on_hand0"),
              F.first("lead_time_days").cast("int").alias("_lead"),
              F.first("unit_cost").cast("double").alias("_unit_cost"),
              F.first("unit_margin").cast("double").alias("_unit_margin")))
    return (g.select(*keys, F.explode(F.expr(_fold_expr(rate, mult))).alias("r"))
            .select(*keys, "r.*"))


def policy_totals(ledger: DataFrame, by=("arm",)) -> DataFrame:
    """Holding, stockout and total cost, stockout days and mean on-hand."""
    return (ledger.groupBy(*by)
            .agg(F.sum("holding_cost").alias("total_holding_cost"),
                 F.sum("stockout_cost").alias("total_stockout_cost"),
                 (F.sum("holding_cost") + F.sum("stockout_cost")).alias("total_cost"),
                 F.count_if(F.col("stockout_units") > 0).alias("stockout_days"),
                 F.avg("on_hand_end").alias("avg_on_hand")))


def policy_lift(totals: DataFrame, pairs, by=()) -> DataFrame:
    """Challenger vs base arm: net benefit (cost saved), stockout days
    reduced, average inventory change % (0 when the base holds nothing)."""
    by = list(by)
    spark = totals.sparkSession
    pr = spark.createDataFrame(list(pairs), "base string, challenger string")
    b = totals.select(*by, F.col("arm").alias("base"), F.col("total_cost").alias("b_cost"),
                      F.col("stockout_days").alias("b_days"), F.col("avg_on_hand").alias("b_inv"))
    c = totals.select(*by, F.col("arm").alias("challenger"), F.col("total_cost").alias("c_cost"),
                      F.col("stockout_days").alias("c_days"), F.col("avg_on_hand").alias("c_inv"))
    return (F.broadcast(pr).join(b, "base").join(c, by + ["challenger"])
            .select(*by, "base", "challenger",
                    F.bround(F.col("b_cost") - F.col("c_cost"), 2).alias("net_benefit"),
                    (F.col("b_days") - F.col("c_days")).alias("stockout_days_reduced"),
                    F.bround(F.when(F.col("b_inv") != 0,
                                    F.lit(100.0) * (F.col("b_inv") - F.col("c_inv")) / F.col("b_inv"))
                             .otherwise(F.lit(0.0)), 2).alias("avg_inventory_change_pct")))
