"""Weekly backtest, part features and next-period forecast of the parts track
(F6, W10, M1-M6, E10, P1, J2, C8, W4, W7, W13).

Roles of the stock columns of a part's week: on hand = quantity shipped on
closed lines, backorder = quantity of lines shipped more than 30 days after
the order, blocked = returned quantity. The next week's features see them one
week late only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as FC
from ..operators import panel as P
from ..operators import parts as PT
from ..session import materialize
from .q_backtest import METRICS_SQL, POINT_SQL, QM_SQL, QR_SQL
from .q_parts import SITE, W_CTES, WEEK_ORIGIN, named, parts_master, weekly_extract
from .registry import cte, query

KEY = "part_id"
STEP, SEASON, WINDOW = 7, 4, 4
SLOT_START = "2000-01-03"       # a Monday; a week's slot is its place in a season of four weeks


def slot():
    weeks = F.floor(F.datediff(F.col("week"), F.to_date(F.lit(SLOT_START))) / STEP)
    return F.pmod(weeks, F.lit(SEASON))


def activity(t):
    """The weeks in which a part was shipped: all other weeks up to the origin have no demand."""
    return t.memo("weekly_activity", lambda: materialize(
        weekly_extract(t).select(KEY, "week", "consumption_qty"), "weekly_activity"))


def _span(t):
    first = F.min("week")
    return activity(t).agg(first.alias("_first"), F.when(first.isNotNull(), F.to_date(F.lit(WEEK_ORIGIN))).alias("_last"))


def folds(t):
    return t.memo("weekly_folds", lambda: materialize(FC.folds_of_span(_span(t), FC.WEEKLY_FOLDS, STEP), "weekly_folds"))


def _predict(p, fold_df):
    return FC.backtest_predictions(p, fold_df, KEY, "week", "consumption_qty", season=SEASON, window=WINDOW,
                                   step_days=STEP, slot=slot(), cycle=SEASON)


def predictions(t):
    return t.memo("weekly_preds", lambda: materialize(_predict(activity(t), folds(t)), "weekly_preds"))


# ---------------------------------------------------------------- SQL pieces
SLOT_SQL = f"(((datediff('day', DATE '{SLOT_START}', week) // 7) % 4 + 4) % 4)"
WB_SQL = """
SELECT series_id, week, consumption_qty AS y,
  lag(consumption_qty, 4) OVER (PARTITION BY series_id ORDER BY week) AS lag_4 FROM wdense"""
WFOLDS_SQL = f"""
SELECT f.fold, CAST(m.w1 - 7 * f.a AS DATE) AS train_end, CAST(m.w1 - 7 * f.b AS DATE) AS test_start,
  CAST(m.w1 - 7 * f.c AS DATE) AS test_end, m.w0 AS calendar_start
FROM (VALUES {', '.join(map(str, FC.WEEKLY_FOLDS))}) f(fold, a, b, c),
  (SELECT max(week) AS w1, min(week) AS w0 FROM wb) m"""
WTEST_SQL = f"""
SELECT f.fold, p.series_id, p.week, datediff('day', f.train_end, p.week) // 7 AS horizon, p.y AS actual, f.train_end,
  {SLOT_SQL} AS slot
FROM wb p JOIN wfolds f ON p.week BETWEEN f.test_start AND f.test_end"""
WBASE_SQL = """
SELECT t.*, coalesce(n.y, 0.0) AS pred_naive, coalesce(s.y, 0.0) AS pred_snaive, coalesce(m.pred_ma, 0.0) AS pred_ma
FROM wtest t
LEFT JOIN wb n ON n.series_id = t.series_id AND n.week = t.train_end
LEFT JOIN wb s ON s.series_id = t.series_id AND s.week = t.train_end - CAST(7 * (((-t.horizon) % 4 + 4) % 4) AS INTEGER)
LEFT JOIN (SELECT f.fold, p.series_id, sum(p.y) / 4.0 AS pred_ma FROM wb p
           JOIN wfolds f ON p.week BETWEEN f.train_end - 21 AND f.train_end GROUP BY ALL) m
  ON m.fold = t.fold AND m.series_id = t.series_id"""
WTR_SQL = f"SELECT f.fold, p.series_id, {SLOT_SQL} AS slot, p.y FROM wb p JOIN wfolds f ON p.week <= f.train_end"
WQ_SQL = """
SELECT t.*, CASE WHEN coalesce(a.n, 0) >= 3 THEN a.q WHEN coalesce(b.n, 0) >= 3 THEN b.q ELSE g.q END AS q
FROM wbase t
LEFT JOIN (SELECT fold, series_id, slot, count(*) AS n, quantile_cont(y, [0.1, 0.5, 0.9]) AS q FROM wtr GROUP BY ALL) a
  ON a.fold = t.fold AND a.series_id = t.series_id AND a.slot = t.slot
LEFT JOIN (SELECT fold, series_id, count(*) AS n, quantile_cont(y, [0.1, 0.5, 0.9]) AS q FROM wtr GROUP BY ALL) b
  ON b.fold = t.fold AND b.series_id = t.series_id
LEFT JOIN (SELECT fold, quantile_cont(y, [0.1, 0.5, 0.9]) AS q FROM wtr GROUP BY fold) g ON g.fold = t.fold"""
WPREDS_SQL = QR_SQL.replace("seller_id, day, horizon", "series_id AS seller_id, week, pred_naive, pred_snaive, pred_ma, horizon")
WACTIVE_SQL = """
SELECT f.fold, p.series_id AS seller_id FROM wb p JOIN wfolds f ON p.week <= f.train_end
GROUP BY f.fold, p.series_id, f.train_end, f.calendar_start
HAVING sum(p.y) / (datediff('day', f.calendar_start, f.train_end) / 7.0 + 1) >= 0.10"""
WSCALE_SQL = """
SELECT f.fold, avg(abs(p.y - p.lag_4)) AS mase_scale FROM wb p JOIN wfolds f ON p.week <= f.train_end GROUP BY f.fold"""
BT_CTES = dict(**{k: W_CTES[k] for k in ("ext", "wgrid", "wdense")}, wb=WB_SQL, wfolds=WFOLDS_SQL)
PRED_CTES = dict(BT_CTES, wtest=WTEST_SQL, wbase=WBASE_SQL, wtr=WTR_SQL, qraw=WQ_SQL, preds=WPREDS_SQL)


@query("F6_weekly_folds", "fold:s train_end:d test_start:d test_end:d calendar_start:d",
       cte(**BT_CTES) + "\nSELECT * FROM wfolds", ops=("F6",))
def q_folds(t):
    return folds(t)


@query("M4_weekly_forecast", "fold:s series_id:s week:d horizon:i actual:f pred_naive:f pred_snaive:f pred_ma:f "
       "pred_p10:f pred_p50:f pred_p90:f crossing:i",
       cte(**PRED_CTES) + "\nSELECT * RENAME (seller_id AS series_id) FROM preds",
       ops=("M1", "M2", "M3", "M4", "M5", "M6", "W10", "F6"))
def q_predictions(t):
    return named(predictions(t))


@query("E10_weekly_metrics", "fold:s model:s metric:s value:f",
       cte(**PRED_CTES, active=WACTIVE_SQL, scale=WSCALE_SQL, pm=POINT_SQL, qm=QM_SQL) + METRICS_SQL,
       ops=("E1", "E2", "E3", "E4", "E5", "E6", "E7", "E8", "E9", "E10"))
def q_metrics(t):
    scales, active = FC.training_stats(activity(t), folds(t), KEY, "week", "consumption_qty", SEASON, step_days=STEP)
    return FC.backtest_metrics(predictions(t), scales, active, KEY)


# ------------------------------------------- features with the part master
def part_master(t):
    """Part attributes with integer codes of the categories."""
    p = parts_master(t).join(t["part"].select(F.col("p_partkey").alias(KEY), F.col("p_type").alias("part_type")), KEY)
    p = p.withColumn("is_repairable", PT.flag01("is_repairable"))
    for c in ("part_family", "part_type", "supplier_risk_class"):
        p = PT.category_codes(p, c, f"{c}_enc")
    return p.select(KEY, "unit_cost", "is_repairable", "part_family_enc", "part_type_enc", "supplier_risk_class_enc")


def stock_columns(t):
    """Weekly stock quantities per part, from the lines shipped in the week."""
    li, o = t["lineitem"], t["orders"]
    end = F.date_add(F.to_date(F.lit(WEEK_ORIGIN)), 7)
    j = li.where(F.col("l_shipdate") < end).join(o, li.l_orderkey == o.o_orderkey)
    late = F.datediff("l_shipdate", "o_orderdate") > 30
    qty = lambda c: F.sum(F.when(c, F.col("l_quantity")).otherwise(0.0))
    return j.groupBy(F.col("l_partkey").alias(KEY), F.to_date(F.date_trunc("week", "l_shipdate")).alias("week")).agg(
        F.sum("l_quantity").alias("consumption_qty"),
        qty(F.col("l_linestatus") == "F").alias("on_hand_qty"), qty(late).alias("backorder_qty"),
        qty(F.col("l_returnflag") == "R").alias("blocked_qty"),
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("planned_maintenance"))


STOCK = ("on_hand_qty", "backorder_qty", "blocked_qty")


def part_features(t):
    d = P.densify(stock_columns(t), WEEK_ORIGIN, KEY, day="week", y="consumption_qty",
                  carry=(*STOCK, "planned_maintenance"), carry_lags=STOCK, **PT.WEEKLY)
    d = d.fillna(0.0, subset=list(STOCK)).fillna(0, subset=["planned_maintenance"])
    f = PT.weekly_features(d, KEY, "week", "consumption_qty", lag_domain=STOCK)
    f = f.withColumns({"day_of_month": F.dayofmonth("week"), "day_of_week": F.weekday("week")})
    return named(f.join(part_master(t), KEY))


STOCK_SQL = f"""
SELECT '{SITE}_' || CAST(l_partkey AS VARCHAR) AS series_id, l_partkey AS part_id,
  CAST(date_trunc('week', l_shipdate) AS DATE) AS week, sum(l_quantity) AS consumption_qty,
  sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0.0 END) AS on_hand_qty,
  sum(CASE WHEN datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) > 30 THEN l_quantity ELSE 0.0 END) AS backorder_qty,
  sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0 END) AS blocked_qty,
  max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS planned_maintenance
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_shipdate < DATE '{WEEK_ORIGIN}' + INTERVAL 7 DAY GROUP BY ALL"""
PDENSE_SQL = """
SELECT g.series_id, g.week, coalesce(e.consumption_qty, 0.0) AS consumption_qty, coalesce(e.on_hand_qty, 0.0) AS on_hand_qty,
  coalesce(e.backorder_qty, 0.0) AS backorder_qty, coalesce(e.blocked_qty, 0.0) AS blocked_qty,
  coalesce(e.planned_maintenance, 0) AS planned_maintenance
FROM wgrid g LEFT JOIN ext e ON e.series_id = g.series_id AND e.week = g.week"""
PMASTER_SQL = """
SELECT p_partkey AS part_id, p_retailprice AS unit_cost, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS is_repairable,
  dense_rank() OVER (ORDER BY p_brand) - 1 AS part_family_enc, dense_rank() OVER (ORDER BY p_type) - 1 AS part_type_enc,
  dense_rank() OVER (ORDER BY CASE WHEN p_size <= 16 THEN 'Low' WHEN p_size <= 33 THEN 'Medium' ELSE 'High' END) - 1
    AS supplier_risk_class_enc
FROM part"""


def _part_sql():
    def roll(k):
        fr = f"(PARTITION BY series_id ORDER BY week ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
        return (f"avg(consumption_qty) OVER {fr} AS roll_mean_{k}, "
                f"coalesce(stddev_samp(consumption_qty) OVER {fr}, 0.0) AS roll_std_{k}")
    lags = ", ".join(f"lag(consumption_qty, {k}) OVER w AS lag_{k}" for k in (1, 2, 4, 8, 12))
    stock = ", ".join(f"lag({c}, 1) OVER w AS {c}_lag1" for c in STOCK)
    ctes = dict(ext=STOCK_SQL, wgrid=W_CTES["wgrid"], pd=PDENSE_SQL, pm=PMASTER_SQL, pf=f"""
SELECT d.*, {lags}, {roll(4)}, {roll(8)}, {roll(12)}, {stock}, weekofyear(week) AS week_of_year, month(week) AS month,
  quarter(week) AS quarter, day(week) AS day_of_month, isodow(week) - 1 AS day_of_week
FROM pd d WINDOW w AS (PARTITION BY series_id ORDER BY week)""")
    return cte(**ctes) + "\nSELECT * FROM pf JOIN pm ON pf.series_id = '" + SITE + "_' || CAST(pm.part_id AS VARCHAR)"


PART_SPEC = ("series_id:s week:d consumption_qty:f planned_maintenance:i lag_1:f lag_2:f lag_4:f lag_8:f lag_12:f "
             "roll_mean_4:f roll_std_4:f roll_mean_8:f roll_std_8:f roll_mean_12:f roll_std_12:f on_hand_qty_lag1:f "
             "backorder_qty_lag1:f blocked_qty_lag1:f month:i week_of_year:i quarter:i day_of_month:i day_of_week:i "
             "unit_cost:f is_repairable:i part_family_enc:i part_type_enc:i supplier_risk_class_enc:i")


@query("P1_part_features", PART_SPEC, _part_sql(), ops=("P1", "J2", "C8", "W3", "W4", "W7"))
def q_part_features(t):
    return part_features(t)


# ------------------------------------------------- next-period forecast
NEXT_SPEC = "series_id:s week:d horizon:i p10:f p50:f p90:f"


@query("W13_next_period_forecast", NEXT_SPEC, cte(**{k: BT_CTES[k] for k in ("ext", "wgrid", "wdense")}, fut=f"""
SELECT DISTINCT series_id, DATE '{WEEK_ORIGIN}' + CAST(7 * h AS INTEGER) AS week, h AS horizon
FROM wdense, (VALUES (1), (2)) x(h)""", s=f"SELECT *, {SLOT_SQL} AS slot FROM wdense") + f"""
SELECT f.series_id, f.week, f.horizon, q[1] AS p10, q[2] AS p50, q[3] AS p90 FROM (
  SELECT f.series_id, f.week, f.horizon,
    CASE WHEN coalesce(a.n, 0) >= 3 THEN a.q WHEN coalesce(b.n, 0) >= 3 THEN b.q ELSE g.q END AS q
  FROM (SELECT *, {SLOT_SQL} AS slot FROM fut) f
  LEFT JOIN (SELECT series_id, slot, count(*) AS n, quantile_cont(consumption_qty, [0.1, 0.5, 0.9]) AS q FROM s GROUP BY ALL) a
    ON a.series_id = f.series_id AND a.slot = f.slot
  LEFT JOIN (SELECT series_id, count(*) AS n, quantile_cont(consumption_qty, [0.1, 0.5, 0.9]) AS q FROM s GROUP BY ALL) b
    ON b.series_id = f.series_id,
  (SELECT quantile_cont(consumption_qty, [0.1, 0.5, 0.9]) AS q FROM s) g) f""", ops=("W13", "M4", "M6"))
def q_next_forecast(t):
    """P10, P50 and P90 of the two weeks after the origin: the weekly model
    trained on everything up to the origin."""
    # Its two test weeks, after the last, are laid out by the fold.
    fold = FC.folds_of_span(_span(t), [("next", 0, -1, -2)], STEP)
    out = _predict(activity(t), fold)
    return named(out).select("series_id", "week", "horizon", *[F.col(f"pred_{q}").alias(q) for q in ("p10", "p50", "p90")])
