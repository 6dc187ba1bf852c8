"""Weekly parts track and vendor jobs over the driver tables.

Roles: part master = ``part`` (risk class by size band), purchase orders =
order lines (promised = order date + 30 days, receipt = ship date),
quality incidents = returned lines (``l_returnflag = 'R'``, scrap = qty),
weekly consumption = shipped quantity per part and ISO week (site GLOBAL).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import panel as P
from ..operators import parts as PT
from ..operators import quality as Q
from ..operators.decisions import ratio_risk
from .registry import cte, query

WEEK_ORIGIN = "2001-06-25"       # Monday of the daily origin's week
SITE = "GLOBAL"


def parts_master(t):
    p = t["part"]
    risk = (F.when(F.col("p_size") <= 16, F.lit("Low")).when(F.col("p_size") <= 33, F.lit("Medium"))
            .otherwise(F.lit("High")))
    return p.select(F.col("p_partkey").alias("part_id"), F.col("p_brand").alias("part_family"),
                    F.col("p_retailprice").alias("unit_cost"), risk.alias("supplier_risk_class"),
                    F.when(F.col("p_size") % 2 == 0, F.lit("Yes")).otherwise(F.lit("No")).alias("is_repairable"))


def purchase_orders(t):
    li, o = t["lineitem"], t["orders"]
    od = F.to_date("o_orderdate")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("po_id"),
                    F.col("l_suppkey").alias("supplier_id"), F.col("l_partkey").alias("part_id"),
                    od.alias("order_date"), F.date_add(od, 30).alias("promised_date"),
                    F.to_date("l_shipdate").alias("receipt_date"), F.col("l_quantity").alias("ordered_qty"),
                    (F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0))).alias("unit_cost")))


def incidents(t):
    li = t["lineitem"]
    return (li.filter(F.col("l_returnflag") == "R")
            .select(F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("supplier_id"),
                    F.to_date("l_shipdate").alias("incident_date"), F.col("l_quantity").alias("scrap_qty")))


def weekly_extract(t):
    """Sparse weekly rows per series up to the weekly origin."""
    li = t["lineitem"].filter(F.col("l_shipdate") < F.date_add(F.to_date(F.lit(WEEK_ORIGIN)), 7))
    wk = F.to_date(F.date_trunc("week", "l_shipdate"))
    g = (li.groupBy(F.col("l_partkey").alias("part_id"), wk.alias("week"))
         .agg(F.sum("l_quantity").alias("consumption_qty"), F.count(F.lit(1)).cast("double").alias("n_lines"),
              F.max(F.coalesce(F.col("l_returnflag") == "R", F.lit(False))).alias("_ret")))
    return g.select(F.lit(SITE).alias("site_id"), "part_id",
                    F.concat_ws("_", F.lit(SITE), F.col("part_id").cast("string")).alias("series_id"),
                    "week", "consumption_qty", "n_lines", PT.flag01("_ret").alias("had_return"))


def weekly_panel(t):
    def build():
        ext = weekly_extract(t).select("part_id", "week", "consumption_qty", "n_lines", "had_return")
        d = P.densify(ext, WEEK_ORIGIN, "part_id", day="week", y="consumption_qty",
                      carry=("n_lines", "had_return"), carry_lags=("n_lines",), **PT.WEEKLY)
        d = d.withColumn("n_lines", F.coalesce("n_lines", F.lit(0.0))).withColumn(
            "had_return", F.coalesce("had_return", F.lit(0)))
        return named(PT.weekly_features(d, "part_id", "week", "consumption_qty", lag_domain=("n_lines",)))
    return t.memo("weekly_panel", build)


def named(df):
    """Adds the series id; windows and joins use the integer part key."""
    return df.withColumn("series_id", PT.series_key(F.lit(SITE), "part_id"))


EXTRACT_SQL = f"""
SELECT '{SITE}' AS site_id, l_partkey AS part_id, '{SITE}_' || CAST(l_partkey AS VARCHAR) AS series_id,
  CAST(date_trunc('week', l_shipdate) AS DATE) AS week, sum(l_quantity) AS consumption_qty,
  CAST(count(*) AS DOUBLE) AS n_lines,
  CASE WHEN max(CASE WHEN l_returnflag = 'R' THEN 'Yes' ELSE 'No' END) IN ('Yes', 'Y') THEN 1 ELSE 0 END AS had_return
FROM lineitem WHERE l_shipdate < DATE '{WEEK_ORIGIN}' + INTERVAL 7 DAY
GROUP BY l_partkey, date_trunc('week', l_shipdate)"""
WGRID_SQL = f"""
SELECT s.series_id, CAST(g.w AS DATE) AS week
FROM (SELECT series_id, min(week) AS w0 FROM ext GROUP BY series_id) s,
     LATERAL generate_series(CAST(s.w0 AS TIMESTAMP), CAST(DATE '{WEEK_ORIGIN}' AS TIMESTAMP), INTERVAL 7 DAY) g(w)"""
WDENSE_SQL = """
SELECT g.series_id, g.week, coalesce(e.consumption_qty, 0.0) AS consumption_qty,
  coalesce(e.n_lines, 0.0) AS n_lines, coalesce(e.had_return, 0) AS had_return
FROM wgrid g LEFT JOIN ext e ON e.series_id = g.series_id AND e.week = g.week"""


def _wroll(k):
    fr = f"(PARTITION BY series_id ORDER BY week ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    return (f"CASE WHEN count(consumption_qty) OVER {fr} >= 1 THEN avg(consumption_qty) OVER {fr} END AS roll_mean_{k}, "
            f"coalesce(CASE WHEN count(consumption_qty) OVER {fr} >= 2 THEN stddev_samp(consumption_qty) OVER {fr} END, 0.0) AS roll_std_{k}")


WFEAT_SQL = f"""
SELECT d.*, {', '.join(f'lag(consumption_qty, {k}) OVER w AS lag_{k}' for k in (1, 2, 4, 8, 12))},
  {_wroll(4)}, {_wroll(8)}, {_wroll(12)},
  lag(n_lines, 1) OVER w AS n_lines_lag1, weekofyear(week) AS week_of_year, month(week) AS month,
  quarter(week) AS quarter
FROM wdense d WINDOW w AS (PARTITION BY series_id ORDER BY week)"""
W_CTES = dict(ext=EXTRACT_SQL, wgrid=WGRID_SQL, wdense=WDENSE_SQL, wfeat=WFEAT_SQL)
WFEAT_SPEC = ("series_id:s week:d consumption_qty:f n_lines:f had_return:i lag_1:f lag_2:f lag_4:f lag_8:f "
              "lag_12:f roll_mean_4:f roll_std_4:f roll_mean_8:f roll_std_8:f roll_mean_12:f roll_std_12:f "
              "n_lines_lag1:f week_of_year:i month:i quarter:i")


@query("P1_weekly_extract", "site_id:s part_id:i series_id:s week:d consumption_qty:f n_lines:f had_return:i",
       EXTRACT_SQL, ops=("P1", "S4", "S5"))
def q_extract(t):
    return weekly_extract(t)


@query("W3_weekly_features", WFEAT_SPEC, cte(**W_CTES) + "\nSELECT * FROM wfeat",
       ops=("W3", "W1", "W4", "W7", "P2"))
def q_weekly(t):
    return weekly_panel(t)


@query("W8_weekly_continuity", "panel:s n_series:i min_date:d max_date:d bad_steps:i",
       cte(**W_CTES) + """
SELECT 'extract' AS panel, count(DISTINCT series_id) AS n_series, min(week) AS min_date, max(week) AS max_date,
  count_if(gap IS NOT NULL AND gap <> 7) AS bad_steps
FROM (SELECT series_id, week, datediff('day', lag(week) OVER (PARTITION BY series_id ORDER BY week), week) AS gap FROM ext)
UNION ALL
SELECT 'dense', count(DISTINCT series_id), min(week), max(week), count_if(gap IS NOT NULL AND gap <> 7)
FROM (SELECT series_id, week, datediff('day', lag(week) OVER (PARTITION BY series_id ORDER BY week), week) AS gap FROM wdense)""",
       ops=("W8", "D6", "A12"))
def q_continuity(t):
    a = Q.continuity(weekly_extract(t), ["part_id"], "week").withColumn("panel", F.lit("extract"))
    b = Q.continuity(weekly_panel(t), ["part_id"], "week").withColumn("panel", F.lit("dense"))
    return a.unionByName(b)


@query("W12_latest_week", WFEAT_SPEC, cte(**W_CTES) + """
SELECT * FROM wfeat WHERE (series_id, week) IN (SELECT (series_id, max(week)) FROM wfeat GROUP BY series_id)""",
       ops=("W12", "J10"))
def q_latest(t):
    # Every part's rows run to the origin: none of its earlier weeks can be the last.
    return PT.latest_row(weekly_panel(t).where(F.col("week") == F.to_date(F.lit(WEEK_ORIGIN))), "part_id", "week")


@query("W13_next_period_features", WFEAT_SPEC.replace("had_return:i ", ""), cte(**W_CTES) + """
, ext2 AS (SELECT series_id, week, consumption_qty, n_lines FROM wdense
  UNION ALL SELECT series_id, max(week) + 7, NULL, NULL FROM wdense GROUP BY series_id
  UNION ALL SELECT series_id, max(week) + 14, NULL, NULL FROM wdense GROUP BY series_id),
f2 AS (SELECT d.*, """ + ", ".join(f"lag(consumption_qty, {k}) OVER w AS lag_{k}" for k in (1, 2, 4, 8, 12))
       + f", {_wroll(4)}, {_wroll(8)}, {_wroll(12)}, lag(n_lines, 1) OVER w AS n_lines_lag1, "
       "weekofyear(week) AS week_of_year, month(week) AS month, quarter(week) AS quarter "
       "FROM ext2 d WINDOW w AS (PARTITION BY series_id ORDER BY week))\n"
       f"SELECT * FROM f2 WHERE week > DATE '{WEEK_ORIGIN}'", ops=("W13",))
def q_next(t):
    ext = weekly_panel(t).select("part_id", "week", "consumption_qty", "n_lines")
    fut = PT.extend_future(ext, "part_id", "week", "consumption_qty")
    feats = PT.weekly_features(fut, "part_id", "week", "consumption_qty", lag_domain=("n_lines",))
    return named(feats.filter(F.col("is_future") == 1))


@query("C8_category_codes", "p_type:s p_type_code:i n_parts:i", """
SELECT p_type, coalesce(c.code, -1) AS p_type_code, count(*) AS n_parts
FROM part LEFT JOIN (SELECT p_type AS t, dense_rank() OVER (ORDER BY p_type) - 1 AS code
                     FROM (SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL)) c ON c.t = part.p_type
GROUP BY p_type, c.code""", ops=("C8",))
def q_codes(t):
    return (PT.category_codes(t["part"].select("p_type"), "p_type")
            .groupBy("p_type", "p_type_code").agg(F.count(F.lit(1)).alias("n_parts")))


PO_SQL = """
SELECT l_orderkey || '-' || l_linenumber AS po_id, l_suppkey AS supplier_id, l_partkey AS part_id,
  CAST(o_orderdate AS DATE) AS order_date, CAST(o_orderdate AS DATE) + 30 AS promised_date,
  CAST(l_shipdate AS DATE) AS receipt_date, l_quantity AS ordered_qty,
  l_extendedprice / nullif(l_quantity, 0) AS unit_cost
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
PM_SQL = """
SELECT p_partkey AS part_id, CASE WHEN p_size <= 16 THEN 'Low' WHEN p_size <= 33 THEN 'Medium' ELSE 'High' END
  AS supplier_risk_class FROM part"""
CARD_SQL = """
SELECT part_id, supplier_id, count(*) AS n_orders, sum(ordered_qty) AS total_qty,
  avg(datediff('day', order_date, receipt_date)) AS avg_lead_days,
  100.0 * count_if(receipt_date <= promised_date) / count(*) AS on_time_pct,
  avg(datediff('day', promised_date, receipt_date)) AS avg_delay_days, max(unit_cost) AS max_unit_cost,
  max(supplier_risk_class) AS risk_class
FROM po LEFT JOIN pm USING (part_id) GROUP BY part_id, supplier_id"""
INC_SQL = """
SELECT l_partkey AS part_id, l_suppkey AS supplier_id, count(*) AS n_incidents, sum(l_quantity) AS scrap_qty
FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL"""


@query("A7_A8_vendor_scorecard", "part_id:i supplier_id:i n_orders:i total_qty:f avg_lead_days:f on_time_pct:f "
       "avg_delay_days:f max_unit_cost:f risk_class:s n_incidents:i scrap_qty:f defect_pct:f",
       cte(po=PO_SQL, pm=PM_SQL, card=CARD_SQL, inc=INC_SQL) + """
SELECT c.*, coalesce(i.n_incidents, 0) AS n_incidents, coalesce(i.scrap_qty, 0.0) AS scrap_qty,
  coalesce(coalesce(i.scrap_qty, 0.0) * 100.0 / nullif(c.total_qty, 0), 0.0) AS defect_pct
FROM card c LEFT JOIN inc i USING (part_id, supplier_id)""", ops=("A7", "A8", "J4", "J2", "S3"))
def q_scorecard(t):
    card = PT.vendor_scorecard(purchase_orders(t), parts_master(t))
    return PT.scorecard_with_quality(card, PT.incident_stats(incidents(t)))


@query("S15_vendor_bands", "part_id:i supplier_id:i on_time_pct:f on_time_band:s defect_pct:f defect_band:s",
       cte(po=PO_SQL, pm=PM_SQL, card=CARD_SQL, inc=INC_SQL, graded="""
SELECT c.part_id, c.supplier_id, c.on_time_pct, coalesce(coalesce(i.scrap_qty, 0.0) * 100.0 / nullif(c.total_qty, 0), 0.0) AS defect_pct
FROM card c LEFT JOIN inc i USING (part_id, supplier_id)""") + """
SELECT *, CASE WHEN on_time_pct >= 90 THEN 'good' WHEN on_time_pct >= 70 THEN 'warning' ELSE 'bad' END AS on_time_band,
  CASE WHEN defect_pct <= 1 THEN 'good' WHEN defect_pct <= 3 THEN 'warning' ELSE 'bad' END AS defect_band FROM graded""", ops=("S15",))
def q_vendor_bands(t):
    return q_scorecard(t).select(
        "part_id", "supplier_id", "on_time_pct", "defect_pct",
        S.band("on_time_pct", 90.0, 70.0, ("good", "warning", "bad"), higher_is_worse=False).alias("on_time_band"),
        S.band("defect_pct", 3.0, 1.0, ("bad", "warning", "good")).alias("defect_band"))


@query("O5_latest_orders_per_vendor", "po_id:s part_id:i supplier_id:i order_date:d receipt_date:d is_late:i",
       cte(po=PO_SQL) + """
SELECT po_id, part_id, supplier_id, order_date, receipt_date,
  CASE WHEN receipt_date > promised_date THEN 1 ELSE 0 END AS is_late
FROM (SELECT *, row_number() OVER (PARTITION BY part_id, supplier_id ORDER BY order_date DESC, po_id) AS rn FROM po)
WHERE rn <= 500""", ops=("O5", "S15"))
def q_latest_orders(t):
    po = PT.latest_n(purchase_orders(t), ["part_id", "supplier_id"], F.desc("order_date"), F.asc("po_id"), 500,
                     salt_col="po_id")
    return po.withColumn("is_late", (F.col("receipt_date") > F.col("promised_date")).cast("int"))


@query("J9_parts_with_orders", "part_id:i part_family:s", """
SELECT p_partkey AS part_id, p_brand AS part_family FROM part
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)""", ops=("J9", "F11"))
def q_parts_with_pos(t):
    return parts_master(t).join(purchase_orders(t).select("part_id"), "part_id", "left_semi").select(
        "part_id", "part_family")


@query("V12_V13_weekly_risk_plan", "series_id:s p10:f p50:f p90:f risk:f recommended_qty:f",
       cte(**W_CTES) + """
, q AS (SELECT series_id, quantile_cont(consumption_qty, 0.1) AS p10, quantile_cont(consumption_qty, 0.5) AS p50,
               quantile_cont(consumption_qty, 0.9) AS p90
        FROM wdense GROUP BY series_id),
r AS (SELECT *, least(1.0, p90 / greatest(p10, 1.0) / 5.0) AS risk FROM q)
SELECT *, round_even(greatest(0.0, p90 - 0.0), 2) AS recommended_qty FROM r
WHERE risk > 0.5 AND round_even(greatest(0.0, p90 - 0.0), 2) > 0""", ops=("V12", "V13", "W12"))
def q_weekly_risk(t):
    qs = weekly_panel(t).groupBy("part_id").agg(F.percentile("consumption_qty", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
                                    .alias("_q"))
    r = named(qs).select("series_id", F.col("_q")[0].alias("p10"), F.col("_q")[1].alias("p50"),
                  F.col("_q")[2].alias("p90")).withColumn("risk", ratio_risk("p10", "p90"))
    return PT.planner(r, "risk", "p50", "p90")
