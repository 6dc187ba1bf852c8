"""Reports over recommendations, forecasts, events and parts (A9-A22, O3-O8,
F7-F10, J12, S6, S11-S13, U2, U3, U6, V15, V16, M8, M9, A11, C10)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import decisions as DC
from ..operators import forecast as FC
from ..operators import parts as PT
from ..session import ensure_checkpoint_dir
from ..sources.files import write_table
from ..sources.tables import DRIVER_TABLES, schema_rows
from . import q_plan as QP
from . import q_policy as QPOL
from .domain import KEY
from .q_backtest import POINT_SQL
from .registry import query


def recs(t):
    return t.memo("recs", lambda: QP.stored_recs(t))


def _recs_sql(final: str, **more) -> str:
    ctes = QP.plan_ctes(**QP.REC_CTES, **more)
    return "WITH " + ",\n".join(f"{k} AS (\n{v}\n)" for k, v in ctes.items()) + "\n" + final


@query("A9_kpis", "n_recs:i n_pending:i n_high_risk:i cost_at_risk:f n_escalated:i mean_lift_pct:f",
       _recs_sql("""SELECT count(*) AS n_recs, count_if(status = 'pending') AS n_pending,
  count_if(status = 'pending' AND stockout_risk_7d > 0.5) AS n_high_risk,
  round_even(coalesce(sum(cost_if_ignored) FILTER (WHERE status = 'pending'), 0.0), 2) AS cost_at_risk,
  count_if(status = 'escalated') AS n_escalated, (SELECT avg((m.wape - q.wape) / m.wape) * 100
    FROM pm m JOIN pm q ON q.fold = m.fold AND q.model = 'q_p50' WHERE m.model = 'ma') AS mean_lift_pct FROM recs""", pm=POINT_SQL),
       ops=("A9", "V16"))
def q_kpis(t):
    r = recs(t)
    pend = F.col("status") == "pending"
    lift = F.broadcast(q_lift(t).withColumnRenamed("lift_pct", "mean_lift_pct"))      # one row
    return r.agg(F.count(F.lit(1)).alias("n_recs"), F.count_if(pend).alias("n_pending"),
                 F.count_if(pend & (F.col("stockout_risk_7d") > 0.5)).alias("n_high_risk"),
                 F.bround(F.coalesce(F.sum(F.when(pend, F.col("cost_if_ignored"))), F.lit(0.0)), 2)
                 .alias("cost_at_risk"),
                 F.count_if(F.col("status") == "escalated").alias("n_escalated")).join(lift, how="inner")


def _lift_sql():
    from . import q_backtest as BT
    ctes = BT.bt_ctes(**BT.PRED_CTES, active=BT.ACTIVE_SQL, scale=BT.SCALE_SQL, pm=BT.POINT_SQL)
    return "WITH " + ",\n".join(f"{k} AS (\n{v}\n)" for k, v in ctes.items()) + """
SELECT avg((m.wape - q.wape) / m.wape) * 100 AS lift_pct
FROM pm m JOIN pm q ON q.fold = m.fold AND q.model = 'q_p50' WHERE m.model = 'ma'"""


@query("A10_forecast_lift", "lift_pct:f", _lift_sql(), ops=("A10",))
def q_lift(t):
    from . import q_backtest as BT
    scales, active = FC.training_stats(BT.bt_activity(t), BT.activity_folds(t), KEY)
    m = FC.backtest_metrics(BT.predictions(t), scales, active, KEY)
    w = (m.filter(F.col("metric") == "wape").groupBy("fold")
         .agg(F.first(F.when(F.col("model") == "ma", F.col("value")), ignorenulls=True).alias("ma"),
              F.first(F.when(F.col("model") == "q_p50", F.col("value")), ignorenulls=True).alias("q")))
    return w.agg((F.avg(F.try_divide(F.col("ma") - F.col("q"), F.col("ma"))) * 100).alias("lift_pct"))


SEG_SQL = """
SELECT r.*, CASE WHEN h % 100 < 30 THEN 'SMB' ELSE 'Enterprise' END AS vendor_size,
  CASE WHEN (h // 100) % 100 < 40 THEN 'International' ELSE 'Domestic' END AS vendor_region
FROM (SELECT *, CAST(('0x' || md5(product_id))::UHUGEINT % 10000 AS BIGINT) AS h FROM recs) r"""
RATES_SQL = """
SELECT 'vendor_size' AS dimension, coalesce(vendor_size, 'Unknown') AS segment, count(*) AS total,
  count_if(status IN ('pending', 'rejected')) AS escalated FROM seg GROUP BY 2
UNION ALL SELECT 'vendor_region', coalesce(vendor_region, 'Unknown'), count(*),
  count_if(status IN ('pending', 'rejected')) FROM seg GROUP BY 2"""


IMPACT_SQL = """
SELECT r.dimension, r.segment, r.total, r.escalated, r.escalated * 1.0 / r.total AS rate,
  CASE WHEN b.rate IS NULL OR b.rate = 0 THEN 1.0 ELSE (r.escalated * 1.0 / r.total) / b.rate END AS ratio,
  CASE WHEN b.rate IS NULL OR b.rate = 0 OR r.segment = b.base THEN 0
       WHEN (r.escalated * 1.0 / r.total) / b.rate < 0.8 OR (r.escalated * 1.0 / r.total) / b.rate > 1.25 THEN 1
       ELSE 0 END AS flagged
FROM rates r LEFT JOIN (SELECT dimension, segment AS base, escalated * 1.0 / total AS rate FROM rates
  WHERE (dimension = 'vendor_size' AND segment = 'Enterprise') OR (dimension = 'vendor_region' AND segment = 'Domestic')) b
  USING (dimension)"""


@query("A13_A14_disparate_impact", "dimension:s segment:s total:i escalated:i rate:f ratio:f flagged:i",
       _recs_sql("""
""" + IMPACT_SQL + """""", seg=SEG_SQL, rates=RATES_SQL), ops=("A13", "A14", "S11"))
def q_fairness(t):
    size, region = S.vendor_segments("product_id")
    r = recs(t).select(size.alias("vendor_size"), region.alias("vendor_region"), "status")
    esc = F.col("status").isin("pending", "rejected")
    rates = (r.select(F.explode(F.array(
        F.struct(F.lit("vendor_size").alias("dimension"), F.coalesce("vendor_size", F.lit("Unknown")).alias("segment")),
        F.struct(F.lit("vendor_region").alias("dimension"), F.coalesce("vendor_region", F.lit("Unknown")).alias("segment"))
    )).alias("_d"), esc.alias("_e"))
        .groupBy("_d.dimension", "_d.segment")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if("_e").alias("escalated"))
        .withColumn("rate", F.col("escalated") / F.col("total")))
    base = t.spark.createDataFrame([("vendor_size", "Enterprise"), ("vendor_region", "Domestic")],
                                   "dimension string, base string")
    b = (rates.join(F.broadcast(base), (rates.dimension == base.dimension) & (rates.segment == base.base))
         .select(base.dimension, "base", F.col("rate").alias("b_rate")))
    j = rates.join(b, "dimension", "left")
    ratio = F.when(F.col("b_rate").isNull() | (F.col("b_rate") == 0), F.lit(1.0)).otherwise(
        F.col("rate") / F.col("b_rate"))
    flagged = (F.when(F.col("b_rate").isNull() | (F.col("b_rate") == 0) | (F.col("segment") == F.col("base")), 0)
               .when((ratio < 0.8) | (ratio > 1.25), 1).otherwise(0))
    return j.select("dimension", "segment", "total", "escalated", "rate", ratio.alias("ratio"), flagged.alias("flagged"))


@query("A14_worst_group", "dimension:s worst_group:s ratio:f flagged:i", _recs_sql("""
SELECT dimension, arg_max(segment, (abs(1 - ratio), segment)) FILTER (flagged = 1) AS worst_group,
  coalesce(arg_max(ratio, (abs(1 - ratio), segment)) FILTER (flagged = 1), 1.0) AS ratio, max(flagged) AS flagged
FROM impact GROUP BY dimension""", seg=SEG_SQL, rates=RATES_SQL, impact=IMPACT_SQL), ops=("A14",))
def q_worst(t):
    """Per dimension the flagged segment farthest from its base segment."""
    worst = F.max(F.when(F.col("flagged") == 1, F.struct(F.abs(1 - F.col("ratio")).alias("far"), "segment", "ratio")))
    g = q_fairness(t).groupBy("dimension").agg(worst.alias("w"), F.max("flagged").alias("flagged"))
    return g.select("dimension", F.col("w.segment").alias("worst_group"), F.coalesce("w.ratio", F.lit(1.0)).alias("ratio"), "flagged")



@query("A15_location_rollup", "store_id:s n_recs:i n_high:i max_risk:f top_product:s min_days:i",
       _recs_sql("""
SELECT store_id, count(*) AS n_recs, count_if(stockout_risk_7d > 0.9) AS n_high, max(stockout_risk_7d) AS max_risk,
  arg_max(product_id, (stockout_risk_7d, rank)) AS top_product, min(days_to_stockout) AS min_days
FROM recs GROUP BY store_id ORDER BY max_risk DESC, store_id LIMIT 12"""), ops=("A15", "O8"))
def q_locations(t):
    r = recs(t)
    g = (r.groupBy("store_id")
         .agg(F.count(F.lit(1)).alias("n_recs"), F.count_if(F.col("stockout_risk_7d") > 0.9).alias("n_high"),
              F.max("stockout_risk_7d").alias("max_risk"),
              F.max_by("product_id", F.struct("stockout_risk_7d", "rank")).alias("top_product"),
              F.min("days_to_stockout").alias("min_days")))
    return g.orderBy(F.desc("max_risk"), "store_id").limit(12)


@query("A16_risk_bands", "band:s n_recs:i", _recs_sql("""
SELECT coalesce(band, 'all') AS band, count(*) AS n_recs FROM (
  SELECT CASE WHEN stockout_risk_7d > 0.9 THEN 'high' WHEN stockout_risk_7d > 0.45 THEN 'med' ELSE 'low' END AS band
  FROM recs) GROUP BY ROLLUP (band)"""), ops=("A16", "S15"))
def q_bands(t):
    b = recs(t).select(S.band("stockout_risk_7d", 0.9, 0.45).alias("band"))
    return b.rollup("band").agg(F.count(F.lit(1)).alias("n_recs")).select(
        F.coalesce("band", F.lit("all")).alias("band"), "n_recs")


@query("A17_risk_heatmap", "store_id:s product_id:s mean_risk:f", _recs_sql("""
SELECT store_id, product_id, avg(stockout_risk_7d) AS mean_risk FROM recs GROUP BY ALL"""), ops=("A17",))
def q_heatmap(t):
    return recs(t).groupBy("store_id", "product_id").agg(F.avg("stockout_risk_7d").alias("mean_risk"))


CONTRACT_CTE = dict(contract=QPOL.CONTRACT_SQL.replace("\nSELECT", "SELECT", 1))


@query("A18_A19_series_summary", "product_id:s avg_p50:f max_p50:f min_p50:f avg_band:f total_actual:f mape:f "
       "trend_pct:f trend:s days_of_supply:f above_reorder:i",
       _recs_sql("""
, s AS (SELECT c.*, row_number() OVER (PARTITION BY product_id ORDER BY horizon) AS rn,
          count(*) OVER (PARTITION BY product_id) AS n FROM contract c),
a AS (SELECT product_id, avg(p50) AS avg_p50, max(p50) AS max_p50, min(p50) AS min_p50, avg(p90 - p10) AS avg_band,
  sum(actual) AS total_actual,
  CASE WHEN count(*) FILTER (WHERE actual IS NOT NULL) > 2
       THEN 100.0 * avg(abs(actual - p50) / CASE WHEN abs(actual) = 0 THEN 1.0 ELSE abs(actual) END) END AS mape,
  avg(p50) FILTER (WHERE rn <= n // 2) AS first_half, avg(p50) FILTER (WHERE rn > n // 2) AS second_half
  FROM s GROUP BY product_id)
SELECT a.product_id, avg_p50, max_p50, min_p50, avg_band, total_actual, mape,
  CASE WHEN coalesce(first_half, 0) = 0 THEN 0.0 ELSE (second_half - first_half) / first_half * 100 END AS trend_pct,
  CASE WHEN (CASE WHEN coalesce(first_half, 0) = 0 THEN 0.0 ELSE (second_half - first_half) / first_half * 100 END) > 2 THEN 'up'
       WHEN (CASE WHEN coalesce(first_half, 0) = 0 THEN 0.0 ELSE (second_half - first_half) / first_half * 100 END) < -2 THEN 'down'
       ELSE 'flat' END AS trend,
  r.on_hand / CASE WHEN coalesce(avg_p50, 0) = 0 THEN 1.0 ELSE avg_p50 END AS days_of_supply,
  CASE WHEN r.on_hand > r.reorder_point THEN 1 ELSE 0 END AS above_reorder
FROM a JOIN recs r USING (product_id)""".replace("\n, s AS", "SELECT 1 AS _x) , s AS", 1).replace(
           "SELECT 1 AS _x) ", ""), **CONTRACT_CTE), ops=("A18", "A19"))
def q_summary(t):
    c = QPOL.q_contract(t)
    w = Window.partitionBy("product_id").orderBy("horizon")
    s = c.select("*", F.row_number().over(w).alias("rn"),
                 F.count(F.lit(1)).over(Window.partitionBy("product_id")).alias("n"))
    half = F.floor(F.col("n") / 2)
    a = s.groupBy("product_id").agg(
        F.avg("p50").alias("avg_p50"), F.max("p50").alias("max_p50"), F.min("p50").alias("min_p50"),
        F.avg(F.col("p90") - F.col("p10")).alias("avg_band"), F.sum("actual").alias("total_actual"),
        F.when(F.count("actual") > 2, F.avg(F.abs(F.col("actual") - F.col("p50")) /
               F.when(F.abs("actual") == 0, F.lit(1.0)).otherwise(F.abs("actual"))) * 100).alias("mape"),
        F.avg(F.when(F.col("rn") <= half, F.col("p50"))).alias("_h1"),
        F.avg(F.when(F.col("rn") > half, F.col("p50"))).alias("_h2"))
    tp = F.when(F.coalesce("_h1", F.lit(0.0)) == 0, F.lit(0.0)).otherwise(
        (F.col("_h2") - F.col("_h1")) / F.col("_h1") * 100)
    r = recs(t).select("product_id", "on_hand", "reorder_point")
    return (a.join(r, "product_id").select(
        "product_id", "avg_p50", "max_p50", "min_p50", "avg_band", "total_actual", "mape", tp.alias("trend_pct"),
        F.when(tp > 2, "up").when(tp < -2, "down").otherwise("flat").alias("trend"),
        (F.col("on_hand") / F.when(F.coalesce("avg_p50", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("avg_p50")))
        .alias("days_of_supply"),
        (F.col("on_hand") > F.col("reorder_point")).cast("int").alias("above_reorder")))


@query("A21_A22_distinct_pairs_dates", "kind:s store_id:s product_id:s date:d", _recs_sql("""
, c2 AS (SELECT 1)
SELECT DISTINCT 'pair' AS kind, store_id, product_id, NULL::DATE AS date FROM contract
UNION ALL SELECT DISTINCT 'date', NULL, NULL, date FROM recs""".replace("\n, c2 AS (SELECT 1)", ""),
       **CONTRACT_CTE), ops=("A21", "A22"))
def q_distinct(t):
    c = QPOL.stored_contract(t)
    pairs = c.select(F.lit("pair").alias("kind"), "store_id", "product_id",
                     F.lit(None).cast("date").alias("date")).distinct()
    dates = recs(t).select(F.lit("date").alias("kind"), F.lit(None).cast("string").alias("store_id"),
                           F.lit(None).cast("string").alias("product_id"), "date").distinct().orderBy(F.desc("date"))
    return pairs.unionByName(dates)


PAGE, LIMIT = 2, 10


@query("O4_paged_recommendations", "rec_id:s rank:i status:s total:i page:i",
       _recs_sql(f"""SELECT rec_id, rank, status, (SELECT count(*) FROM recs) AS total, {PAGE} AS page FROM recs
ORDER BY rank NULLS LAST, rec_id LIMIT {LIMIT} OFFSET {(PAGE - 1) * LIMIT}"""), ops=("O4", "O3", "F7", "C9", "J5"))
def q_page(t):
    r = DC.status_filter(recs(t), "status", "all")
    tot = r.agg(F.count(F.lit(1)).alias("total"))
    pg = (r.orderBy(F.col("rank").asc_nulls_last(), "rec_id").offset((PAGE - 1) * LIMIT).limit(LIMIT)
          .select("rec_id", "rank", "status"))
    return pg.join(F.broadcast(tot), how="inner").withColumn("page", F.lit(PAGE))


@query("F7_status_filter", "rec_id:s status:s", _recs_sql("SELECT rec_id, status FROM recs WHERE status = 'escalated'"),
       ops=("F7", "V16"))
def q_status_filter(t):
    return DC.status_filter(recs(t), "status", "escalated").select("rec_id", "status")


@query("F8_point_lookup", "date:d product_id:s horizon:i p50:f", _recs_sql("""
SELECT date, product_id, horizon, p50 FROM contract
WHERE product_id = (SELECT product_id FROM recs WHERE rank = 1) AND horizon <= 7""", **CONTRACT_CTE), ops=("F8",))
def q_lookup(t):
    """The first week of the product that ranks first: the rank is looked up in
    the stored recommendations, product, horizon and month go into the scan."""
    first = recs(t).filter(F.col("rank") == 1).select("product_id", "date").first()
    c = QPOL.stored_contract(t)
    if first is None:
        return c.limit(0).select("date", "product_id", "horizon", "p50")
    week = [F.lit(first["date"]), F.date_add(F.lit(first["date"]), 6)]
    months = [F.year(d) * 100 + F.month(d) for d in week]
    return (c.filter(F.col("month").between(*months) & (F.col("product_id") == first["product_id"]) & (F.col("horizon") <= 7))
            .select("date", "product_id", "horizon", "p50"))


@query("F9_substring_search", "p_partkey:i p_name:s", """
SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red')
ORDER BY p_partkey LIMIT 50""", ops=("F9", "O8"))
def q_search(t):
    q = "red"
    p = t["part"]
    return (p.filter(F.lower("p_name").contains(q) | F.lower("p_brand").contains(q))
            .orderBy("p_partkey").limit(50).select("p_partkey", "p_name"))


@query("F10_threshold_alerts", "alert:s rec_id:s rank:i", _recs_sql("""
(SELECT 'risk' AS alert, rec_id, rank FROM recs WHERE stockout_risk_7d > 0.1 ORDER BY rank LIMIT 3)
UNION ALL (SELECT 'pending', rec_id, rank FROM recs WHERE status = 'pending' ORDER BY rank LIMIT 3)"""),
       ops=("F10", "U1"))
def q_alerts(t):
    r = recs(t)
    a = r.filter(F.col("stockout_risk_7d") > 0.1).orderBy("rank").limit(3).select(
        F.lit("risk").alias("alert"), "rec_id", "rank")
    b = r.filter(F.col("status") == "pending").orderBy("rank").limit(3).select(
        F.lit("pending").alias("alert"), "rec_id", "rank")
    return a.unionByName(b)


UUID_SQL = """
(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
  lower(printf('%x', (CAST(('0x' || substr(h, 17, 1)) AS INTEGER) & 3) | 8)) || substr(h, 18, 3) || '-' ||
  substr(h, 21, 12) FROM (SELECT sha1(unhex('11111111222233334444555555555555') || encode(rec_id || '|' || product_id)) AS h))"""


@query("S_identifiers", "rec_id:s short_id:s record_uuid:s store_status:s app_status:s fingerprint:s",
       _recs_sql(f"""
SELECT rec_id, CASE WHEN length(rec_id) > 10 THEN left(rec_id, 4) || '…' || right(rec_id, 4) ELSE rec_id END AS short_id,
  {UUID_SQL} AS record_uuid,
  CASE status WHEN 'pending' THEN 'PENDING_APPROVAL' WHEN 'approved' THEN 'APPROVED' WHEN 'rejected' THEN 'REJECTED'
              WHEN 'executed' THEN 'EXECUTED' END AS store_status,
  coalesce(CASE CASE status WHEN 'pending' THEN 'PENDING_APPROVAL' WHEN 'approved' THEN 'APPROVED'
    WHEN 'rejected' THEN 'REJECTED' WHEN 'executed' THEN 'EXECUTED' END
    WHEN 'PENDING_APPROVAL' THEN 'pending' WHEN 'APPROVED' THEN 'approved' WHEN 'REJECTED' THEN 'rejected'
    WHEN 'EXECUTED' THEN 'executed' END, 'pending') AS app_status,
  left(sha256('{{"days_to_stockout": ' || CAST(days_to_stockout AS VARCHAR) || ', "product_id": "' || product_id ||
   '", "recommended_qty": ' || CAST(recommended_qty AS VARCHAR) || '}}'), 16) AS fingerprint
FROM recs"""), ops=("S6", "S12", "S13", "J12", "S10"))
def q_identifiers(t):
    r = recs(t)
    db = S.status_to_db("status")
    return r.select("rec_id", S.short_id("rec_id").alias("short_id"),
                    S.uuid5("rec_id", "product_id").alias("record_uuid"), db.alias("store_status"),
                    S.status_to_app(db).alias("app_status"),
                    S.fingerprint({"days_to_stockout": F.col("days_to_stockout"), "product_id": F.col("product_id"),
                                   "recommended_qty": F.col("recommended_qty")}).alias("fingerprint"))


@query("U2_rank_order", "product_id:s rank_order:i", _recs_sql("""
SELECT product_id, row_number() OVER (ORDER BY prio, product_id) AS rank_order FROM (
  SELECT product_id, min(prio) AS prio FROM (
    SELECT product_id, 0 AS prio FROM recs WHERE status = 'escalated'
    UNION ALL SELECT product_id, 1 FROM contract) GROUP BY product_id)""", **CONTRACT_CTE), ops=("U2",))
def q_rank_order(t):
    first = recs(t).filter(F.col("status") == "escalated").select("product_id")
    return DC.ordered_union_rank(first, QPOL.stored_contract(t).select("product_id"), "product_id")


# The decision log: each user's latest event speaks for the series with the
# user's number; only two kinds of event decide anything.
SAID_SQL = """
SELECT user_id AS seller_id, CASE kind WHEN 'purchase' THEN 'approved' ELSE 'rejected' END AS st, decided
FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS kind, max(ts) AS decided FROM events GROUP BY user_id) e
WHERE kind IN ('purchase', 'error')"""


def decision_log(t):
    last = t["events"].groupBy(F.col("user_id").alias(KEY)).agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"), F.max("ts").alias("decided_at"))
    return last.filter(F.col("kind").isin("purchase", "error")).select(
        KEY, F.when(F.col("kind") == "purchase", "approved").otherwise("rejected").alias("status"), "decided_at")


@query("U3_apply_decisions", "rec_id:s status:s recommended_qty:f reviewed_at:t", _recs_sql("""
SELECT r.rec_id, coalesce(d.st, r.status) AS status, coalesce(d.qty, r.recommended_qty) AS recommended_qty,
  CASE WHEN d.st IS NOT NULL AND d.st <> 'pending' THEN d.decided END AS reviewed_at
FROM recs r LEFT JOIN (SELECT seller_id, st, decided, CASE WHEN st = 'approved' THEN recommended_qty END AS qty
  FROM recs JOIN said USING (seller_id)) d USING (seller_id)""", said=SAID_SQL), ops=("U3",))
def q_apply(t):
    r = recs(t)
    said = decision_log(t)
    d = r.select(KEY, "rec_id", "recommended_qty").join(said, KEY).select(
        "rec_id", "status", F.when(F.col("status") == "approved", F.col("recommended_qty")).alias("qty"), "decided_at")
    return DC.apply_decisions(r.select("rec_id", "status", "recommended_qty"), d)


@query("V15_purchase_orders", "po_id:s rec_id:s qty:f", _recs_sql("""
SELECT 'PO-' || rec_id AS po_id, rec_id, recommended_qty AS qty
FROM recs JOIN said USING (seller_id) WHERE st = 'approved'""", said=SAID_SQL), ops=("V15",))
def q_pos(t):
    po, _ = DC.approved_orders(_decided(t), F.col("decided_at"))
    return po.select("po_id", "rec_id", "qty")


def _decided(t):
    return recs(t).drop("status").join(decision_log(t), KEY)


@query("V15_order_audit", "entity_id:s entity_type:s actor_type:s actor_name:s action:s timestamp:t", _recs_sql("""
SELECT rec_id AS entity_id, 'recommendation' AS entity_type, 'agent' AS actor_type, 'executor' AS actor_name,
  'po_created' AS action, decided AS timestamp FROM recs JOIN said USING (seller_id) WHERE st = 'approved'""", said=SAID_SQL),
       ops=("V15", "U4"))
def q_order_audit(t):
    """The audit rows of the purchase orders, appended to an audit table in
    the shared checkpoint folder and read back from it."""
    _, audit = DC.approved_orders(_decided(t), F.col("decided_at"))
    root = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/audit-{uuid.uuid4().hex}"
    write_table(audit.limit(0), root, mode="overwrite")
    write_table(audit, root, mode="append")
    return t.spark.read.parquet(root)


@query("O6_audit_latest", "event_id:i user_id:i action:s ts:t", """
SELECT event_id, user_id, event_type AS action, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 500""",
       ops=("O6", "U4"))
def q_audit(t):
    e = t["events"]
    return (e.orderBy(F.desc("ts"), F.desc("event_id")).limit(500)
            .select("event_id", "user_id", F.col("event_type").alias("action"), "ts"))


@query("O7_latest_event_per_type", "event_type:s event_id:i value:f k:i", """
SELECT event_type, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value,
  arg_max(CAST(json_extract(props, '$.k') AS BIGINT), event_id) AS k FROM events GROUP BY event_type""",
       ops=("O7", "S10"))
def q_latest_event(t):
    e = t["events"].select("event_type", "event_id", "value",
                           F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    m = e.groupBy("event_type").agg(F.max_by(F.struct("event_id", "value", "k"), "event_id").alias("_r"))
    return m.select("event_type", "_r.event_id", "_r.value", "_r.k")


@query("U6_backfill_names", "c_custkey:i display_name:s", """
SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END, ''),
  upper(left(split_part(lower(replace(c_name, '#', '.')) || '@example.com', '@', 1), 1)) ||
  substr(split_part(lower(replace(c_name, '#', '.')) || '@example.com', '@', 1), 2)) AS display_name FROM customer""",
       ops=("U6",))
def q_backfill(t):
    c = t["customer"]
    name = F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.col("c_name"))
    email = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com"))
    return c.select("c_custkey", S.backfill_name(name, email).alias("display_name"))


@query("C10_schema_introspection", "table_name:s column_name:s ordinal:i", """
SELECT table_name, column_name, ordinal_position AS ordinal FROM information_schema.columns
WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events')""",
       ops=("C10",))
def q_schema(t):
    return schema_rows(t.spark, {n: t[n] for n in DRIVER_TABLES}).drop("data_type")


@query("S15_days_bands", "rec_id:s days_to_stockout:i days_band:s", _recs_sql("""
SELECT rec_id, days_to_stockout, CASE WHEN days_to_stockout <= 3 THEN 'bad' WHEN days_to_stockout <= 7 THEN 'warning' ELSE 'good' END AS days_band
FROM recs"""), ops=("S15",))
def q_days_bands(t):
    return recs(t).select("rec_id", "days_to_stockout", S.days_band("days_to_stockout").alias("days_band"))
