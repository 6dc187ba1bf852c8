"""Source/sink jobs: write driver-derived tables and read them back with
declared schemas (C2, C4, C6, C7, C11, U4, U5, D8)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from ..sources.files import PARTS_SCHEMAS, bulk_load, load_csv_dir, read_csv_checked, read_csv_table, write_table
from . import q_backtest as BT
from . import q_parts as PARTS
from . import q_plan as QP
from .domain import KEY
from .q_panel import features
from .registry import cte, query


def _dir(t, name):
    return f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/shelfcast-io/{name}-{uuid.uuid4().hex}"


ORDERS_CSV_SCHEMA = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
                                  T.StructField("o_orderstatus", T.StringType()),
                                  T.StructField("o_totalprice", T.DoubleType()),
                                  T.StructField("o_orderdate", T.StringType())])


@query("C4_C6_csv_roundtrip", "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:f o_orderdate:d", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders""",
       ops=("C6", "C4", "U5"))
def q_csv(t):
    path = _dir(t, "orders-csv")
    o = t["orders"].select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                           F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))
    write_table(o, path, fmt="csv", mode="overwrite")
    return read_csv_table(t.spark, path, ORDERS_CSV_SCHEMA, date_cols=("o_orderdate",))


# Referenced tables before those that refer to them.
SEED_ORDER = ["region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events"]


@query("C7_bulk_load_counts", "table_name:s n_rows:i",
       "\nUNION ALL\n".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in SEED_ORDER), ops=("C7", "A23"))
def q_bulk(t):
    seed = _dir(t, "seed")
    schemas = {}
    for name in SEED_ORDER:
        df = t[name]
        write_table(df, f"{seed}/{name}.csv", fmt="csv")
        schemas[name] = df.schema
    # Spark writes a directory per CSV "file"; the loader reads either
    return bulk_load(t.spark, seed, SEED_ORDER, schemas, _dir(t, "loaded"), reset=False)


def parts_raw(t):
    """The driver tables in the raw layout of the parts track."""
    days = lambda c: F.to_date(c)
    week = PARTS.weekly_extract(t)
    return {
        "parts_master": PARTS.parts_master(t).selectExpr(
            "CAST(part_id AS STRING) part_id", "part_family", "CAST(NULL AS STRING) criticality_class", "unit_cost",
            "30L lead_time_days", "CAST(NULL AS STRING) supplier_id_primary", "supplier_risk_class", "is_repairable",
            "CAST(NULL AS INT) shelf_life_days"),
        "purchase_orders": PARTS.purchase_orders(t).select(
            "po_id", F.col("supplier_id").cast("string"), F.lit(PARTS.SITE).alias("site_id"), F.col("part_id").cast("string"),
            days("order_date"), days("promised_date"), days("receipt_date"), F.col("ordered_qty").cast("long"),
            F.col("ordered_qty").cast("long").alias("received_qty")),
        "quality_incidents": PARTS.incidents(t).selectExpr(
            "concat_ws('-', part_id, supplier_id, incident_date) incident_id", "incident_date", "CAST(part_id AS STRING) part_id",
            "CAST(supplier_id AS STRING) supplier_id", f"'{PARTS.SITE}' site_id", "'major' defect_severity",
            "'returned' defect_type", "CAST(scrap_qty AS BIGINT) scrap_qty"),
        "supply_chain_history": week.selectExpr(
            "week AS date", "site_id", "CAST(part_id AS STRING) part_id", "had_return = 1 planned_maintenance",
            "CAST(consumption_qty AS BIGINT) consumption_qty", "0L on_hand_qty", "0L backorder_qty", "0L blocked_qty",
            "0L forecast_qty", "CAST(NULL AS STRING) forecast_type", "CAST(NULL AS DOUBLE) forecast_uplift_pct"),
    }


RAW_TOTALS = {"parts_master": ("part_id", "unit_cost"), "purchase_orders": ("po_id", "ordered_qty"),
              "quality_incidents": ("incident_id", "scrap_qty"), "supply_chain_history": ("part_id", "consumption_qty")}


@query("C1_C2_csv_load", "table_name:s n_rows:i n_keys:i total:f min_date:d max_date:d", cte(ext=PARTS.EXTRACT_SQL) + """
SELECT 'parts_master' AS table_name, count(*) AS n_rows, count(DISTINCT p_partkey) AS n_keys, sum(p_retailprice) AS total,
  NULL::DATE AS min_date, NULL::DATE AS max_date FROM part
UNION ALL SELECT 'purchase_orders', count(*), count(DISTINCT l_orderkey || '-' || l_linenumber), sum(l_quantity),
  min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)) FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT 'quality_incidents', count(*), count(DISTINCT (l_partkey, l_suppkey, CAST(l_shipdate AS DATE))), sum(l_quantity),
  min(CAST(l_shipdate AS DATE)), max(CAST(l_shipdate AS DATE)) FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT 'supply_chain_history', count(*), count(DISTINCT part_id), sum(consumption_qty), min(week), max(week) FROM ext""",
       ops=("C1", "C2", "C4"))
def q_csv_load(t):
    """Raw tables written as CSV, loaded by a name-to-file map with the
    declared schemas, and counted."""
    raw = _dir(t, "raw")
    for name, df in parts_raw(t).items():
        write_table(df, f"{raw}/{name}.csv", fmt="csv")
    loaded = load_csv_dir(t.spark, raw, {n: f"{n}.csv" for n in RAW_TOTALS}, PARTS_SCHEMAS)
    frames = []
    for name, (key, total) in RAW_TOTALS.items():
        dates = [f.name for f in PARTS_SCHEMAS[name] if isinstance(f.dataType, T.DateType)][:1]
        day = F.col(dates[0]) if dates else F.lit(None).cast("date")
        frames.append(loaded[name].agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys"),
                                       F.sum(total).cast("double").alias("total"), F.min(day).alias("min_date"),
                                       F.max(day).alias("max_date")).withColumn("table_name", F.lit(name)))
    return reduce(DataFrame.unionByName, frames)


def _exported(t, df, name, **options):
    """Written as JSON records and read back with the same schema."""
    path = _dir(t, name)
    write_table(df, path, fmt="json", **options)
    return t.spark.read.schema(df.schema).json(path)


def _plan_sql(final):
    return "WITH " + ",\n".join(f"{k} AS (\n{v}\n)" for k, v in QP.plan_ctes(**QP.REC_CTES).items()) + "\n" + final


@query("C11_export_skus", "sku_id:s store_id:s current_stock:i unit_cost:f lead_time_days:i rank_order:i", _plan_sql("""
SELECT product_id AS sku_id, store_id, CAST(round_even(on_hand, 0) AS BIGINT) AS current_stock, round_even(unit_cost, 2) AS unit_cost,
  CAST(greatest(round_even(lead_time_mean, 0), 0) AS BIGINT) AS lead_time_days, rank - 1 AS rank_order FROM recs"""), ops=("C11",))
def q_export_skus(t):
    return _exported(t, QP.flat_recs(t, QP.stored_recs(t)).select(
        F.col("product_id").alias("sku_id"), "store_id", F.bround("on_hand", 0).cast("long").alias("current_stock"),
        F.bround("unit_cost", 2).alias("unit_cost"),
        F.greatest(F.bround("lead_time_mean", 0), F.lit(0.0)).cast("long").alias("lead_time_days"),
        (F.col("rank") - 1).alias("rank_order")), "skus")


#: A compressed file is read by one task.
HISTORY_FILE_ROWS = 2_000_000


@query("C11_export_inventory_history", "sku_id:s recorded_date:d opening_stock:i units_sold:i units_received:i closing_stock:i",
       cte(**BT.bt_ctes()) + """
SELECT CAST(seller_id AS VARCHAR) AS sku_id, day AS recorded_date, 0 AS opening_stock, n_items AS units_sold,
  0 AS units_received, 0 AS closing_stock FROM dense WHERE n_items >= 0""", ops=("C11",))
def q_export_history(t):
    # A record for every seller and day, most of it field names and zeros.
    zero = F.lit(0).cast("long")
    return _exported(t, BT.demand(t).where("n_items >= 0").select(
        F.col(KEY).cast("string").alias("sku_id"), F.col("day").alias("recorded_date"), zero.alias("opening_stock"),
        F.col("n_items").cast("long").alias("units_sold"), zero.alias("units_received"), zero.alias("closing_stock")), "history",
        compression="gzip", maxRecordsPerFile=HISTORY_FILE_ROWS)


@query("C11_export_daily_forecasts", "sku_id:s target_date:d p10_demand:f p50_demand:f p90_demand:f stockout_risk_score:f "
       "store_id:s horizon:i incumbent_forecast:f actual_demand:f model_version:s", _plan_sql(f"""
SELECT r.product_id AS sku_id, h.day AS target_date, h.pred_p10 AS p10_demand, h.pred_p50 AS p50_demand, h.pred_p90 AS p90_demand,
  round_even(least(greatest(coalesce(r.stockout_risk_7d, 0.0), 0.0), 1.0), 4) AS stockout_risk_score, r.store_id, h.horizon,
  h.pred_snaive AS incumbent_forecast, h.actual AS actual_demand, '{QP.MODEL_VERSION}' AS model_version
FROM hold h JOIN recs r ON r.seller_id = h.seller_id"""), ops=("C11", "M10"))
def q_export_forecasts(t):
    risk = F.least(F.greatest(F.coalesce("stockout_risk_7d", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    r = QP.stored_recs(t).select(KEY, "product_id", "store_id", F.bround(risk, 4).alias("stockout_risk_score"))
    return _exported(t, QP.holdout(t).join(r, KEY).select(
        F.col("product_id").alias("sku_id"), F.col("day").alias("target_date"), F.col("pred_p10").alias("p10_demand"),
        F.col("pred_p50").alias("p50_demand"), F.col("pred_p90").alias("p90_demand"), "stockout_risk_score", "store_id",
        "horizon", F.col("pred_snaive").alias("incumbent_forecast"), F.col("actual").alias("actual_demand"),
        F.lit(QP.MODEL_VERSION).alias("model_version")), "forecasts")


# Decision status as the order table spells it.
ORDER_STATUS = {"pending": "PENDING_APPROVAL", "escalated": "PENDING_APPROVAL", "approved": "APPROVED",
                "rejected": "REJECTED", "executed": "EXECUTED"}


@query("C11_export_purchase_orders", "po_id:s sku_id:s status:s ai_recommended_qty:i ai_guardrail_flags:s decision_date:d "
       "reorder_point:f safety_stock:f service_level:f net_benefit:f rationale:s", _plan_sql("""
SELECT 'PO-' || rec_id AS po_id, product_id AS sku_id, 'PENDING_APPROVAL' AS status, recommended_qty AS ai_recommended_qty,
  to_json(fl) AS ai_guardrail_flags, date AS decision_date, reorder_point, safety_stock, service_level, net_benefit, rationale
FROM recs WHERE status IN ('pending', 'escalated')"""), ops=("C11",))
def q_export_orders(t):
    status = F.create_map(*[F.lit(x) for kv in ORDER_STATUS.items() for x in kv])
    return _exported(t, QP.stored_recs(t).select(
        F.concat(F.lit("PO-"), "rec_id").alias("po_id"), F.col("product_id").alias("sku_id"),
        F.coalesce(status[F.col("status")], F.lit("PENDING_APPROVAL")).alias("status"),
        F.col("recommended_qty").cast("long").alias("ai_recommended_qty"), F.to_json("guardrail_flags").alias("ai_guardrail_flags"),
        F.col("date").alias("decision_date"), "reorder_point", "safety_stock", "service_level", "net_benefit", "rationale"), "orders")


@query("C11_export_audit_trace", "entity_id:s actor_name:s action:s details:s", _plan_sql("""
SELECT rec_id AS entity_id, 'planner' AS actor_name, 'DRAFTED' AS action,
  'drafted an order of ' || CAST(CAST(recommended_qty AS BIGINT) AS VARCHAR) || ' units' AS details FROM recs
UNION ALL SELECT rec_id, 'verifier', verdict, left(replace(reasons, ' | ', '; '), 500) FROM recs"""), ops=("C11", "U1"))
def q_export_audit(t):
    two = F.array(F.struct(F.lit("planner").alias("actor_name"), F.lit("DRAFTED").alias("action"),
                           F.concat(F.lit("drafted an order of "), F.col("recommended_qty").cast("long").cast("string"),
                                    F.lit(" units")).alias("details")),
                  F.struct(F.lit("verifier").alias("actor_name"), F.col("verdict").alias("action"),
                           F.left(F.array_join("reasons", "; "), F.lit(500)).alias("details")))
    return _exported(t, QP.stored_recs(t).select(F.col("rec_id").alias("entity_id"), F.inline(two)), "audit")


@query("C11_export_leadtime_forecasts", "sku_id:s origin_date:d store_id:s protection_days:f p10_lt:f p50_lt:f p90_lt:f", _plan_sql(
    "SELECT product_id AS sku_id, date AS origin_date, store_id, protection_days, p10_lt, p50_lt, p_alpha_lt AS p90_lt FROM recs"),
       ops=("C11", "V4"))
def q_export_leadtime(t):
    return _exported(t, QP.stored_recs(t).select(
        F.col("product_id").alias("sku_id"), F.col("date").alias("origin_date"), "store_id", "protection_days", "p10_lt",
        "p50_lt", F.col("p_alpha_lt").alias("p90_lt")), "leadtimes")


@query("C11_export_recommendations", "rec_id:s recommended_qty:f net_benefit:f evidence_json:s flags_json:s",
       "WITH " + ",\n".join(f"{k} AS (\n{v}\n)" for k, v in QP.plan_ctes(**QP.REC_CTES).items()) + """
SELECT rec_id, coalesce(TRY_CAST(recommended_qty AS DOUBLE), 0.0) AS recommended_qty, net_benefit,
  to_json({'p50_lt': round_even(p50_lt, 2), 'p90_lt': round_even(p_alpha_lt, 2), 'lead_time_mean': lead_time_mean,
           'lead_time_std': lead_time_std, 'confidence': confidence,
           'top_drivers': ['roll_mean_7', 'lag_7', 'lt_mean']}) AS evidence_json,
  to_json(fl) AS flags_json
FROM recs""", ops=("C11", "S10", "U4"))
def q_export(t):
    r = QP.stored_recs(t)
    num = F.coalesce(F.nanvl(F.col("recommended_qty").try_cast("double"), F.lit(None).cast("double")), F.lit(0.0))
    out = r.select("rec_id", num.alias("recommended_qty"), "net_benefit",
                   F.to_json("evidence").alias("evidence_json"), F.to_json("guardrail_flags").alias("flags_json"))
    path = _dir(t, "recs-export")
    write_table(out, path, fmt="json")
    schema = "rec_id string, recommended_qty double, net_benefit double, evidence_json string, flags_json string"
    return t.spark.read.schema(schema).json(path)


@query("D8_forbidden_feature_columns", "n_columns:i n_forbidden:i", None, ops=("D8",))
def q_forbidden(t):
    cols = features(t).columns          # schema only: no data is read
    bad = [c for c in cols if any(w in c.lower() for w in ("discount", "promo", "weather"))]
    return t.spark.createDataFrame([(len(cols), len(bad))], "n_columns long, n_forbidden long")


RAW_ORDERS = T.StructType([T.StructField("order_id", T.LongType()), T.StructField("customer_id", T.LongType()),
                           T.StructField("price", T.DoubleType()), T.StructField("purchased", T.DateType())])


@query("C2_csv_rejects", "outcome:s n_rows:i total:f", """
WITH o AS (SELECT *, CASE WHEN o_orderkey % 83 = 0 THEN 'number of fields'
    WHEN o_orderkey % 97 = 0 AND o_orderkey % 89 = 0 THEN 'price,purchased' WHEN o_orderkey % 97 = 0 THEN 'price'
    WHEN o_orderkey % 89 = 0 THEN 'purchased' ELSE 'accepted' END AS outcome FROM orders)
SELECT outcome, count(*) AS n_rows, CASE WHEN outcome = 'accepted' THEN sum(round_even(o_totalprice, 2)) END AS total FROM o GROUP BY outcome
UNION ALL SELECT 'lines', count(*), NULL FROM o""", ops=("C1", "C2", "C4"))
def q_csv_rejects(t):
    """Orders as CSV lines, some with a price or date that is none or with a
    field too many: accepted rows and rejects by reason, beside all lines."""
    k = F.col("o_orderkey")
    line = F.concat_ws(",", k, "o_custkey", F.when(k % 97 == 0, F.lit("n/a")).otherwise(F.bround("o_totalprice", 2).cast("string")),
                       F.when(k % 89 == 0, F.lit("31.31.")).otherwise(F.to_date("o_orderdate").cast("string")),
                       F.when(k % 83 == 0, F.lit("more")))
    path = f"{_dir(t, 'raw')}/orders_lines"
    t["orders"].select(line.alias("value")).write.mode("overwrite").text(path)
    ok, bad = read_csv_checked(t.spark, path, RAW_ORDERS, header=False)
    lines = t.spark.read.text(path).agg(F.lit("lines").alias("outcome"), F.count(F.lit(1)).alias("n_rows"))
    parts = [ok.agg(F.lit("accepted").alias("outcome"), F.count(F.lit(1)).alias("n_rows"), F.sum("price").alias("total")),
             bad.groupBy(F.array_join("reasons", ",").alias("outcome")).agg(F.count(F.lit(1)).alias("n_rows")), lines]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


@query("C11_export_stores", "store_id:s store_name:s", _plan_sql("SELECT DISTINCT store_id, store_id AS store_name FROM recs"), ops=("C11",))
def q_export_stores(t):
    return _exported(t, QP.stored_recs(t).select("store_id", F.col("store_id").alias("store_name")).distinct(), "stores")


# Column names of the order table's export are fixed values; the reviewer's
# columns stay empty until a person has decided.
REVIEW_COLUMNS = {"human_approved_qty": "bigint", "reviewer_user_id": "string", "human_feedback": "string",
                  "reviewed_at": "timestamp_ntz", "executed_at": "timestamp_ntz"}
ORDER_NUMBERS = ("on_hand", "reorder_point", "safety_stock", "service_level", "days_to_stockout", "stockout_risk_7d",
                 "cost_if_ignored", "cost_of_action", "net_benefit")


@query("C11_export_order_economics", "po_id:s rec_id:s store_id:s decision_date:d " + " ".join(f"{c}:f" for c in ORDER_NUMBERS)
       + " proposer:s verification:s " + " ".join(f"{c}:{'i' if k == 'bigint' else 't' if k == 'timestamp_ntz' else 's'}"
                                                    for c, k in REVIEW_COLUMNS.items()), _plan_sql(f"""
SELECT 'PO-' || rec_id AS po_id, rec_id, store_id, date AS decision_date, {', '.join(ORDER_NUMBERS)},
  '{{"recommendation":"' || CASE WHEN net_benefit > 0 THEN 'APPROVE' ELSE 'HOLD' END || '"}}' AS proposer,
  '{{"verdict":"' || verdict || '","final_decision":"' || final_decision || '"}}' AS verification,
  {', '.join(f'NULL AS {c}' for c in REVIEW_COLUMNS)} FROM recs"""), ops=("C11",))
def q_export_order_economics(t):
    """The columns of the order table beside those of the drafts' export."""
    proposal = F.when(F.col("net_benefit") > 0, F.lit("APPROVE")).otherwise(F.lit("HOLD"))
    return _exported(t, QP.stored_recs(t).select(
        F.concat(F.lit("PO-"), "rec_id").alias("po_id"), "rec_id", "store_id", F.col("date").alias("decision_date"), *ORDER_NUMBERS,
        F.to_json(F.struct(proposal.alias("recommendation"))).alias("proposer"),
        F.to_json(F.struct("verdict", "final_decision")).alias("verification"),
        *[F.lit(None).cast(k).alias(c) for c, k in REVIEW_COLUMNS.items()]), "economics")


@query("C11_export_generation_log", "log_id:s po_id:s model_version:s input_context:s generated_rationale:s prompt_tokens:i "
       "completion_tokens:i", _plan_sql(f"""
SELECT 'LOG-' || rec_id AS log_id, 'PO-' || rec_id AS po_id, '{QP.MODEL_VERSION}' AS model_version,
  '{{"recommended_qty":' || CAST(CAST(recommended_qty AS BIGINT) AS VARCHAR) || ',"days_to_stockout":' || CAST(days_to_stockout AS VARCHAR)
  || ',"verdict":"' || verdict || '"}}' AS input_context, rationale AS generated_rationale, NULL AS prompt_tokens, NULL AS completion_tokens
FROM recs"""), ops=("C11", "U1"))
def q_export_generation_log(t):
    context = F.struct(F.col("recommended_qty").cast("bigint").alias("recommended_qty"), "days_to_stockout", "verdict")
    none = F.lit(None).cast("bigint")
    return _exported(t, QP.stored_recs(t).select(
        F.concat(F.lit("LOG-"), "rec_id").alias("log_id"), F.concat(F.lit("PO-"), "rec_id").alias("po_id"),
        F.lit(QP.MODEL_VERSION).alias("model_version"), F.to_json(context).alias("input_context"),
        F.col("rationale").alias("generated_rationale"), none.alias("prompt_tokens"), none.alias("completion_tokens")), "genlog")
