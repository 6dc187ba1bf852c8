"""Policy replay jobs: three-arm ledger, totals and lift, service-level
sweep, contract tables (V8, V9, A28, A5, M10, V4 table, A20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inventory as INV
from . import q_backtest as BT
from . import q_plan as QP
from .domain import KEY
from .registry import query

ALPHAS = (0.9, 0.95, 0.99)


def train_mean(t, base):
    """A5: mean demand per series before its first forecast day (own span)."""
    p = BT.bt_activity(t).join(base.select(KEY, "date"), KEY)
    days = F.datediff(F.first("date"), F.min("day"))
    return p.filter(F.col("day") < F.col("date")).groupBy(KEY).agg((F.sum("n_items") / days).alias("train_mean"))


def replay_input(t, base):
    """One row per (series, arm, day) of the planning window. Arms: A fixed
    historical mean, B seasonal-naive point forecast (clipped at 0), C
    order-up-to the protection-interval quantile."""
    fc = QP.holdout(t).join(base.select(KEY), KEY, "left_semi")
    b = base.join(train_mean(t, base), KEY, "left")
    lead = F.greatest(F.bround("lt_mean", 0), F.lit(1.0)).cast("int")
    arms = F.array(
        F.struct(F.lit("A_static_rule").alias("arm"), F.lit("fixed").alias("policy"),
                 F.coalesce("train_mean", "daily_p50").alias("fixed_order")),
        F.struct(F.lit("B_point_forecast").alias("arm"), F.lit("fixed").alias("policy"),
                 F.greatest(F.col("pred_snaive"), F.lit(0.0)).alias("fixed_order")),
        F.struct(F.lit("C_order_up_to").alias("arm"), F.lit("order_up_to").alias("policy"),
                 F.lit(None).cast("double").alias("fixed_order")))
    rows = fc.join(b.select(KEY, "p_alpha_lt", "on_hand", "lt_mean", "unit_cost",
                            "unit_margin", "train_mean", "daily_p50"), KEY)
    return (rows.select(F.col(KEY).alias("series"), (F.col("horizon") - 1).alias("t"),
                        F.col("actual").alias("demand"), F.col("p_alpha_lt").alias("order_up_to"),
                        F.col("on_hand").alias("initial_on_hand"), lead.alias("lead_time_days"),
                        "unit_cost", "unit_margin", F.explode(arms).alias("a"))
            .select("series", "a.arm", "t", "demand", "a.fixed_order", "order_up_to", "a.policy",
                    "initial_on_hand", "lead_time_days", "unit_cost", "unit_margin"))


def ledger(t):
    return t.memo("ledger", lambda: INV.replay(replay_input(t, QP.plan_base(t))))


# ---------------------------------------------------------------- SQL pieces
TRAIN_MEAN_SQL = """
SELECT b.seller_id, avg(p.n_items) AS train_mean
FROM basep b JOIN bpanel p ON p.seller_id = b.seller_id AND p.day < b.date GROUP BY b.seller_id"""
INP_SQL = """
SELECT h.seller_id AS series, a.arm, h.horizon - 1 AS t, h.actual AS demand,
  CASE a.arm WHEN 'A_static_rule' THEN coalesce(m.train_mean, p.daily_p50)
             WHEN 'B_point_forecast' THEN greatest(h.pred_snaive, 0.0) END AS fixed,
  p.p_alpha_lt AS s_level, a.policy, p.on_hand AS oh0,
  CAST(greatest(round_even(p.lt_mean, 0), 1) AS INTEGER) AS lead, p.unit_cost AS uc, p.unit_margin AS um
FROM hold h JOIN plan p USING (seller_id) LEFT JOIN tmean m USING (seller_id),
     (VALUES ('A_static_rule', 'fixed'), ('B_point_forecast', 'fixed'),
             ('C_order_up_to', 'order_up_to')) a(arm, policy)"""
SIM_SQL = """
SELECT series, arm, -1 AS t, oh0 AS oh, CAST([] AS DOUBLE[]) AS ord,
  NULL::DOUBLE AS on_hand_start, NULL::DOUBLE AS demand, NULL::DOUBLE AS order_placed
FROM inp WHERE t = 0
UNION ALL
SELECT series, arm, t, greatest(0.0, st - demand) AS oh,
  list_append(ord, greatest(0.0, order_placed)) AS ord, st AS on_hand_start, demand, order_placed
FROM (
  SELECT y.*, CASE WHEN policy = 'order_up_to'
      THEN greatest(0.0, s_level - (greatest(0.0, st - demand) + pipe)) ELSE coalesce(fixed, 0.0) END
      AS order_placed
  FROM (
    SELECT i.series, i.arm, i.t, i.demand, i.fixed, i.s_level, i.policy, s.ord,
      s.oh + CASE WHEN i.t - i.lead >= 0 THEN s.ord[i.t - i.lead + 1] ELSE 0.0 END AS st,
      coalesce(list_sum(list_slice(s.ord, greatest(i.t - i.lead + 1, 0) + 1, i.t)), 0.0) AS pipe
    FROM sim s JOIN inp i ON i.series = s.series AND i.arm = s.arm AND i.t = s.t + 1) y) z"""
LEDGER_SQL = """
SELECT s.series AS seller_id, s.arm, s.t AS day, s.on_hand_start, s.demand,
  least(s.on_hand_start, s.demand) AS units_sold, greatest(0.0, s.demand - s.on_hand_start) AS stockout_units,
  s.order_placed, s.oh AS on_hand_end, s.oh * i.uc * (0.25 / 365.0) AS holding_cost,
  greatest(0.0, s.demand - s.on_hand_start) * i.um * 1.2 AS stockout_cost
FROM sim s JOIN inp i ON i.series = s.series AND i.arm = s.arm AND i.t = s.t
WHERE s.t >= 0"""
TOTALS_SQL = """
SELECT arm, sum(holding_cost) AS total_holding_cost, sum(stockout_cost) AS total_stockout_cost,
  sum(holding_cost) + sum(stockout_cost) AS total_cost,
  count_if(stockout_units > 0) AS stockout_days, avg(on_hand_end) AS avg_on_hand
FROM ledger GROUP BY arm"""


def _policy_sql(final: str) -> str:
    ctes = QP.plan_ctes(tmean=TRAIN_MEAN_SQL, inp=INP_SQL, sim=SIM_SQL, ledger=LEDGER_SQL,
                        totals=TOTALS_SQL)
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS (\n{v}\n)" for k, v in ctes.items()) + "\n" + final


LEDGER_SPEC = ("seller_id:i arm:s day:i on_hand_start:f demand:f units_sold:f stockout_units:f "
               "order_placed:f on_hand_end:f holding_cost:f stockout_cost:f")


@query("V8_policy_ledger", LEDGER_SPEC, _policy_sql("SELECT * FROM ledger"),
       ops=("V8", "V5", "A5", "U1"))
def q_ledger(t):
    return ledger(t).withColumnRenamed("series", KEY).withColumnRenamed("t", "day")


@query("A28_policy_totals", "arm:s total_holding_cost:f total_stockout_cost:f total_cost:f "
       "stockout_days:i avg_on_hand:f", _policy_sql("SELECT * FROM totals"), ops=("A28",))
def q_totals(t):
    return INV.policy_totals(ledger(t))


LIFT_SQL = """
SELECT p.base, p.challenger, round_even(b.total_cost - c.total_cost, 2) AS net_benefit,
  b.stockout_days - c.stockout_days AS stockout_days_reduced,
  round_even(CASE WHEN b.avg_on_hand <> 0 THEN 100.0 * (b.avg_on_hand - c.avg_on_hand) / b.avg_on_hand
             ELSE 0.0 END, 2) AS avg_inventory_change_pct,
  round_even(100.0 * (b.total_cost - c.total_cost) / nullif(b.total_cost, 0), 2) AS savings_pct
FROM (VALUES ('B_point_forecast', 'C_order_up_to'), ('A_static_rule', 'C_order_up_to')) p(base, challenger)
JOIN totals b ON b.arm = p.base JOIN totals c ON c.arm = p.challenger"""


@query("A28_policy_lift", "base:s challenger:s net_benefit:f stockout_days_reduced:i "
       "avg_inventory_change_pct:f savings_pct:f", _policy_sql(LIFT_SQL), ops=("A28", "A20"))
def q_lift(t):
    tot = INV.policy_totals(ledger(t))
    lift = INV.policy_lift(tot, [("B_point_forecast", "C_order_up_to"),
                                 ("A_static_rule", "C_order_up_to")])
    base_cost = tot.select(F.col("arm").alias("base"), F.col("total_cost").alias("_bc"))
    # Savings % = net benefit / base-arm cost x 100
    return (lift.join(base_cost, "base")
            .withColumn("savings_pct", F.bround(F.try_divide(
                F.lit(100.0) * F.col("net_benefit"), F.nullif(F.col("_bc"), F.lit(0.0))), 2)))


CONTRACT_SQL = f"""
SELECT h.day AS date, r.store_id, CAST(h.seller_id AS VARCHAR) AS product_id, h.horizon,
  h.pred_p10 AS p10, h.pred_p50 AS p50, h.pred_p90 AS p90, h.pred_snaive AS incumbent,
  h.actual, '{QP.MODEL_VERSION}' AS model_version
FROM hold h JOIN recs r ON r.seller_id = h.seller_id"""


@query("M10_forecast_contract", "date:d store_id:s product_id:s horizon:i p10:f p50:f p90:f "
       "incumbent:f actual:f model_version:s",
       "WITH " + ",\n".join(f"{k} AS (\n{v}\n)" for k, v in QP.plan_ctes(**QP.REC_CTES).items())
       + CONTRACT_SQL, ops=("M10", "D10"))
def q_contract(t):
    return contract(t, QP.recommendations(t))


def stored_contract(t):
    """The forecast contract of these inputs from the stored table, by month."""
    return QP.result_store(t).stored("forecast_contract", QP.run_id(t), lambda: contract(t, QP.stored_recs(t)).select(
        "*", QP.month_of("date")), ("month",))


def contract(t, recs):
    r = recs.select(KEY, "store_id")
    return (QP.holdout(t).join(r, KEY)
            .select(F.col("day").alias("date"), "store_id", F.col(KEY).cast("string").alias("product_id"),
                    "horizon", F.col("pred_p10").alias("p10"), F.col("pred_p50").alias("p50"),
                    F.col("pred_p90").alias("p90"), F.col("pred_snaive").alias("incumbent"),
                    "actual", F.lit(QP.MODEL_VERSION).alias("model_version")))


@query("V4_forecasts_lt", "origin_date:d store_id:s product_id:s protection_days:f p10_lt:f "
       "p50_lt:f p90_lt:f",
       "WITH " + ",\n".join(f"{k} AS (\n{v}\n)" for k, v in QP.plan_ctes(**QP.REC_CTES).items())
       + "\nSELECT date AS origin_date, store_id, product_id, protection_days, p10_lt, p50_lt, "
         "p_alpha_lt AS p90_lt FROM recs", ops=("V4", "V1"))
def q_forecasts_lt(t):
    return QP.recommendations(t).select(F.col("date").alias("origin_date"), "store_id", "product_id",
                                        "protection_days", "p10_lt", "p50_lt",
                                        F.col("p_alpha_lt").alias("p90_lt"))


def sweep(t):
    """V9: arm C at every service level. Each level (a short fixed list)
    derives its own protection-interval quantile and ledger; their totals are
    united."""
    frames = []
    for a in ALPHAS:
        base = QP.plan_base(t, alpha=a)
        led = INV.replay(replay_input(t, base).filter(F.col("arm") == "C_order_up_to"))
        frames.append(INV.policy_totals(led.withColumn("service_level", F.lit(a)),
                                        by=("service_level",)))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


SWEEP_SQL = """
SELECT {a} AS service_level, sum(holding_cost) AS total_holding_cost,
  sum(stockout_cost) AS total_stockout_cost, sum(holding_cost) + sum(stockout_cost) AS total_cost,
  count_if(stockout_units > 0) AS stockout_days, avg(on_hand_end) AS avg_on_hand
FROM ledger WHERE arm = 'C_order_up_to'"""


def _sweep_sql():
    parts = []
    for a in ALPHAS:
        ctes = QP.plan_ctes(alpha=a, tmean=TRAIN_MEAN_SQL, inp=INP_SQL, sim=SIM_SQL, ledger=LEDGER_SQL)
        parts.append("(WITH RECURSIVE " + ",\n".join(f"{k} AS (\n{v}\n)" for k, v in ctes.items())
                     + "\n" + SWEEP_SQL.format(a=a) + ")")
    return "\nUNION ALL\n".join(parts)


@query("V9_service_level_sweep", "service_level:f total_holding_cost:f total_stockout_cost:f "
       "total_cost:f stockout_days:i avg_on_hand:f", _sweep_sql(), ops=("V9", "A28"))
def q_sweep(t):
    return sweep(t)
