"""Plan jobs: forecasts -> protection-interval quantiles -> order quantities
-> risk and cost -> guardrails -> decision (flagship), contract tables and
the three-arm policy replay (M10, A3-A5, O1, V1-V11, V14, W11, S5, S7,
A28, V8, V9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import inventory as I
from ..operators import decisions as DC
from ..operators import forecast as FC
from ..operators import inventory as INV
from ..operators.ordering import running
from ..operators.panel import lead_time_stats, origin_end
from . import q_backtest as BT
from .domain import KEY, LT_COLS, ORIGIN, ORIGIN_END_SQL, order_lines
from .registry import cte, query
from ..session import ensure_checkpoint_dir, materialize
from ..sources.store import TableStore, fingerprint

TOP_N = 50
SERVICE_ALPHA = 0.9
REVIEW_DAYS = 1
MAX_LEAD_DAYS = 28
CONFIDENCE = 0.91
MODEL_VERSION = "empirical_q_v1"
# Part of a stored plan's name: raise it whenever what a plan computes changes.
PLAN_VERSION = "3"
# Evidence drivers cited on every recommendation.
TOP_DRIVERS = ["roll_mean_7", "lag_7", "lt_mean"]


def holdout(t) -> DataFrame:
    """Predictions of the holdout alone: a plan needs no other fold."""
    def build():
        last = BT.activity_folds(t).filter(F.col("fold") == "holdout")
        return materialize(FC.backtest_predictions(BT.bt_activity(t), last, KEY), "holdout")
    return t.memo("holdout", build)


def holdout_end(t) -> DataFrame:
    """One row: the last day of the plan's training data."""
    return F.broadcast(BT.activity_folds(t).filter(F.col("fold") == "holdout").select(F.col("train_end").alias("_te")))


def series_info(t) -> DataFrame:
    """A3 + F12: median active-day price (0/NULL -> 50) and the lead-time
    snapshot (NULL -> 7 / 2 days) of every series with a forecast, as known at
    the end of the plan's training data: nothing of the forecast days enters."""
    end = holdout_end(t)
    act = BT.activity(t).join(end, F.col("day") <= F.col("_te"))
    price = act.groupBy(KEY).agg(F.percentile("avg_price", F.lit(0.5)).alias("price"))
    lines = order_lines(t).join(end, F.col("purchase_ts") < origin_end(F.col("_te")))
    lt = lead_time_stats(lines, F.col("_te"), KEY, **LT_COLS)
    return (holdout(t).select(KEY).distinct().join(price, KEY, "left").join(lt, KEY, "left")
            .select(KEY, F.when(F.coalesce(F.col("price"), F.lit(0.0)) == 0, F.lit(50.0))
                    .otherwise(F.col("price")).alias("price"),
                    F.coalesce("lt_mean", F.lit(7.0)).alias("lt_mean"),
                    F.coalesce("lt_std", F.lit(2.0)).alias("lt_std")))


def volumes(fc: DataFrame) -> DataFrame:
    """A4: forecast volume per series, rounded so that float sums cannot
    reorder ties."""
    return fc.groupBy(KEY).agg(F.bround(F.sum("pred_p50"), 6).alias("volume"))


def ranked_series(fc: DataFrame) -> DataFrame:
    """Every series with its rank by volume, the series id as tie key."""
    return running(volumes(fc), [F.desc("volume"), F.asc(KEY)], rank="rank")


def top_series(fc: DataFrame, n: int = TOP_N) -> DataFrame:
    """O1: the n largest by volume, a distributed top-k."""
    return volumes(fc).orderBy(F.desc("volume"), F.asc(KEY)).limit(n)


def store_of(t) -> DataFrame:
    """Store label of a series: its supplier's nation."""
    s, n = t["supplier"], t["nation"]
    return (s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)
            .select(F.col("s_suppkey").alias(KEY), F.col("n_name").alias("store_id")))


def plan_base(t, alpha=SERVICE_ALPHA):
    """Per series: forecast summaries, economics, protection interval. Written
    once per service level because the plan, the replay and the sweep each
    read it several times."""
    return t.memo(f"plan_base_{alpha}", lambda: materialize(_plan_base(t, alpha), f"plan_base_{alpha}"))


def plan_series(t):
    """What a plan knows of each series before the service level enters."""
    return t.memo("plan_series", lambda: materialize(_plan_series(t), "plan_series"))


def window_counts(t):
    """Totals of every series' protection windows up to the train end, with
    their counts: all service levels take their quantiles from them."""
    def build():
        hist = BT.bt_activity(t).join(holdout_end(t), F.col("day") <= F.col("_te"))
        return materialize(INV.window_total_counts(hist, plan_series(t).select(KEY, "protection_days"), KEY, last="_te"),
                           "window_counts")
    return t.memo("window_counts", build)


def _plan_base(t, alpha):
    iq = INV.quantiles_of_counts(window_counts(t), KEY, alpha)
    return plan_series(t).join(iq.drop("protection_days"), KEY, "left")


def _plan_series(t):
    fc = holdout(t)
    ranks = ranked_series(fc)
    f = (fc.groupBy(KEY).agg(F.min("day").alias("date"), F.min("train_end").alias("train_end"),
                           F.percentile("pred_p50", F.lit(0.5)).alias("_med_p50"),
                           F.avg("pred_p10").alias("mean_p10"), F.avg("pred_p50").alias("mean_p50"),
                           F.avg("pred_p90").alias("mean_p90")))
    info = series_info(t)
    lead = F.least(F.greatest(F.bround("lt_mean", 0), F.lit(1.0)), F.lit(float(MAX_LEAD_DAYS)))
    daily = F.greatest(F.col("_med_p50"), F.lit(0.01))
    return ranks.join(f, KEY).join(info, KEY).select(
        "*", daily.alias("daily_p50"), F.bround(F.lit(7.0) * daily, 2).alias("on_hand"),
        I.protection_interval_days(lead.cast("int"), REVIEW_DAYS).alias("protection_days"),
        I.unit_cost("price").alias("unit_cost"), I.unit_margin("price").alias("unit_margin"))


def recommendations(t, alpha=SERVICE_ALPHA) -> DataFrame:
    b = plan_base(t, alpha)
    b = INV.order_quantity(b, I.order_up_to_level("p_alpha_lt"), "on_hand", moq=1.0, pack=1.0)
    x = F.col("on_hand") / F.col("protection_days")
    qty = F.bround("final_qty", 0)
    r = b.withColumns({
        "recommended_qty": qty,
        "reorder_point": F.bround(I.reorder_point("p_alpha_lt"), 2),
        "safety_stock": F.bround(I.safety_stock("p_alpha_lt", "p50_lt"), 2),
        "stockout_risk_7d": F.bround(I.exceedance_prob(x, "mean_p10", "mean_p50", "mean_p90"), 3),
        "days_to_stockout": I.days_to_stockout("on_hand", "daily_p50"),
        "cost_if_ignored": F.bround(I.stockout_cost(F.col("mean_lt") - F.col("on_hand"), "unit_margin"), 2),
        "cost_of_action": F.bround(I.holding_cost(qty, "unit_cost") * F.col("protection_days"), 2),
        "rec_id": F.format_string("REC-%s-%s", F.col("date").cast("string"),
                                  F.left(F.col(KEY).cast("string"), F.lit(8))),
        "product_id": F.col(KEY).cast("string"),
        "service_level": F.lit(float(alpha)),
        "confidence": F.lit(CONFIDENCE),
        "has_evidence": F.lit(True),
        "status": F.lit("pending"),
    })
    r = r.withColumns({
        "net_benefit": F.bround(F.col("cost_if_ignored") - F.col("cost_of_action"), 2),
        "evidence": F.struct(
            F.bround("p50_lt", 2).alias("p50_lt"), F.bround("p_alpha_lt", 2).alias("p90_lt"),
            F.bround("lt_mean", 1).alias("lead_time_mean"),
            F.bround("lt_std", 1).alias("lead_time_std"), F.col("confidence"),
            F.array(*[F.lit(d) for d in TOP_DRIVERS]).alias("top_drivers")),
    }).withColumnRenamed("qty_flags", "guardrail_flags")
    r = r.join(store_of(t), KEY, "left")
    r = DC.guardrails(r, order_by=("rank",), partition_by=("date",))
    # The proposer weighs benefit against cost only; the rule also sees the flags.
    r = DC.decide(r, proposal=F.when(F.col("net_benefit") > 0, F.lit("APPROVE")).otherwise(F.lit("HOLD")))
    return r.withColumn("rationale", DC.rationale("recommended_qty", "product_id", "store_id",
                                                  "evidence.top_drivers", "days_to_stockout"))


REC_SPEC = ("rec_id:s date:d store_id:s product_id:s seller_id:i rank:i on_hand:f reorder_point:f "
            "safety_stock:f raw_qty:f recommended_qty:f service_level:f stockout_risk_7d:f "
            "days_to_stockout:i cost_if_ignored:f cost_of_action:f net_benefit:f unit_cost:f "
            "protection_days:f p10_lt:f p50_lt:f p_alpha_lt:f mean_lt:f lead_time_mean:f "
            "lead_time_std:f confidence:f running_spend:f flags:s status:s final_decision:s "
            "verdict:s reasons:s rationale:s")


def result_store(t) -> TableStore:
    return TableStore(t.spark, f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/shelfcast-store")


def run_id(t) -> str:
    """The inputs' files and the settings that a plan depends on."""
    def build():
        return fingerprint({n: t[n] for n in ("lineitem", "orders", "supplier", "nation")}, MODEL_VERSION, PLAN_VERSION, ORIGIN, str(SERVICE_ALPHA))
    return t.memo("run_id", build)


def month_of(day: str):
    return (F.year(day) * 100 + F.month(day)).alias("month")


def stored_recs(t) -> DataFrame:
    """The recommendations of these inputs from the stored table; the first
    reader publishes them, all others scan one month's files."""
    return result_store(t).stored("recommendations", run_id(t), lambda: recommendations(t).select("*", month_of("date")), ("month",))


def flat_recs(t, recs: DataFrame | None = None) -> DataFrame:
    return (recommendations(t) if recs is None else recs.drop("month")).select(
        "*", F.col("evidence.lead_time_mean").alias("lead_time_mean"),
        F.col("evidence.lead_time_std").alias("lead_time_std"),
        F.array_join("guardrail_flags", ",").alias("flags"),
        F.array_join("reasons", " | ").alias("reasons_s")).drop("reasons").withColumnRenamed(
        "reasons_s", "reasons")


# ---------------------------------------------------------------- SQL pieces
HOLD_SQL = "SELECT * FROM preds WHERE fold = 'holdout'"
INFO_SQL = """
SELECT v.seller_id,
  CASE WHEN coalesce(a.price, 0) = 0 THEN 50.0 ELSE a.price END AS price,
  coalesce(lt.lt_mean, 7.0) AS lt_mean, coalesce(lt.lt_std, 2.0) AS lt_std
FROM (SELECT DISTINCT seller_id FROM hold) v
LEFT JOIN (SELECT seller_id, quantile_cont(avg_price, 0.5) AS price FROM act
           WHERE day <= (SELECT train_end FROM folds WHERE fold = 'holdout') GROUP BY seller_id) a
  ON a.seller_id = v.seller_id
LEFT JOIN lt ON lt.seller_id = v.seller_id"""
TRAIN_END_SQL = "(SELECT CAST(train_end + INTERVAL 1 DAY AS TIMESTAMP) FROM folds WHERE fold = 'holdout')"
TOP_SQL = """
SELECT seller_id, volume, row_number() OVER (ORDER BY volume DESC, seller_id) AS rank
FROM (SELECT seller_id, round_even(sum(pred_p50), 6) AS volume FROM hold GROUP BY seller_id) v"""
BASEP_SQL = f"""
SELECT tp.seller_id, tp.rank, f.date, f.train_end, f.mean_p10, f.mean_p50, f.mean_p90,
  greatest(f.med_p50, 0.01) AS daily_p50, round_even(7.0 * greatest(f.med_p50, 0.01), 2) AS on_hand,
  CAST(least(greatest(round_even(i.lt_mean, 0), 1), {MAX_LEAD_DAYS}) AS INTEGER) + {REVIEW_DAYS}
    AS protection_days,
  0.6 * i.price AS unit_cost, 0.4 * i.price AS unit_margin, i.lt_mean, i.lt_std
FROM top tp
JOIN (SELECT seller_id, min(day) AS date, min(train_end) AS train_end,
             quantile_cont(pred_p50, 0.5) AS med_p50, avg(pred_p10) AS mean_p10,
             avg(pred_p50) AS mean_p50, avg(pred_p90) AS mean_p90
      FROM hold GROUP BY seller_id) f USING (seller_id)
JOIN info i USING (seller_id)"""
# brute force: every full window of P days as a self-join
WIN_SQL = """
SELECT b.seller_id, p.day, sum(q.n_items) AS total
FROM basep b
JOIN bpanel p ON p.seller_id = b.seller_id AND p.day <= b.train_end
JOIN bpanel q ON q.seller_id = b.seller_id AND q.day BETWEEN p.day - (b.protection_days - 1) AND p.day
GROUP BY b.seller_id, p.day, b.protection_days
HAVING count(*) = b.protection_days"""


def iq_sql(alpha):
    return f"""
SELECT seller_id, quantile_cont(total, 0.1) AS p10_lt, quantile_cont(total, 0.5) AS p50_lt,
       quantile_cont(total, {alpha}) AS p_alpha_lt, avg(total) AS mean_lt
FROM win GROUP BY seller_id"""


def _risk(x):
    return f"""CASE WHEN {x} < greatest(mean_p10, 0) THEN 1.0
  WHEN {x} < mean_p50 AND mean_p50 > greatest(mean_p10, 0)
    THEN 0.9 - 0.4 * ({x} - greatest(mean_p10, 0)) / (mean_p50 - greatest(mean_p10, 0))
  WHEN {x} < mean_p50 + 1.25 * (mean_p90 - mean_p50) AND mean_p90 > mean_p50
    THEN 0.5 - 0.4 * ({x} - mean_p50) / (mean_p90 - mean_p50)
  ELSE 0.0 END"""


PLAN_SQL = f"""
SELECT b.*, q.p10_lt, q.p50_lt, q.p_alpha_lt, q.mean_lt,
  round_even(greatest(0.0, q.p_alpha_lt - b.on_hand), 2) AS raw_qty,
  round_even(CASE WHEN greatest(0.0, q.p_alpha_lt - b.on_hand) > 0
                   AND greatest(0.0, q.p_alpha_lt - b.on_hand) < 1.0 THEN 1.0
             ELSE greatest(0.0, q.p_alpha_lt - b.on_hand) END, 2) AS final_qty,
  CASE WHEN greatest(0.0, q.p_alpha_lt - b.on_hand) > 0
        AND greatest(0.0, q.p_alpha_lt - b.on_hand) < 1.0 THEN 'below_moq_rounded_up' END AS qflag
FROM basep b LEFT JOIN iq q USING (seller_id)"""
REC1_SQL = f"""
SELECT p.*, round_even(final_qty, 0) AS recommended_qty,
  round_even(p_alpha_lt, 2) AS reorder_point, round_even(p_alpha_lt - p50_lt, 2) AS safety_stock,
  round_even({_risk('(on_hand / protection_days)')}, 3) AS stockout_risk_7d,
  CAST(trunc(least(on_hand / daily_p50, 99.0)) AS INTEGER) AS days_to_stockout,
  round_even(greatest(0.0, mean_lt - on_hand) * unit_margin * 1.2, 2) AS cost_if_ignored,
  round_even(round_even(final_qty, 0) * unit_cost * (0.25 / 365.0) * protection_days, 2) AS cost_of_action,
  'REC-' || CAST(date AS VARCHAR) || '-' || left(CAST(seller_id AS VARCHAR), 8) AS rec_id,
  CAST(seller_id AS VARCHAR) AS product_id, {SERVICE_ALPHA} AS service_level,
  {CONFIDENCE} AS confidence, n.n_name AS store_id,
  round_even(lt_mean, 1) AS lead_time_mean, round_even(lt_std, 1) AS lead_time_std
FROM plan p JOIN supplier s ON s.s_suppkey = p.seller_id JOIN nation n ON n.n_nationkey = s.s_nationkey"""
REC2_SQL = """
SELECT r.*, round_even(cost_if_ignored - cost_of_action, 2) AS net_benefit,
  recommended_qty * unit_cost AS order_value,
  coalesce(sum(recommended_qty * unit_cost) OVER (PARTITION BY date ORDER BY rank
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS running_spend
FROM rec1 r"""
REC3_SQL = f"""
SELECT r.*, list_filter([qflag,
    CASE WHEN order_value > 20000.0 THEN 'exceeds_order_value_cap' END,
    CASE WHEN running_spend + order_value > 100000.0 THEN 'exceeds_daily_budget' END,
    CASE WHEN confidence < 0.6 THEN 'below_confidence_threshold' END], lambda x: x IS NOT NULL) AS fl
FROM rec2 r"""
RECS_SQL = """
SELECT r.*, array_to_string(fl, ',') AS flags,
  CASE WHEN net_benefit > 0 AND len(fl) = 0 THEN 'APPROVE' ELSE 'HOLD' END AS final_decision,
  CASE WHEN net_benefit > 0 AND len(fl) > 0 THEN 'OVERRIDE' ELSE 'AGREE' END AS verdict,
  CASE WHEN net_benefit > 0 AND len(fl) = 0 THEN 'pending' ELSE 'escalated' END AS status,
  CASE WHEN len(fl) = 0 AND net_benefit > 0 THEN 'benefit covers the cost, nothing flagged'
       ELSE array_to_string(list_filter([
         CASE WHEN len(fl) > 0 THEN 'flagged: ' || array_to_string(fl, ', ') END,
         CASE WHEN net_benefit <= 0 THEN 'benefit does not cover the cost' END], lambda x: x IS NOT NULL), ' | ')
  END AS reasons,
  'Buy ' || CAST(recommended_qty AS VARCHAR) || ' of ' || left(product_id, 8) || ' for ' ||
  store_id || ': main driver roll mean 7, stock lasts about ' ||
  CAST(days_to_stockout AS VARCHAR) || ' days.' AS rationale
FROM rec3 r"""


def plan_ctes(alpha=SERVICE_ALPHA, **more):
    from .q_panel import LT_SQL
    d = BT.bt_ctes(**BT.PRED_CTES)
    d.update(lt=LT_SQL.replace(ORIGIN_END_SQL, TRAIN_END_SQL), hold=HOLD_SQL, info=INFO_SQL, top=TOP_SQL, basep=BASEP_SQL, win=WIN_SQL,
             iq=iq_sql(alpha), plan=PLAN_SQL)
    d.update(more)
    return d


REC_CTES = dict(rec1=REC1_SQL, rec2=REC2_SQL, rec3=REC3_SQL, recs=RECS_SQL)


@query("V14_recommendations", REC_SPEC, cte(**plan_ctes(**REC_CTES)) + "\nSELECT * FROM recs",
       ops=("A3", "A4", "O1", "F12", "V1", "V2", "V3", "V4", "V5", "V6", "V7", "V10", "V11",
            "V14", "W11", "S5", "S7", "S8", "S14", "J11", "J5"))
def q_recommendations(t):
    return flat_recs(t)


@query("O1_top_series", "seller_id:i volume:f",
       cte(**plan_ctes()) + f"\nSELECT seller_id, volume FROM top ORDER BY volume DESC, seller_id LIMIT {TOP_N}", ops=("O1", "A4"))
def q_top(t):
    return top_series(holdout(t))
