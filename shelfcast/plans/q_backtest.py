"""Backtest jobs: dead-zone cutoff, folds, baselines, quantiles, metrics
(F5, W6, F6, W10, M1-M6, A6, E1-E10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as FC
from ..operators import panel as P
from ..operators import quantile_boost as QB
from ..functions import metrics as M
from ..session import materialize
from .domain import KEY, LINES_SQL, ORIGIN
from .q_panel import ACT_SQL, DENSE_SQL, GRID_SQL, line_aggs
from .registry import cte, query


def activity(t, origin=ORIGIN):
    """A1 at the origin."""
    return P.activity_from(line_aggs(t, origin), KEY)


def demand(t, origin=ORIGIN):
    """Dense daily demand panel with lag_7 (for the MASE scale)."""
    def build():
        act = activity(t, origin).select(KEY, "day", "n_items")
        return P.densify(act, origin, KEY, carry=(), lags=(7,))
    return t.memo(f"demand_{origin}", build)


def bt_panel(t):
    """F5 applied: demand panel without the dead zone."""
    return t.memo("bt_panel", lambda: materialize(P.truncate_dead_zone(demand(t)), "bt_panel"))


def bt_folds(panel):
    return FC.folds(panel)


def bt_cutoff(t):
    """F5 from the activity alone: the last day of ``bt_panel``."""
    return t.memo("bt_cutoff", lambda: materialize(P.cutoff_of_totals(P.activity_totals(
        activity(t).select("day", "n_items"), ORIGIN)), "bt_cutoff"))


def bt_activity(t):
    """The rows of ``bt_panel`` with demand; every other day of a series up to the cutoff has none."""
    return activity(t).join(F.broadcast(bt_cutoff(t)), F.col("day") <= F.col("cutoff")).drop("cutoff")


def activity_folds(t):
    """The folds of ``bt_panel``, from its activity."""
    def build():
        first = activity(t).agg(F.min("day").alias("_first"))
        return materialize(FC.folds_of_span(first.join(bt_cutoff(t).select(F.col("cutoff").alias("_last")), how="inner")), "folds")
    return t.memo("activity_folds", build)


def predictions(t):
    def build():
        return materialize(FC.backtest_predictions(bt_activity(t), activity_folds(t), KEY), "predictions")
    return t.memo("predictions", build)


# ---------------------------------------------------------------- SQL pieces
def _dense_ctes():
    return dict(lines=LINES_SQL, act=ACT_SQL, grid=GRID_SQL, dense=DENSE_SQL)


DAILY_SQL = "SELECT day, sum(n_items) AS total FROM dense GROUP BY day"
TRAIL_SQL = """
SELECT day, total,
  CASE WHEN count(total) OVER fr >= 30 THEN quantile_cont(total, 0.5) OVER fr END AS trail_median
FROM daily WINDOW fr AS (ORDER BY day ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)"""
CUTOFF_SQL = "SELECT max(day) AS cutoff FROM trail WHERE total >= coalesce(0.2 * trail_median, 0.0)"
BPANEL_SQL = """
SELECT d.seller_id, d.day, d.n_items,
       lag(d.n_items, 7) OVER (PARTITION BY d.seller_id ORDER BY d.day) AS lag_7
FROM dense d, cutoff c WHERE d.day <= c.cutoff"""
FOLDS_SQL = f"""
SELECT f.fold, CAST(m.last_day - f.a AS DATE) AS train_end, CAST(m.last_day - f.b AS DATE) AS test_start,
       CAST(m.last_day - f.c AS DATE) AS test_end, m.first_day AS calendar_start
FROM (VALUES {', '.join(map(str, FC.DAILY_FOLDS))}) f(fold, a, b, c),
     (SELECT max(day) AS last_day, min(day) AS first_day FROM bpanel) m"""
TEST_SQL = """
SELECT f.fold, p.seller_id, p.day, datediff('day', f.train_end, p.day) AS horizon,
       p.n_items AS actual, f.train_end
FROM bpanel p JOIN folds f ON p.day BETWEEN f.test_start AND f.test_end"""
MA_SQL = """
SELECT f.fold, p.seller_id, sum(p.n_items) / 28.0 AS pred_ma
FROM bpanel p JOIN folds f ON p.day BETWEEN f.train_end - 27 AND f.train_end
GROUP BY f.fold, p.seller_id"""
BASE_SQL = """
SELECT t.fold, t.seller_id, t.day, t.horizon, t.actual,
       coalesce(n.n_items, 0.0) AS pred_naive, coalesce(s.n_items, 0.0) AS pred_snaive,
       coalesce(m.pred_ma, 0.0) AS pred_ma, t.train_end
FROM test t
LEFT JOIN bpanel n ON n.seller_id = t.seller_id AND n.day = t.train_end
LEFT JOIN bpanel s ON s.seller_id = t.seller_id
                  AND s.day = t.train_end - CAST(((-t.horizon) % 7 + 7) % 7 AS INTEGER)
LEFT JOIN ma m ON m.fold = t.fold AND m.seller_id = t.seller_id"""
TR_SQL = """
SELECT f.fold, p.seller_id, isodow(p.day) - 1 AS dow, p.n_items
FROM bpanel p JOIN folds f ON p.day <= f.train_end"""
Q_SQL = """
SELECT t.fold, t.seller_id, t.day, t.horizon, t.actual, t.train_end,
  CASE WHEN coalesce(a.n, 0) >= 3 THEN a.q WHEN coalesce(b.n, 0) >= 3 THEN b.q ELSE g.q END AS q
FROM test t
LEFT JOIN (SELECT fold, seller_id, dow, count(*) AS n, quantile_cont(n_items, [0.1, 0.5, 0.9]) AS q
           FROM tr GROUP BY ALL) a
  ON a.fold = t.fold AND a.seller_id = t.seller_id AND a.dow = isodow(t.day) - 1
LEFT JOIN (SELECT fold, seller_id, count(*) AS n, quantile_cont(n_items, [0.1, 0.5, 0.9]) AS q
           FROM tr GROUP BY ALL) b ON b.fold = t.fold AND b.seller_id = t.seller_id
LEFT JOIN (SELECT fold, quantile_cont(n_items, [0.1, 0.5, 0.9]) AS q FROM tr GROUP BY fold) g
  ON g.fold = t.fold"""
QR_SQL = """
SELECT fold, seller_id, day, horizon, actual, train_end,
  q[1] AS pred_p10_raw, q[2] AS pred_p50_raw, q[3] AS pred_p90_raw,
  greatest(list_sort(q)[1], 0.0) AS pred_p10, greatest(list_sort(q)[2], 0.0) AS pred_p50,
  greatest(list_sort(q)[3], 0.0) AS pred_p90,
  CASE WHEN q[1] > q[2] OR q[2] > q[3] THEN 1 ELSE 0 END AS crossing
FROM qraw"""
PRED_SQL = """
SELECT b.*, r.pred_p10_raw, r.pred_p50_raw, r.pred_p90_raw, r.pred_p10, r.pred_p50, r.pred_p90,
       r.crossing
FROM base b JOIN qr r USING (fold, seller_id, day)"""
ACTIVE_SQL = """
SELECT f.fold, p.seller_id,
       sum(p.n_items) / (datediff('day', f.calendar_start, f.train_end) + 1) AS train_mean
FROM bpanel p JOIN folds f ON p.day <= f.train_end
GROUP BY f.fold, p.seller_id, f.train_end, f.calendar_start
HAVING sum(p.n_items) / (datediff('day', f.calendar_start, f.train_end) + 1) >= 0.10"""
SCALE_SQL = """
SELECT f.fold, avg(abs(p.n_items - p.lag_7)) AS mase_scale
FROM bpanel p JOIN folds f ON p.day <= f.train_end GROUP BY f.fold"""
POINT_SQL = """
SELECT fold, model, avg(abs(actual - pred)) AS mae, sqrt(avg(pow(actual - pred, 2))) AS rmse,
  avg(coalesce(2.0 * abs(actual - pred) / nullif(abs(actual) + abs(pred), 0), 0.0)) AS smape,
  sum(abs(actual - pred)) / nullif(sum(abs(actual)), 0) AS wape, avg(pred - actual) AS bias
FROM (SELECT fold, actual, 'naive' AS model, pred_naive AS pred FROM preds
      UNION ALL SELECT fold, actual, 'snaive', pred_snaive FROM preds
      UNION ALL SELECT fold, actual, 'ma', pred_ma FROM preds
      UNION ALL SELECT fold, actual, 'q_p50', pred_p50 FROM preds) u
GROUP BY fold, model"""
QM_SQL = """
SELECT p.fold,
  avg(CASE WHEN actual >= pred_p10 AND actual <= pred_p90 THEN 1.0 ELSE 0.0 END) AS coverage,
  avg(CASE WHEN a.seller_id IS NOT NULL THEN
        CASE WHEN actual >= pred_p10 AND actual <= pred_p90 THEN 1.0 ELSE 0.0 END END) AS coverage_active,
  avg(CASE WHEN a.seller_id IS NOT NULL THEN 1.0 ELSE 0.0 END) AS active_share,
  avg(CASE WHEN actual = 0 THEN 1.0 ELSE 0.0 END) AS zero_actual_share,
  avg(CASE WHEN pred_p90 - pred_p10 < 1e-9 THEN 1.0 ELSE 0.0 END) AS degenerate_share,
  avg(pred_p90 - pred_p10) AS width,
  avg(greatest(0.1 * (actual - pred_p10), -0.9 * (actual - pred_p10))) AS pinball_p10,
  avg(greatest(0.5 * (actual - pred_p50), -0.5 * (actual - pred_p50))) AS pinball_p50,
  avg(greatest(0.9 * (actual - pred_p90), -0.1 * (actual - pred_p90))) AS pinball_p90,
  avg(CASE WHEN actual <= pred_p10 THEN 1.0 ELSE 0.0 END) AS coverage_p10_one_sided,
  avg(CASE WHEN actual <= pred_p90 THEN 1.0 ELSE 0.0 END) AS coverage_p90_one_sided,
  CAST(sum(crossing) AS DOUBLE) AS crossings
FROM preds p LEFT JOIN active a ON a.fold = p.fold AND a.seller_id = p.seller_id
GROUP BY p.fold"""
METRICS_SQL = """
SELECT fold, model, 'mae' AS metric, mae AS value FROM pm
UNION ALL SELECT fold, model, 'rmse', rmse FROM pm
UNION ALL SELECT fold, model, 'smape', smape FROM pm
UNION ALL SELECT fold, model, 'wape', wape FROM pm
UNION ALL SELECT fold, model, 'bias', bias FROM pm
UNION ALL SELECT pm.fold, model, 'mase', mae / nullif(s.mase_scale, 0) FROM pm JOIN scale s USING (fold)
UNION ALL SELECT fold, 'q', k, v FROM qm UNPIVOT (v FOR k IN (coverage, coverage_active, active_share,
  zero_actual_share, degenerate_share, width, pinball_p10, pinball_p50, pinball_p90,
  coverage_p10_one_sided, coverage_p90_one_sided, crossings))"""


def bt_ctes(**more):
    d = _dense_ctes()
    d.update(daily=DAILY_SQL, trail=TRAIL_SQL, cutoff=CUTOFF_SQL, bpanel=BPANEL_SQL,
             folds=FOLDS_SQL, test=TEST_SQL)
    d.update(more)
    return d


PRED_CTES = dict(ma=MA_SQL, base=BASE_SQL, tr=TR_SQL, qraw=Q_SQL, qr=QR_SQL, preds=PRED_SQL)

PRED_SPEC = ("fold:s seller_id:i day:d horizon:i actual:f pred_naive:f pred_snaive:f pred_ma:f "
             "pred_p10_raw:f pred_p50_raw:f pred_p90_raw:f pred_p10:f pred_p50:f pred_p90:f crossing:i")


@query("W6_trailing_median", "day:d total:f trail_median:f",
       cte(**_dense_ctes(), daily=DAILY_SQL, trail=TRAIL_SQL) + "\nSELECT * FROM trail",
       ops=("W6",))
def q_trailing_median(t):
    return P.trailing_median(P.daily_totals(demand(t), "day", "n_items"), "day", "total")


@query("F5_dead_zone_cutoff", "cutoff:d rows_kept:i rows_dropped:i",
       cte(**bt_ctes()) + """
SELECT c.cutoff, (SELECT count(*) FROM bpanel) AS rows_kept,
       (SELECT count(*) FROM dense) - (SELECT count(*) FROM bpanel) AS rows_dropped FROM cutoff c""",
       ops=("F5", "W6"))
def q_dead_zone(t):
    d = demand(t)
    cut = P.activity_cutoff(d)
    kept = P.truncate_dead_zone(d).agg(F.count(F.lit(1)).alias("rows_kept"))
    tot = d.agg(F.count(F.lit(1)).alias("_n"))
    return (cut.join(kept, how="inner").join(tot, how="inner")
            .select("cutoff", "rows_kept", (F.col("_n") - F.col("rows_kept")).alias("rows_dropped")))


@query("F6_folds", "fold:s train_end:d test_start:d test_end:d calendar_start:d",
       cte(**bt_ctes()) + "\nSELECT * FROM folds", ops=("F6",))
def q_folds(t):
    return bt_folds(bt_panel(t))


@query("F6_fold_split_counts", "fold:s role:s n_rows:i n_series:i",
       cte(**bt_ctes()) + """
SELECT f.fold, CASE WHEN p.day BETWEEN f.test_start AND f.test_end THEN 'test' ELSE 'train' END AS role,
       count(*) AS n_rows, count(DISTINCT p.seller_id) AS n_series
FROM bpanel p JOIN folds f ON p.day <= f.train_end OR p.day BETWEEN f.test_start AND f.test_end
GROUP BY ALL""", ops=("F6", "U1"))
def q_split_counts(t):
    p = bt_panel(t)
    return (FC.split(p, bt_folds(p)).groupBy("fold", "role")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(KEY).alias("n_series")))


@query("M1_M3_baselines", "fold:s seller_id:i day:d horizon:i actual:f pred_naive:f pred_snaive:f pred_ma:f",
       cte(**bt_ctes(ma=MA_SQL, base=BASE_SQL)) + "\nSELECT * FROM base",
       ops=("M1", "M2", "M3", "W10", "F6"))
def q_baselines(t):
    p = bt_panel(t)
    return FC.baselines(p, bt_folds(p), KEY)


@query("M2_seasonal_naive_mirrored", "fold:s seller_id:i day:d horizon:i pred_snaive:f",
       cte(**bt_ctes()) + """
SELECT t.fold, t.seller_id, t.day, t.horizon, coalesce(s.n_items, 0.0) AS pred_snaive
FROM test t LEFT JOIN bpanel s ON s.seller_id = t.seller_id
 AND s.day = t.train_end - CAST((t.horizon - 1) % 7 AS INTEGER)""", ops=("M2",))
def q_snaive_mirrored(t):
    p = bt_panel(t)
    return FC.baselines(p, bt_folds(p), KEY, mode="mirrored")


@query("M4_quantile_forecast", PRED_SPEC, cte(**bt_ctes(**PRED_CTES)) + "\nSELECT * FROM preds",
       ops=("M4", "M5", "M6", "W10", "J8"))
def q_quantiles(t):
    return predictions(t)


@query("A6_active_series", "fold:s seller_id:i train_mean:f",
       cte(**bt_ctes(active=ACTIVE_SQL)) + "\nSELECT * FROM active", ops=("A6",))
def q_active(t):
    return FC.training_stats(bt_activity(t), activity_folds(t), KEY)[1]


@query("E10_backtest_metrics", "fold:s model:s metric:s value:f",
       cte(**bt_ctes(**PRED_CTES, active=ACTIVE_SQL, scale=SCALE_SQL, pm=POINT_SQL, qm=QM_SQL))
       + METRICS_SQL,
       ops=("E1", "E2", "E3", "E4", "E5", "E6", "E7", "E8", "E9", "E10", "M6"))
def q_metrics(t):
    scales, active = FC.training_stats(bt_activity(t), activity_folds(t), KEY)
    return FC.backtest_metrics(predictions(t), scales, active, KEY)


# Learned quantiles of the units that a seller ships in a week. What a row sees
# of them is at least a horizon old; four rolling folds of eight weeks.
LEARN_AHEAD = 8
LEARN_WEEKS = 104         # training weeks before a fold's train end
LEARN_FOLDS = [(f"fold_{k + 1}", 8 * (4 - k), 8 * (4 - k) - 1, 8 * (3 - k)) for k in range(4)]
LEARN_FEATURES = [*(f"lag_{LEARN_AHEAD + k}" for k in (0, 1, 4)), *(f"roll_{s}_{k}" for k in (4, 12) for s in ("mean", "std")),
                  "level", "month"]


def units(t):
    """Weekly units per seller, dense, up to the last whole week before the origin."""
    def build():
        end = F.to_date(F.lit(ORIGIN))
        week = F.to_date(F.date_trunc("week", "l_shipdate"))
        u = t["lineitem"].where(F.date_add(week, 6) <= end).groupBy(F.col("l_suppkey").alias(KEY), week.alias("week")).agg(
            F.sum("l_quantity").alias("units"))
        last = F.to_date(F.date_trunc("week", F.date_sub(end, 6)))
        return materialize(P.densify(u, last, KEY, day="week", y="units", carry=(), step_days=7), "units")
    return t.memo("units", build)


def learned(t):
    """Quantiles of boosted trees and, with the suffix _emp, of each seller's
    own history, for every test week of every fold."""
    def build():
        p = units(t)
        fold = FC.folds(p, "week", LEARN_FOLDS, 7)
        rows = P.direct_features(p, KEY, "week", "units", LEARN_AHEAD, lags=(0, 1, 4), windows=(4, 12))
        rows = P.add_level(rows, KEY, "week", "units", "level", LEARN_AHEAD).withColumn("month", F.month("week"))
        rows = materialize(rows, "learned-panel")
        tagged = FC.split(rows, fold, "week", lookback=LEARN_WEEKS * 7)
        model = QB.fit(tagged.where("role = 'train'"), "fold", "units", LEARN_FEATURES)
        raw = [f"pred_p{k}_raw" for k in (10, 50, 90)]
        out = FC.rearrange(model.predict(tagged.where("role = 'test'"), "fold", raw))
        own = FC.backtest_predictions(p, fold, KEY, "week", "units", lookback=LEARN_WEEKS, season=4, window=8, step_days=7,
                                      slot=F.lit(0), cycle=1).select("fold", KEY, "week", *[F.col(f"pred_p{k}").alias(f"emp_p{k}") for k in (10, 50, 90)])
        return materialize(out.select("fold", KEY, "week", F.col("units").alias("actual"), "pred_p10", "pred_p50", "pred_p90", "crossing")
                           .join(own, ["fold", KEY, "week"]), "learned")
    return t.memo("learned", build)


@query("M4_learned_quantiles", "fold:s seller_id:i week:d actual:f pred_p10:f pred_p50:f pred_p90:f crossing:i", None,
       ops=("M4", "M5", "M6"))
def q_learned(t):
    return learned(t)


@query("M4_learned_against_empirical", "fold:s model:s rows:i coverage:f width:f pinball_p10:f pinball_p50:f pinball_p90:f", None,
       ops=("M4", "E4", "E5", "E9"))
def q_learned_metrics(t):
    a = F.col("actual")
    both = learned(t).select("fold", "actual", F.explode(F.array(*[F.struct(
        F.lit(name).alias("model"), *[F.col(f"{column}_p{k}").alias(f"p{k}") for k in (10, 50, 90)])
        for name, column in (("learned", "pred"), ("empirical", "emp"))])).alias("m")).select("fold", "actual", "m.*")
    return both.groupBy("fold", "model").agg(
        F.count(F.lit(1)).alias("rows"), M.coverage(a, "p10", "p90").alias("coverage"), M.interval_width("p10", "p90").alias("width"),
        *[M.pinball(a, f"p{k}", k / 100).alias(f"pinball_p{k}") for k in (10, 50, 90)])


ORIGINS, ORIGIN_STEP, ORIGIN_TRAIN, ORIGIN_TEST = 100, 7, 56, 14


@query("F6_rolling_origins", "origin:i train_end:d role:s n_rows:i n_series:i total:f", cte(**bt_ctes()) + f"""
, o AS (SELECT k AS origin, CAST(m.last_day - CAST(k * {ORIGIN_STEP} + {ORIGIN_TEST} AS INTEGER) AS DATE) AS train_end
        FROM (SELECT max(day) AS last_day FROM bpanel) m, range({ORIGINS}) r(k)),
i AS (SELECT origin, train_end, 'train' AS role, train_end - {ORIGIN_TRAIN - 1} AS a, train_end AS b FROM o
      UNION ALL SELECT origin, train_end, 'test', train_end + 1, train_end + {ORIGIN_TEST} FROM o)
SELECT origin, train_end, role, count(*) AS n_rows, count(DISTINCT seller_id) AS n_series, sum(n_items) AS total
FROM bpanel p JOIN i ON p.day BETWEEN i.a AND i.b GROUP BY ALL""", ops=("F6",))
def q_rolling_origins(t):
    """Train and test rows of a hundred weekly origins from one binned join."""
    p = bt_panel(t)
    i = FC.rolling_origins(p, ORIGINS, ORIGIN_STEP, ORIGIN_TRAIN, ORIGIN_TEST)
    return FC.interval_join(p, i).groupBy("origin", "train_end", "role").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(KEY).alias("n_series"), F.sum("n_items").alias("total"))
