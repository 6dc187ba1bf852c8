"""Panel and feature jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panel as P
from .domain import (KEY, LINES_SQL, LT_COLS, ORIGIN, ORIGIN_END_SQL, ORIGIN_SQL,
                     VALID_SEQ_SQL, order_lines)
from ..session import materialize
from .registry import cte, query

FEATURE_SPEC = ("seller_id:i day:d n_items:f avg_price:f avg_freight:f lag_1:f lag_7:f lag_14:f "
                "lag_28:f roll_mean_7:f roll_std_7:f roll_mean_28:f roll_std_28:f day_of_week:i "
                "is_weekend:i month:i is_holiday:i price_over_freight_ratio:f lt_mean:f lt_std:f "
                "lt_p50:f lt_p90:f lt_n:i")


def line_aggs(t, origin=ORIGIN):
    """Activity and lead-time histogram at the origin from one pass over the
    joined lines, written once; the panel, the backtest and the plan read it."""
    return t.memo(f"line_aggs_{origin}", lambda: materialize(
        P.line_aggregates(order_lines(t), origin, KEY, "purchase_ts", "price", "freight", **LT_COLS),
        "line_aggs"))


def features(t, origin=ORIGIN):
    g = line_aggs(t, origin)
    return P.features_from(P.activity_from(g, KEY), P.histogram_from(g, KEY), origin, KEY,
                           holidays=P.holiday_table(t.spark))


# ---------------------------------------------------------------- SQL pieces
ACT_SQL = f"""
SELECT seller_id, CAST(purchase_ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS n_items,
       avg(price) AS avg_price, avg(freight) AS avg_freight
FROM lines WHERE purchase_ts < {ORIGIN_END_SQL}
GROUP BY seller_id, CAST(purchase_ts AS DATE)"""

# brute force: a full calendar per series, left-joined to the activity
GRID_SQL = f"""
SELECT s.seller_id, CAST(g.d AS DATE) AS day
FROM (SELECT seller_id, min(day) AS d0 FROM act GROUP BY seller_id) s,
     LATERAL generate_series(CAST(s.d0 AS TIMESTAMP), CAST({ORIGIN_SQL} AS TIMESTAMP),
                             INTERVAL 1 DAY) g(d)"""

DENSE_SQL = """
SELECT g.seller_id, g.day, coalesce(a.n_items, 0.0) AS n_items, a.avg_price, a.avg_freight
FROM grid g LEFT JOIN act a ON a.seller_id = g.seller_id AND a.day = g.day"""

LT_SQL = f"""
SELECT seller_id, avg(lt_days) AS lt_mean, stddev_samp(lt_days) AS lt_std,
       quantile_cont(lt_days, 0.5) AS lt_p50, quantile_cont(lt_days, 0.9) AS lt_p90,
       count(*) AS lt_n
FROM (SELECT seller_id,
             (epoch_us(delivered_ts) - epoch_us(purchase_ts)) / 86400e6 AS lt_days
      FROM lines
      WHERE order_status = 'F' AND purchase_ts < {ORIGIN_END_SQL}
        AND delivered_ts < {ORIGIN_END_SQL} AND {VALID_SEQ_SQL}) x
GROUP BY seller_id"""

HOL_SQL = "SELECT * FROM (VALUES (1,1),(4,21),(5,1),(9,7),(10,12),(11,2),(11,15),(12,25)) h(h_month, h_dom)"


def _roll(k):
    fr = f"(PARTITION BY seller_id ORDER BY day ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    return (f"CASE WHEN count(n_items) OVER {fr} = {k} THEN avg(n_items) OVER {fr} END AS roll_mean_{k},\n"
            f"CASE WHEN count(n_items) OVER {fr} = {k} THEN stddev_samp(n_items) OVER {fr} END AS roll_std_{k}")


FEAT_SQL = f"""
SELECT d.*,
  lag(n_items, 1) OVER w AS lag_1, lag(n_items, 7) OVER w AS lag_7,
  lag(n_items, 14) OVER w AS lag_14, lag(n_items, 28) OVER w AS lag_28,
  {_roll(7)},
  {_roll(28)},
  isodow(day) - 1 AS day_of_week, CASE WHEN isodow(day) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  month(day) AS month,
  CASE WHEN EXISTS (SELECT 1 FROM hol WHERE h_month = month(d.day) AND h_dom = day(d.day))
       THEN 1 ELSE 0 END AS is_holiday,
  avg_price / nullif(avg_freight, 0) AS price_over_freight_ratio
FROM dense d
WINDOW w AS (PARTITION BY seller_id ORDER BY day)"""

PANEL_SQL = """
SELECT f.*, lt.lt_mean, lt.lt_std, lt.lt_p50, lt.lt_p90, coalesce(lt.lt_n, 0) AS lt_n
FROM feat f LEFT JOIN lt USING (seller_id)"""

FEATURE_CTES = dict(lines=LINES_SQL, act=ACT_SQL, grid=GRID_SQL, dense=DENSE_SQL, hol=HOL_SQL,
                    feat=FEAT_SQL, lt=LT_SQL, panel=PANEL_SQL)


@query("panel_features", FEATURE_SPEC,
       cte(**FEATURE_CTES) + "\nSELECT * FROM panel",
       ops=("C3", "J1", "F1", "A1", "P2", "J7", "W1", "W2", "W4", "W5", "W9", "A2", "F3", "F4",
            "J3", "S1", "S2", "O2"))
def q_panel_features(t):
    return features(t)


# The computus once more, by its other usual form (remainders of the year).
EASTER_SQL = """
SELECT y, make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS easter
FROM (SELECT *, (a + 11 * h + 22 * l) // 451 AS m
  FROM (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l
    FROM (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h
      FROM (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM years))))"""


@query("W5_movable_holidays", "day:d feast:s n_orders:i total:f other_share:f", """
WITH years AS (SELECT DISTINCT CAST(year(o_orderdate) + k AS INTEGER) AS y
               FROM orders, range(-15, 16) r(k) WHERE o_orderdate IS NOT NULL),
e AS (""" + EASTER_SQL + """),
f AS (SELECT CAST(easter + n AS DATE) AS day, feast FROM e, (VALUES ('carnival', -47), ('good_friday', -2), ('easter', 0),
      ('corpus_christi', 60)) v(feast, n)),
o AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n_orders, sum(o_totalprice) AS total FROM orders GROUP BY 1)
SELECT f.day, f.feast, coalesce(o.n_orders, 0) AS n_orders, o.total,
  coalesce(o.n_orders, 0) / nullif((SELECT avg(n_orders) FROM o), 0) AS other_share
FROM f LEFT JOIN o USING (day)""", ops=("W5",))
def q_movable_holidays(t):
    """Orders on the movable feasts of every year of the table and of fifteen
    years around it, against the mean day."""
    o = t["orders"].where("o_orderdate IS NOT NULL").groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("total"))
    years = o.select(F.explode(F.sequence(F.year("day") - 15, F.year("day") + 15)).alias("year")).distinct()
    feasts = F.array(*[F.struct(F.date_add(P.easter(F.col("year")), n).alias("day"), F.lit(name).alias("feast"))
                       for name, n in P.MOVABLE_FEASTS.items()])
    mean = o.agg(F.avg("n_orders").alias("mean_orders"))
    n = F.coalesce("n_orders", F.lit(0))
    return (years.select(F.inline(feasts)).join(o, "day", "left").join(F.broadcast(mean), how="inner")
            .select("day", "feast", n.alias("n_orders"), "total", F.try_divide(n, F.col("mean_orders")).alias("other_share")))
