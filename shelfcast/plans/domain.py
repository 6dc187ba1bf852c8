"""How the driver tables play the application's roles, in Spark and in SQL.

* order header / purchase time: ``orders.o_orderdate``; delivered = status 'F'
* order line, series key (seller): ``lineitem.l_suppkey``; product: ``l_partkey``
* carrier hand-off and customer delivery: ``l_shipdate``
* unit price: ``l_extendedprice / l_quantity``; freight: ``l_tax``
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed parameters of the registered jobs.
ORIGIN = "2001-06-30"          # forecast origin of the daily panel
KEY = "seller_id"
DELIVERED = "F"
LT_COLS = dict(status="order_status", delivered_value=DELIVERED, purchase="purchase_ts",
               approved="approved_ts", carrier="carrier_ts", delivered="delivered_ts")


def order_lines(t) -> DataFrame:
    """Order lines joined N:1 to their order header (sort-merge on the
    order key at scale; AQE may switch to broadcast for small headers)."""
    li, o = t["lineitem"], t["orders"]
    return (li.join(o, li.l_orderkey == o.o_orderkey, "inner")
            .select(F.col("l_orderkey").alias("order_id"),
                    F.col("l_linenumber").alias("line_no"),
                    F.col("l_suppkey").alias("seller_id"),
                    F.col("l_partkey").alias("product_id"),
                    F.col("o_orderstatus").alias("order_status"),
                    F.col("o_orderdate").alias("purchase_ts"),
                    F.col("o_orderdate").alias("approved_ts"),
                    F.col("l_shipdate").alias("carrier_ts"),
                    F.col("l_shipdate").alias("delivered_ts"),
                    (F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0)))
                    .alias("price"),
                    F.col("l_tax").alias("freight")))


LINES_SQL = """
SELECT l.l_orderkey AS order_id, l.l_linenumber AS line_no, l.l_suppkey AS seller_id,
       l.l_partkey AS product_id, o.o_orderstatus AS order_status,
       o.o_orderdate AS purchase_ts, o.o_orderdate AS approved_ts,
       l.l_shipdate AS carrier_ts, l.l_shipdate AS delivered_ts,
       l.l_extendedprice / nullif(l.l_quantity, 0) AS price, l.l_tax AS freight
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"""

ORIGIN_SQL = f"DATE '{ORIGIN}'"
ORIGIN_END_SQL = f"CAST(DATE '{ORIGIN}' + INTERVAL 1 DAY AS TIMESTAMP)"
VALID_SEQ_SQL = ("approved_ts IS NOT NULL AND carrier_ts IS NOT NULL AND approved_ts >= purchase_ts "
                 "AND carrier_ts >= approved_ts AND delivered_ts >= carrier_ts")
