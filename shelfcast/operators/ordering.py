"""Ranks and running sums in one global order without a one-task window.

Rows are range-partitioned by the order and written once; a running sum is
then a window inside each part plus the total of the parts before it. What is
added up over parts has one row per part, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def running(df: DataFrame, order: list[Column], by: tuple[str, ...] = (), rank: str | None = None,
            before: dict[str, str] | None = None) -> DataFrame:
    """Adds ``rank`` (1, 2, ... within ``by``) and, for every ``out: value`` of
    ``before``, the sum of ``value`` over the rows strictly before (0 for the
    first). ``order`` must be total within ``by``; nulls in ``value`` count 0."""
    before = before or {}
    keys = [F.col(c) for c in by]
    laid = materialize(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    totals = laid.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"),
                                            *[F.coalesce(F.sum(v), F.lit(0.0)).alias(f"_t_{o}") for o, v in before.items()])
    parts = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_part", *[F.coalesce(F.sum(c).over(parts), F.lit(0)).alias(f"_o{c}")
                                            for c in totals.columns if c not in by and c != "_part"])
    inside = Window.partitionBy(*by, "_part").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = laid.join(offsets, [*by, "_part"])
    if rank:
        out = out.withColumn(rank, (F.row_number().over(inside) + F.col("_o_n")).cast("long"))
    for o, v in before.items():
        out = out.withColumn(o, F.coalesce(F.sum(v).over(upto), F.lit(0.0)) + F.col(f"_o_t_{o}"))
    return out.drop("_part", *[c for c in offsets.columns if c.startswith("_o")])


def quantiles(df: DataFrame, value: str, q: float, by: tuple[str, ...]) -> DataFrame:
    """``by`` and ``quantile``: the exact ``q``-quantile of ``value`` (linear
    interpolation, nulls ignored) in each group, for groups of any size: values
    are counted, ranked over range partitions, and only the two that enclose
    the quantile's position meet in one task."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"))
    placed = running(counts, [F.asc("_v")], by, before={"_before": "_n"})
    size = counts.groupBy(*by).agg(((F.sum("_n") - 1) * F.lit(float(q))).alias("_at"))
    at = placed.join(size, list(by))
    value_at = lambda p: F.max(F.when((F.col("_before") <= p) & (p < F.col("_before") + F.col("_n")), F.col("_v")))
    lo, hi = F.floor("_at"), F.ceil("_at")
    near = at.where((F.col("_before") <= hi) & (lo < F.col("_before") + F.col("_n")))
    out = near.groupBy(*by, "_at").agg(value_at(lo).alias("_lo"), value_at(hi).alias("_hi"))
    return out.select(*by, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_at") - F.floor("_at"))).alias("quantile"))
