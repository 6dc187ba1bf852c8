"""Data-quality checks as ordinary aggregates.

Each check is one aggregate pass; per-column checks are evaluated together
in a single ``agg`` and unpivoted, never one scan per column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .ordering import quantiles


def _unpivot(df: DataFrame, ids, cols, var: str, val: str) -> DataFrame:
    return df.unpivot(list(ids), list(cols), var, val)


def null_counts(df: DataFrame, table: str, allow=()) -> DataFrame:
    """NULL count and % per column in one pass; ``allowed`` marks columns
    where NULLs are expected."""
    n = df.agg(F.count(F.lit(1)).alias("_rows"),
               *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = _unpivot(n, ["_rows"], df.columns, "column_name", "n_nulls")
    return long.select(F.lit(table).alias("table_name"), "column_name", "n_nulls",
                       (F.lit(100.0) * F.col("n_nulls") / F.greatest(F.col("_rows"), F.lit(1)))
                       .alias("pct_nulls"),
                       F.col("column_name").isin(*allow).alias("allowed"))


def duplicate_groups(df: DataFrame, keys, table: str, check: str) -> DataFrame:
    """Number of key groups occurring more than once, and the rows in
    them (exact duplicates when ``keys`` is every column)."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return g.agg(F.count(F.lit(1)).alias("dup_groups"),
                 F.coalesce(F.sum("_n"), F.lit(0)).alias("dup_rows")).select(
        F.lit(table).alias("table_name"), F.lit(check).alias("check_name"), "dup_groups", "dup_rows")


def count_violations(df: DataFrame, rules: dict[str, Column], table: str) -> DataFrame:
    """One ``count_if`` per rule in one pass, plus % of rows; a NULL
    rule value counts as a pass."""
    a = df.agg(F.count(F.lit(1)).alias("_rows"),
               *[F.count_if(F.coalesce(~cond, F.lit(False))).alias(name) for name, cond in rules.items()])
    long = _unpivot(a, ["_rows"], list(rules), "rule", "violations")
    return long.select(F.lit(table).alias("table_name"), "rule", "violations",
                       (F.lit(100.0) * F.col("violations") / F.greatest("_rows", F.lit(1))).alias("pct"))


def all_orphans(tables: dict[str, DataFrame], relations: list[tuple[str, str, str, str, str]]) -> DataFrame:
    """D7/J6 for many relations (name, child table, its key, parent table, its
    key) at once: one scan of each child deals its keys out by relation, the
    parents' keys join them in one union, and one aggregate by (relation, key)
    finds the keys without a parent. Keys are counted before the shuffle, so a
    hot key costs a row for each task. A null key is an orphan."""
    spark = next(iter(tables.values())).sparkSession
    key = lambda c: F.col(c).cast("string").alias("key")

    def side(of: int, column: int, rows: int):
        for table in dict.fromkeys(r[of] for r in relations):
            own = [F.struct(F.lit(r[0]).alias("relation"), key(r[column])) for r in relations if r[of] == table]
            yield tables[table].select(F.inline(F.array(*own))).withColumns({"n": F.lit(rows), "parents": F.lit(1 - rows)})

    parents = [d.where("key IS NOT NULL") for d in side(3, 4, 0)]
    keys = reduce(DataFrame.unionByName, [*side(1, 2, 1), *parents]).groupBy("relation", "key").agg(
        F.sum("n").alias("n"), F.max("parents").alias("parents"))
    found = keys.where("parents = 0").groupBy("relation").agg(F.sum("n").alias("n"))
    names = spark.createDataFrame([(r[0],) for r in relations], "relation string")
    return names.join(found, "relation", "left").select("relation", F.coalesce("n", F.lit(0)).alias("orphans"))


def continuity(panel: DataFrame, keys, date: str, step_days: int = 7) -> DataFrame:
    """Series count, date range and steps that are not exactly
    ``step_days`` apart (``datediff(d, lag(d))``)."""
    w = Window.partitionBy(*keys).orderBy(date)
    gap = F.datediff(F.col(date), F.lag(date).over(w))
    staged = panel.select(*keys, date, gap.alias("_gap"))
    return staged.agg(F.count_distinct(*[F.col(k) for k in keys]).alias("n_series"),
                      F.min(date).alias("min_date"), F.max(date).alias("max_date"),
                      F.count_if(F.col("_gap").isNotNull() & (F.col("_gap") != step_days))
                      .alias("bad_steps"))


def distribution(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Per measure mean, sample std, p10/p50/p90, % negative (early) and
    % positive (late). Measures are unpivoted so one grouped aggregate covers
    all of them. Rows are counted by value first, so a measure costs one row
    per distinct value after the shuffle, not one per input row."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("stage"), v.cast("double").alias("v"))
                                         for k, v in measures.items()])).alias("_s")).select("_s.*")
    counts = long.filter(F.col("v").isNotNull()).groupBy("stage", "v").agg(F.count(F.lit(1)).alias("n"))
    v, n = F.col("v"), F.col("n")
    total, s1, s2 = F.sum(n), F.sum(n * v), F.sum(n * v * v)
    share = lambda c: F.lit(100.0) * F.sum(F.when(c, n).otherwise(0)) / total
    return counts.groupBy("stage").agg(
        (s1 / total).alias("mean"),
        F.when(total > 1, F.sqrt(F.greatest(F.lit(0.0), (s2 - s1 * s1 / total) / (total - 1)))).alias("std"),
        *[F.percentile(v, F.lit(q), n).alias(f"p{round(q * 100)}") for q in (0.1, 0.5, 0.9)],
        share(v < 0).alias("pct_early"), share(v > 0).alias("pct_late"))


def autocorrelation(panel: DataFrame, key: str, day: str, y: str, lags=(1, 7),
                    min_span: int = 30) -> DataFrame:
    """Lag-k autocorrelation per series (span >= ``min_span`` days),
    then mean / median / std across series. NULL for constant series."""
    w = Window.partitionBy(key).orderBy(day)
    staged = panel.select(key, day, y, *[F.lag(y, k).over(w).alias(f"_l{k}") for k in lags])
    per = (staged.groupBy(key)
           .agg((F.datediff(F.max(day), F.min(day)) + 1).alias("_span"),
                *[F.corr(y, f"_l{k}").alias(f"ac_{k}") for k in lags])
           .filter(F.col("_span") >= min_span))
    long = materialize(per.select(F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"ac_{k}").alias("ac"))
                                                      for k in lags])).alias("_a")).select("_a.*"), "autocorrelation")
    stats = long.groupBy("lag").agg(F.avg("ac").alias("mean_ac"), F.stddev_samp("ac").alias("std_ac"),
                                    F.count("ac").alias("n_series"))
    medians = quantiles(long, "ac", 0.5, ("lag",)).withColumnRenamed("quantile", "median_ac")
    return stats.join(medians, "lag", "left")


def global_autocorrelation(daily: DataFrame, day: str, y: str, lags=(1, 7)) -> DataFrame:
    """Autocorrelation of the whole-market daily total (one row per day;
    the unpartitioned window is bounded by the calendar)."""
    w = Window.orderBy(day)
    s = daily.select(y, *[F.lag(y, k).over(w).alias(f"_l{k}") for k in lags])
    return s.select(F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_l{k}").alias("x"))
                                        for k in lags])).alias("_a"), y) \
        .groupBy(F.col("_a.lag").alias("lag")).agg(F.corr(y, "_a.x").alias("ac"))


def event_time_ranges(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Min / max of each event-time column (NULLs ignored)."""
    parts = []
    for name, (df, cols) in tables.items():
        a = df.agg(*[F.struct(F.min(c).cast("timestamp_ntz").alias("mn"),
                              F.max(c).cast("timestamp_ntz").alias("mx")).alias(c) for c in cols])
        parts.append(a.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"),
                                                            F.col(f"`{c}`.mn").alias("min_value"),
                                                            F.col(f"`{c}`.mx").alias("max_value"))
                                                   for c in cols])).alias("_r"))
                     .select(F.lit(name).alias("table_name"), "_r.*"))
    return reduce(DataFrame.unionByName, parts)


def checks_report(counts: dict[str, DataFrame]) -> DataFrame:
    """One row per check -- status PASSED if its one-row ``violations`` is 0 --
    and a row ``overall`` that passes if every check does."""
    rows = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("check_name"), F.col("violations").cast("long"))
                                          for name, df in counts.items()])
    both = rows.select(F.explode(F.array("check_name", F.lit("overall"))).alias("check_name"), "violations")
    return both.groupBy("check_name").agg(F.sum("violations").alias("violations")).withColumn(
        "status", F.when(F.col("violations") == 0, F.lit("PASSED")).otherwise(F.lit("FAILED"))).withColumn(
        "details", F.concat(F.col("violations").cast("string"), F.lit(" violations")))


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """How many rows only one of two tables has, repeats counted: a signed
    union added up by whole rows (one shuffle, map-side partial sums)."""
    both = left.withColumn("_sign", F.lit(1)).unionByName(right.withColumn("_sign", F.lit(-1)))
    kept = both.groupBy(*[f"`{c}`" for c in left.columns]).agg(F.sum("_sign").alias("_sign"))
    more, less = F.greatest("_sign", F.lit(0)), F.greatest(-F.col("_sign"), F.lit(0))
    return kept.agg(F.coalesce(F.sum(more), F.lit(0)).alias("left_only"), F.coalesce(F.sum(less), F.lit(0)).alias("right_only"))


# Sketch sizes and the errors they answer for (about three standard errors):
# 2^12 registers, 1.04 / sqrt(2^12) = 1.6 % each; k = 200, rank error 1.3 %.
HLL_LG, HLL_ERROR = 12, 0.05
KLL_K, KLL_RANK_ERROR = 200, 0.03


def daily_sketches(df: DataFrame, day: Column, distinct: str, value: str) -> DataFrame:
    """A24/A25 at scale: per day a mergeable sketch of the distinct values of
    one column and one of the distribution of another: a few kilobytes a day,
    stored once and read by every report, whatever its period."""
    return df.groupBy(day.alias("day")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.hll_sketch_agg(distinct, HLL_LG).alias("distinct_sketch"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_K).alias("value_sketch"))


def merged_sketches(daily: DataFrame, period: Column, name: str, quantiles=(0.1, 0.5, 0.9)) -> DataFrame:
    """Days' sketches merged by period: rows, estimated distinct values and
    quantiles; the input rows are not read again."""
    merged = daily.groupBy(period.alias(name)).agg(
        F.sum("n_rows").alias("n_rows"), F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("n_distinct"),
        F.kll_merge_agg_double("value_sketch", KLL_K).alias("_kll"))
    return merged.select(name, "n_rows", "n_distinct", *[
        F.kll_sketch_get_quantile_double("_kll", F.lit(q)).alias(f"p{round(q * 100)}") for q in quantiles])
