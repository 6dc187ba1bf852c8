"""File sources and sinks.

Schemas are declared, never inferred: inference costs an extra pass over
the data and can change column semantics (a Yes/No column read as boolean).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, L, D, TS = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampNTZType()


def _schema(*cols):
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


# Column layouts of the order-lifecycle raw tables.
ORDER_LIFECYCLE_SCHEMAS = {
    "orders": _schema(("order_id", S), ("customer_id", S), ("order_status", S),
                      ("order_purchase_timestamp", TS), ("order_approved_at", TS),
                      ("order_delivered_carrier_date", TS),
                      ("order_delivered_customer_date", TS),
                      ("order_estimated_delivery_date", TS)),
    "order_items": _schema(("order_id", S), ("order_item_id", L), ("product_id", S),
                           ("seller_id", S), ("shipping_limit_date", TS),
                           ("price", D), ("freight_value", D)),
}

# Column layouts of the parts-track raw tables.
PARTS_SCHEMAS = {
    "parts_master": _schema(("part_id", S), ("part_family", S), ("criticality_class", S),
                            ("unit_cost", D), ("lead_time_days", L),
                            ("supplier_id_primary", S), ("supplier_risk_class", S),
                            ("is_repairable", S), ("shelf_life_days", T.IntegerType())),
    "purchase_orders": _schema(("po_id", S), ("supplier_id", S), ("site_id", S),
                               ("part_id", S), ("order_date", T.DateType()),
                               ("promised_date", T.DateType()),
                               ("receipt_date", T.DateType()), ("ordered_qty", L),
                               ("received_qty", L)),
    "quality_incidents": _schema(("incident_id", S), ("incident_date", T.DateType()),
                                 ("part_id", S), ("supplier_id", S), ("site_id", S),
                                 ("defect_severity", S), ("defect_type", S),
                                 ("scrap_qty", L)),
    "supply_chain_history": _schema(("date", T.DateType()), ("site_id", S), ("part_id", S),
                                    ("planned_maintenance", T.BooleanType()),
                                    ("consumption_qty", L), ("on_hand_qty", L),
                                    ("backorder_qty", L), ("blocked_qty", L),
                                    ("forecast_qty", L), ("forecast_type", S),
                                    ("forecast_uplift_pct", D)),
}


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType,
                   date_cols=(), empty_as_null: bool = True) -> DataFrame:
    """CSV scan with a declared schema (C4); ``date_cols`` are parsed with
    ``to_date`` after the scan so bad values become NULL, not errors."""
    r = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
    if empty_as_null:
        r = r.option("nullValue", "").option("emptyValue", None)
    df = r.csv(path)
    for c in date_cols:
        df = df.withColumn(c, F.to_date(F.col(c)))
    return df


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """C1/C2 with rejects: (accepted rows with the declared types, rejects with
    ``record``, the line as read, and ``reasons``). A line is rejected if it
    has not as many fields as the schema, or names of columns whose text is no
    value of their type are its reasons; empty fields are null. Accepted and
    rejected rows together are all lines. The file is read as text columns
    once per side; nothing is inferred."""
    text = T.StructType([T.StructField(f.name, S) for f in schema] + [T.StructField("_line", S)])
    raw = (spark.read.schema(text).option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line")
           .option("columnPruning", False).option("nullValue", "").csv(path))
    bad = [F.when(F.col(f"`{f.name}`").isNotNull() & F.col(f"`{f.name}`").try_cast(f.dataType).isNull(), F.lit(f.name)) for f in schema]
    wrong = F.when(F.col("_line").isNotNull(), F.array(F.lit("number of fields"))).otherwise(
        F.filter(F.array(*bad), lambda x: x.isNotNull()))
    judged = raw.withColumn("_reasons", wrong)
    line = F.coalesce("_line", F.to_csv(F.struct(*[F.col(f"`{f.name}`") for f in schema])))
    return (judged.where(F.size("_reasons") == 0).select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema]),
            judged.where(F.size("_reasons") > 0).select(line.alias("record"), F.col("_reasons").alias("reasons")))


def read_json_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON array of records (C5): multi-line, declared schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on its own file system, local or shared."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_csv_dir(spark: SparkSession, raw_dir: str, files: dict[str, str],
                 schemas: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """Name → file map load (C1/C2). A missing file is an error, as in the
    source application; tables are returned lazily (no scan yet)."""
    out = {}
    for name, fname in files.items():
        path = f"{raw_dir.rstrip('/')}/{fname}"
        if not path_exists(spark, path):
            raise FileNotFoundError(path)
        out[name] = read_csv_table(spark, path, schemas[name])
    return out


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by=None, **options) -> str:
    """Artifact sink (C6/U5): parquet/csv/json with overwrite, append or
    errorifexists. ``partition_by`` (e.g. a month column) enables partition
    pruning for readers; ``options`` are the writer's."""
    w = df.write.mode(mode).options(**options)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    getattr(w, fmt)(path)
    return path


def bulk_load(spark: SparkSession, seed_dir: str, load_order: list[str],
              schemas: dict[str, T.StructType], target_dir: str, reset: bool = False) -> DataFrame:
    """Seed CSVs in foreign-key order (C7): empty string = NULL; refuse to
    overwrite a non-empty target unless ``reset``; returns per-table counts
    of what was written."""
    from functools import reduce
    parts = []
    for name in load_order:
        df = read_csv_table(spark, f"{seed_dir.rstrip('/')}/{name}.csv", schemas[name])
        dest = f"{target_dir.rstrip('/')}/{name}"
        write_table(df, dest, mode="overwrite" if reset else "errorifexists")
        parts.append(spark.read.parquet(dest).agg(F.count(F.lit(1)).alias("n_rows"))
                     .select(F.lit(name).alias("table_name"), "n_rows"))
    return reduce(DataFrame.unionByName, parts)
