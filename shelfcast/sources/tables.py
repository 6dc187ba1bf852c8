"""Parquet scans of the input tables (C3), row counts (C1/A23) and schema
introspection (C10)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
                 "lineitem", "events")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_tables(spark: SparkSession, sf_dir: str, names=DRIVER_TABLES) -> dict[str, DataFrame]:
    return {n: read_table(spark, sf_dir, n) for n in names}


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One ``(table_name, n_rows)`` row per table: a union of global counts,
    each a partial+final aggregate, executed as a single job."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows"))
               .select(F.lit(name).alias("table_name"), "n_rows")
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def schema_rows(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """DESCRIBE for every table as rows ``(table_name, column_name, ordinal,
    data_type)``. Metadata only: no data is scanned."""
    rows = [(name, f.name, i + 1, f.dataType.simpleString())
            for name, df in tables.items() for i, f in enumerate(df.schema.fields)]
    schema = T.StructType([T.StructField("table_name", T.StringType()),
                           T.StructField("column_name", T.StringType()),
                           T.StructField("ordinal", T.LongType()),
                           T.StructField("data_type", T.StringType())])
    return spark.createDataFrame(rows, schema)


def sample_rows(df: DataFrame, n: int = 3, order_by=None) -> DataFrame:
    """``LIMIT n`` peek; with ``order_by`` it is deterministic (TakeOrdered)."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)
