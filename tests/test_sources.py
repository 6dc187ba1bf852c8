"""File sources and sinks."""

import json
import os
import tempfile

import pytest
from pyspark.sql import types as T

from shelfcast.sources.files import bulk_load, load_csv_dir, read_csv_table, read_json_records, write_table
from shelfcast.sources.tables import read_table, table_counts
from tests.conftest import SF001


def test_json_array_of_records(spark):
    nation = read_table(spark, SF001, "nation").orderBy("n_nationkey").toPandas()
    d = tempfile.mkdtemp(prefix="shelfcast-test-")
    path = os.path.join(d, "nation.json")
    with open(path, "w") as f:
        json.dump(nation.to_dict("records"), f, indent=2)
    schema = T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType()),
                           T.StructField("n_regionkey", T.IntegerType())])
    got = read_json_records(spark, path, schema).orderBy("n_nationkey").toPandas()
    assert got.equals(nation[["n_nationkey", "n_name", "n_regionkey"]].astype(got.dtypes.to_dict()))


def test_csv_dir_missing_file_is_error(spark):
    d = tempfile.mkdtemp(prefix="shelfcast-test-")
    with pytest.raises(FileNotFoundError):
        load_csv_dir(spark, d, {"orders": "orders.csv"}, {"orders": T.StructType([])})


def test_append_and_overwrite(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="shelfcast-test-"), "audit")
    region = read_table(spark, SF001, "region")
    write_table(region, d, mode="overwrite")
    write_table(region, d, mode="append")
    assert spark.read.parquet(d).count() == 2 * region.count()
    write_table(region, d, mode="overwrite")
    assert spark.read.parquet(d).count() == region.count()
    with pytest.raises(Exception):
        write_table(region, d, mode="errorifexists")


def test_csv_empty_string_is_null(spark):
    d = tempfile.mkdtemp(prefix="shelfcast-test-")
    p = os.path.join(d, "x.csv")
    with open(p, "w") as f:
        f.write("a,b\n1,\n2,2024-01-05\n")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    rows = read_csv_table(spark, p, schema, date_cols=("b",)).orderBy("a").collect()
    assert rows[0].b is None and str(rows[1].b) == "2024-01-05"


def test_table_counts(spark):
    t = {n: read_table(spark, SF001, n) for n in ("region", "nation")}
    got = {r.table_name: r.n_rows for r in table_counts(t).collect()}
    assert got == {"region": 5, "nation": 25}


def test_bulk_load_refuses_a_filled_target_unless_reset(spark):
    d = tempfile.mkdtemp(prefix="shelfcast-test-")
    region = read_table(spark, SF001, "region")
    write_table(region, os.path.join(d, "seed", "region.csv"), fmt="csv")
    load = lambda reset: bulk_load(spark, os.path.join(d, "seed"), ["region"], {"region": region.schema},
                                   os.path.join(d, "loaded"), reset=reset).first().n_rows
    assert load(False) == 5
    with pytest.raises(Exception, match="exists"):
        load(False)
    assert load(True) == 5


def test_inventory_history_is_stored_compressed(spark, tmp_path, monkeypatch):
    """A record for every seller and day, in compressed files of bounded length."""
    from shelfcast.plans import q_io
    from shelfcast.plans.registry import REGISTRY
    monkeypatch.setattr(q_io, "HISTORY_FILE_ROWS", 4)
    spark.sql("""SELECT k AS o_orderkey, 'F' AS o_orderstatus, make_timestamp_ntz(2001, 6, 20 + CAST(k AS INT), 0, 0, 0) AS o_orderdate
                 FROM (SELECT explode(array(1L, 3L, 3L)) AS k)""").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("""SELECT k AS l_orderkey, 1 AS l_linenumber, 5L AS l_suppkey, 1L AS l_partkey, 2.0D AS l_quantity, 4.0D AS l_extendedprice,
                 0.1D AS l_tax, make_timestamp_ntz(2001, 6, 25, 0, 0, 0) AS l_shipdate
                 FROM (SELECT explode(array(1L, 1L, 3L)) AS k)""").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = REGISTRY["C11_export_inventory_history"].run(spark, str(tmp_path))
    assert len(got.inputFiles()) >= 3 and all(f.endswith(".json.gz") for f in got.inputFiles())
    assert {(r.sku_id, r.recorded_date.day, r.units_sold) for r in got.collect()} == {
        ("5", d, {21: 2, 23: 2}.get(d, 0)) for d in range(21, 31)} and got.count() == 10
