"""Rolling origins, CSV rejects, VARIANT fields and merged sketches on small cases."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.functions import semi
from shelfcast.operators import forecast as FC
from shelfcast.operators import quality as Q
from shelfcast.sources.files import read_csv_checked


def test_interval_join_equals_a_plain_loop(spark):
    base = dt.date(2020, 1, 1)
    day = lambda n: base + dt.timedelta(days=n)
    panel = [(k, day(n), float(n)) for k in "ab" for n in range(0, 200, 3 if k == "a" else 1)]
    df = spark.createDataFrame(panel, "k string, day date, y double")
    origins = FC.rolling_origins(df, 12, 5, 40, 9)
    spans = origins.collect()
    assert len(spans) == 24 and max(r.last_day for r in spans) == day(199)
    for bins in (1, 7, 500):
        got = FC.interval_join(df, origins, bin_days=bins).select("origin", "role", "k", "day").collect()
        assert sorted(map(tuple, got)) == sorted((r.origin, r.role, k, d) for r in spans for k, d, _ in panel if r.first_day <= d <= r.last_day)
    plan = FC.interval_join(df, origins)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert FC.rolling_origins(df.limit(0), 3, 5, 40, 9).count() == 0


def test_csv_rejects_and_accepted_rows_are_all_lines(spark):
    folder = tempfile.mkdtemp(prefix="shelfcast-test-") + "/t"
    lines = ["id,price,day", "1,2.5,2020-01-01", "2,n/a,2020-01-01", "3,,", "x,y,z", "4,1.0", "5,1.0,2020-01-01,more", '6,"7.5",2020-02-30', ",,"]
    spark.createDataFrame([("\n".join(lines),)], "v string").coalesce(1).write.text(folder)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("price", T.DoubleType()), T.StructField("day", T.DateType())])
    ok, bad = read_csv_checked(spark, folder, schema)
    assert ok.dtypes == [("id", "bigint"), ("price", "double"), ("day", "date")]
    assert sorted(map(tuple, ok.collect()), key=str) == sorted([(1, 2.5, dt.date(2020, 1, 1)), (3, None, None), (None, None, None)], key=str)
    assert sorted((r.record.split(",")[0], ",".join(r.reasons)) for r in bad.collect()) == [
        ("2", "price"), ("4", "number of fields"), ("5", "number of fields"), ("6", "day"), ("x", "id,price,day")]
    assert ok.count() + bad.count() == len(lines) - 1 or ok.count() + bad.count() == len(lines) - 2     # a line of separators only


def test_variant_fields(spark):
    rows = ['{"k": 1, "n": {"t": ["a", "b"]}}', '{"k": "x"}', '{"k": 1', "[1]", "", None, "null", '{"k": null}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, raw string")
    got = semi.variant_fields(df, "raw", {"k": ("$.k", "int"), "t": ("$.n.t[1]", "string")}).orderBy("id").collect()
    assert [(r.k, r.t, r.malformed) for r in got] == [
        (1, "b", False), (None, None, False), (None, None, True), (None, None, False), (None, None, True), (None, None, False),
        (None, None, False), (None, None, False)]
    found = semi.schema_found(df.where("id in (0, 2)"), "raw").first()
    assert found.n_rows == 1 and "k" in found.schema and "n" in found.schema


def test_sketches_merge_to_their_bounds(spark):
    df = spark.range(60000).select((F.col("id") % 30).alias("d"), (F.col("id") % 7001).alias("c"), F.col("id").cast("double").alias("v"))
    got = Q.merged_sketches(Q.daily_sketches(df, F.col("d"), "c", "v"), F.col("day") % 2, "half").collect()
    assert len(got) == 2 and sum(r.n_rows for r in got) == 60000
    for r in got:
        assert abs(r.n_distinct - 7001) < Q.HLL_ERROR * 7001
        for q, v in ((0.1, r.p10), (0.5, r.p50), (0.9, r.p90)):
            assert abs(v / 60000 - q) <= Q.KLL_RANK_ERROR


def test_orphans_of_many_relations(spark):
    child = spark.createDataFrame([(1, 1), (2, 9), (9, None), (9, 2)], "a long, b int")
    parent = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    tables = {"c": child, "p": parent, "e": parent.limit(0)}
    got = Q.all_orphans(tables, [("a", "c", "a", "p", "k"), ("b", "c", "b", "p", "k"), ("none", "e", "k", "p", "k"), ("no parents", "p", "k", "e", "k")])
    assert {r.relation: r.orphans for r in got.collect()} == {"a": 2, "b": 2, "none": 0, "no parents": 3}
