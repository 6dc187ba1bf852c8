"""Weekly/vendor operators: skew-safe top-n, category codes, flags."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfcast.operators import parts as PT


def test_latest_n_salted_equals_plain_window_on_hot_group(spark):
    # group 'hot' holds 90% of the rows
    rows = [("hot" if i % 10 else f"g{i % 7}", i, (i * 37) % 101) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, id int, d int")
    got = PT.latest_n(df, ["k"], F.desc("d"), F.asc("id"), 25, salt_col="id")
    w = Window.partitionBy("k").orderBy(F.desc("d"), F.asc("id"))
    exp = df.withColumn("_rn", F.row_number().over(w)).filter("_rn <= 25").drop("_rn")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))


def test_category_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string")
    got = {(r.c, r.c_code) for r in PT.category_codes(df, "c").collect()}
    assert got == {("a", 0), ("b", 1), (None, -1)}


def test_flag01_accepts_strings_and_booleans(spark):
    df = spark.createDataFrame([("Yes",), ("No",), ("Y",), ("true",), (None,)], "v string")
    assert [r.f for r in df.select(PT.flag01("v").alias("f")).collect()] == [1, 0, 1, 1, 0]
