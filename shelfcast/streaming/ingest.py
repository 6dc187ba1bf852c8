"""Daily activity counts per key from an event stream, with a watermark
so rows later than ``late`` are dropped and state stays bounded. The rows of
each batch are counted inside the stream (``observe``), so ``late_by_batch``
says what every batch lost without a second scan of the source.
T2: latest decision status per record, a keyed upsert into buckets.

T1 writes every micro-batch to a folder of its own (``batch_id=<n>``), so a
batch that is run again after a failure replaces itself, and readers take the
newest row per key. T2 rewrites the buckets that a batch touches and keeps two
versions at most. ``root`` holds output and streaming checkpoint: a job started
again with the same root goes on where it stopped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from ..sources.files import path_exists


def scratch_root(spark: SparkSession, name: str) -> str:
    """A new folder for one run in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/shelfcast-streams/{name}-{uuid.uuid4().hex}"


def _drive(stream: DataFrame, root: str, mode: str, reduce_batch=lambda b: b) -> DataFrame:
    """Runs a stream over all that is there and returns what all runs with
    this root have written, with the ``batch_id`` of each row."""
    spark = stream.sparkSession
    out = f"{root}/out"

    def sink(batch: DataFrame, batch_id: int):
        reduce_batch(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    # Progress of every batch is kept until it is stored below.
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "100000")
    q = (stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{root}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    _store_rows(spark, root, q)
    schema = T.StructType([*reduce_batch(stream).schema.fields, T.StructField("batch_id", T.LongType())])
    if not path_exists(spark, out):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(out)


_BATCH_ROWS = "batch_id long, n_rows long"


def _store_rows(spark: SparkSession, root: str, query) -> None:
    """The observed rows of the batches of this run, beside the output."""
    seen = {}
    for p in query.recentProgress:
        n = (p.observedMetrics or {}).get("rows")
        if n is not None and p.numInputRows:
            seen[p.batchId] = n["n"]
    if seen:
        spark.createDataFrame(list(seen.items()), _BATCH_ROWS).coalesce(1).write.mode("overwrite").parquet(
            f"{root}/rows/from={min(seen)}")


def late_by_batch(spark: SparkSession, root: str, key: str) -> DataFrame:
    """For every batch with rows, how many it read, how many entered a
    window, and how many came too late. A batch's windows hold running totals;
    what it added is the difference to their version before."""
    if not path_exists(spark, f"{root}/rows"):
        return spark.createDataFrame([], "batch long, n_rows long, n_counted long, n_late long")
    rows = spark.read.schema(_BATCH_ROWS).parquet(f"{root}/rows").select("batch_id", "n_rows")
    order = Window.partitionBy("w", key).orderBy("batch_id")
    added = spark.read.parquet(f"{root}/out").select("batch_id", (F.col("n_events") - F.coalesce(
        F.lag("n_events").over(order), F.lit(0))).alias("n")).groupBy("batch_id").agg(F.sum("n").alias("n"))
    counted = F.coalesce("n", F.lit(0))
    return rows.join(added, "batch_id", "left").select(F.col("batch_id").alias("batch"), "n_rows", counted.alias("n_counted"),
                                                       (F.col("n_rows") - counted).alias("n_late"))


def _source(spark: SparkSession, src: str, schema: T.StructType, files_per_trigger: int) -> DataFrame:
    """``src``: a folder of files, one file or a pattern. A stream takes a single file
    only as the match of a pattern; this one matches ``src`` alone."""
    exactly = src if set(src) & set("*?[{") else f"{src[:-1]}[{src[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(exactly)


def _instants(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need TIMESTAMP: wall clocks are read as UTC instants, so
    windows align to UTC days whatever the session time zone is."""
    if not isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return df
    return df.withColumn(ts, F.from_utc_timestamp(F.col(ts).cast("timestamp"), df.sparkSession.conf.get("spark.sql.session.timeZone")))


def _utc_day(c) -> F.Column:
    return F.date_from_unix_date(F.floor(F.unix_seconds(c) / 86400).cast("int"))


def daily_counts_stream(spark: SparkSession, src: str, schema: T.StructType, ts: str, key: str,
                        value: str, late: str = "1 day", files_per_trigger: int = 1) -> DataFrame:
    """T1 as a streaming DataFrame: event-time 1-day windows per key."""
    s = _instants(_source(spark, src, schema, files_per_trigger), ts).observe("rows", F.count(F.lit(1)).alias("n"))
    return (s.withWatermark(ts, late)
            .groupBy(F.window(ts, "1 day").alias("w"), F.col(key))
            .agg(F.count(F.lit(1)).alias("n_events"), F.sum(value).alias("total_value")))


def run_daily_counts(spark: SparkSession, src: str, schema: T.StructType, ts: str, key: str,
                     value: str, late: str = "1 day", root: str | None = None) -> DataFrame:
    """Drives T1 over all files there are, in update mode; the result keeps
    the newest version of each window."""
    res = _drive(daily_counts_stream(spark, src, schema, ts, key, value, late), root or scratch_root(spark, "t1"), "update")
    newest = res.groupBy("w", key).agg(F.max_by(F.struct("n_events", "total_value"), "batch_id").alias("r"))
    return newest.select(_utc_day(F.col("w.start")).alias("day"), key, "r.n_events", "r.total_value")


def late_rows(spark: SparkSession, src: str, schema: T.StructType, ts: str, key: str, counted: DataFrame) -> DataFrame:
    """Per (day, key): rows in the source, rows counted by T1, and the rows
    that came too late; days that were lost as a whole are included."""
    there = _instants(spark.read.schema(schema).parquet(src), ts).groupBy(_utc_day(F.col(ts)).alias("day"), key).agg(
        F.count(F.lit(1)).alias("n_source"))
    j = there.join(counted.select("day", key, F.col("n_events").alias("n_counted")), ["day", key], "left")
    return j.withColumn("n_counted", F.coalesce("n_counted", F.lit(0))).withColumn(
        "n_late", F.col("n_source") - F.col("n_counted"))


#: Buckets of an upserted table: a batch rewrites the ones that it touches.
BUCKETS = 64


class BucketedTable:
    """The newest row of every key, in buckets by key hash.

    A batch merges its rows into the buckets they fall in and writes those as
    a new version; a list of the version of each bucket (at most ``buckets``
    rows) is written last and makes the batch visible. A batch that is run
    again starts from the list before it and replaces its own version. Files
    that neither the newest list nor the one before names are removed, so the
    table holds two versions of a bucket at most, however many batches ran."""

    def __init__(self, spark: SparkSession, root: str, key: str, order: str, schema: T.StructType, buckets: int = BUCKETS):
        self.spark, self.root, self.key, self.order, self.schema, self.buckets = spark, root, key, order, schema, buckets

    def _newest(self, df: DataFrame) -> DataFrame:
        rest = [c for c in self.schema.names if c != self.key]
        best = df.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.struct(self.order, *rest)).alias("_r"))
        return best.select(*[F.col(c) if c == self.key else F.col(f"_r.{c}").alias(c) for c in self.schema.names])

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _lists(self) -> list[int]:
        fs, p = self._fs(f"{self.root}/lists")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[2:]) for n in names if n.startswith("b=") and path_exists(self.spark, f"{self.root}/lists/{n}/_SUCCESS"))

    def _list(self, batch: int | None) -> dict[int, int]:
        if batch is None:
            return {}
        return {r.bucket: r.version for r in self.spark.read.schema("bucket int, version long").parquet(f"{self.root}/lists/b={batch}").collect()}

    def _files(self, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.root}/state/v={v}/bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merge(self, batch: DataFrame, number: int) -> None:
        lists = [n for n in self._lists() if n < number]
        before = self._list(lists[-1] if lists else None)
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        new = self._newest(batch.select(*self.schema.names))
        touched = {r[0] for r in batch.select(bucket).distinct().collect()}
        if touched:
            merged = self._newest(self._files({b: v for b, v in before.items() if b in touched}).unionByName(new))
            (merged.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket")
             .parquet(f"{self.root}/state/v={number}"))
        now = before | dict.fromkeys(touched, number)
        self.spark.createDataFrame(list(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(
            f"{self.root}/lists/b={number}")
        if lists:
            older = self._list(lists[-2]) if len(lists) > 1 else {}
            for b, v in older.items():
                if before.get(b) != v:
                    self._remove(f"{self.root}/state/v={v}/bucket={b}")
            for n in lists[:-1]:
                self._remove(f"{self.root}/lists/b={n}")

    def _remove(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def read(self) -> DataFrame:
        lists = self._lists()
        return self._files(self._list(lists[-1] if lists else None))


def upsert_latest(spark: SparkSession, src: str, schema: T.StructType, key: str, order: str, cols,
                  root: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Stream a decision log into a table of the latest row per key."""
    root = root or scratch_root(spark, "t2")
    stream = _source(spark, src, schema, 1).select(key, order, *cols)
    table = BucketedTable(spark, f"{root}/table", key, order, stream.schema, buckets)
    q = (stream.writeStream.foreachBatch(table.merge).option("checkpointLocation", f"{root}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return table.read()
