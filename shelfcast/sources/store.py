"""Stored result tables with versions.

A table is a Parquet folder partitioned by run and by the columns it is asked
for by (a month, say). ``publish`` writes a run's partitions first and appends
one row to the table's list of runs last: that row is the pointer readers
follow, so a publication that fails half-way is never seen, and one that is
repeated replaces its own partitions only (dynamic overwrite). Readers get a
plain scan of one run, so filters reach the files and partitions are pruned.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import path_exists

_RUNS = T.StructType([T.StructField("run", T.StringType()), T.StructField("number", T.LongType()),
                      T.StructField("schema", T.StringType())])


def fingerprint(tables: dict[str, DataFrame], *settings: str) -> str:
    """Name of the state of some tables' files (path, size, time of change)
    and of settings; one small aggregate, whatever the number of files."""
    from functools import reduce
    parts = [df.select(F.xxhash64(F.lit(n), "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("h"))
             .distinct() for n, df in sorted(tables.items())]
    total = reduce(DataFrame.unionByName, parts).agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.count("h").alias("n"))
    return total.select(F.sha1(F.concat_ws("|", "s", "n", *map(F.lit, settings)))).first()[0]


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _list(self, name: str) -> str:
        return f"{self.root}/_runs/{name}"

    def runs(self, name: str) -> DataFrame:
        """run, number (rising) and schema of every complete publication."""
        if not path_exists(self.spark, self._list(name)):
            return self.spark.createDataFrame([], _RUNS)
        return self.spark.read.schema(_RUNS).parquet(self._list(name))

    def publish(self, df: DataFrame, name: str, run: str, by: tuple[str, ...] = ()) -> None:
        """Store ``df`` as a run of the table, partitioned by ``by``."""
        last = self.runs(name).agg(F.max("number")).first()[0] or 0
        (df.withColumn("run", F.lit(f"r-{run}")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("run", *by).parquet(f"{self.root}/{name}"))
        self.spark.createDataFrame([(run, last + 1, df.schema.json())], _RUNS).coalesce(1).write.mode("append").parquet(self._list(name))

    def has(self, name: str, run: str) -> bool:
        return not self.runs(name).where(F.col("run") == run).isEmpty()

    def read(self, name: str, run: str | None = None) -> DataFrame:
        """A run of the table, the newest one unless it is named."""
        known = self.runs(name)
        known = known.where(F.col("run") == run) if run else known
        row = known.orderBy(F.desc("number")).first()
        if row is None:
            raise LookupError(f"no such run of table {name}: {run or 'none published'}")
        schema = T.StructType.fromJson(json.loads(row['schema']))
        path = f"{self.root}/{name}"
        if not path_exists(self.spark, f"{path}/run=r-{row['run']}"):        # a run without rows has no files
            return self.spark.createDataFrame([], schema)
        whole = T.StructType([*schema.fields, T.StructField("run", T.StringType())])
        return self.spark.read.schema(whole).parquet(path).where(F.col("run") == f"r-{row['run']}").select(*[f"`{c}`" for c in schema.names])

    def stored(self, name: str, run: str, build, by: tuple[str, ...] = ()) -> DataFrame:
        """The run of the table, built and published if it is not there yet."""
        if not self.has(name, run):
            self.publish(build(), name, run, by)
        return self.read(name, run)

    def keep_newest(self, name: str, n: int) -> int:
        """Remove the files of all but the newest ``n`` runs; how many went.
        Their list rows stay; ``read`` of such a run finds no rows."""
        order = [r.run for r in self.runs(name).orderBy(F.desc("number")).collect()]
        newest = list(dict.fromkeys(order))
        for run in newest[n:]:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/run=r-{run}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        return len(newest[n:])
