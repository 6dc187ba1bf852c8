"""Streaming jobs over the events table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..streaming import ingest as ST
from .registry import query


def _events(t) -> tuple:
    """The events table as a stream source: its path (a file or a folder, on
    any file system) and schema."""
    return f"{t.sf_dir.rstrip('/')}/events.parquet", t["events"].schema


def _counts(t):
    return ST.run_daily_counts(t.spark, *_events(t), "ts", "event_type", "value")


@query("T1_stream_daily_counts", "day:d event_type:s n_events:i total_value:f", """
SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n_events, sum(value) AS total_value
FROM events GROUP BY ALL""", ops=("T1", "A1"))
def q_stream_counts(t):
    return _counts(t)


@query("T1_stream_late_rows", "n_source:i n_counted:i n_late:i", """
SELECT count(*) AS n_source, count(*) AS n_counted, 0 AS n_late FROM events""", ops=("T1",))
def q_late(t):
    r = ST.late_rows(t.spark, *_events(t), "ts", "event_type", _counts(t))
    return r.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_source", "n_counted", "n_late")])


@query("T1_stream_late_batches", "batch:i n_rows:i n_counted:i n_late:i", """
WITH e AS (SELECT *, event_id % 2 AS batch FROM events),
gone AS (SELECT max(ts) FILTER (WHERE batch = 0) - INTERVAL 1 DAY AS mark FROM e),
late AS (SELECT e.*, batch = 1 AND CAST(CAST(ts AS DATE) + INTERVAL 1 DAY AS TIMESTAMP) <= mark AS is_late FROM e, gone)
SELECT batch, count(*) AS n_rows, count_if(NOT is_late) AS n_counted, count_if(is_late) AS n_late FROM late GROUP BY batch""",
       ops=("T1",))
def q_late_batches(t):
    """The events arrive in two files, those of even number first; the job runs
    after each. Days that the first run has closed are lost to the second."""
    root = ST.scratch_root(t.spark, "t1-late")
    for k in (0, 1):
        t["events"].where(F.col("event_id") % 2 == k).coalesce(1).write.parquet(f"{root}/in/part={k}")
        ST.run_daily_counts(t.spark, f"{root}/in/part=*", t["events"].schema, "ts", "event_type", "value", root=root)
    # One row for each batch that had rows.
    order = Window.orderBy("batch")
    return ST.late_by_batch(t.spark, root, "event_type").withColumn("batch", F.row_number().over(order) - 1)


@query("T2_stream_latest_per_user", "user_id:i event_id:i event_type:s value:f", """
SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type,
  arg_max(value, event_id) AS value FROM events GROUP BY user_id""", ops=("T2", "U3"))
def q_stream_latest(t):
    return ST.upsert_latest(t.spark, *_events(t), "user_id", "event_id", ["event_type", "value"])
