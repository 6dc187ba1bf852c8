"""Streams: several files, late rows that are counted, restarts."""

import datetime as dt
import os
import tempfile

from shelfcast.streaming import ingest as ST

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def _file(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(os.path.join(folder, name))


def _events(first, days, day0):
    return [(first + i, dt.datetime(2024, 1, day0 + i % days, 12), i % 3, "ab"[i % 2], float(i)) for i in range(60)]


def _run(spark, src, root):
    schema = spark.createDataFrame([], SCHEMA).schema
    got = ST.run_daily_counts(spark, src, schema, "ts", "event_type", "value", root=root)
    return got, ST.late_rows(spark, src, schema, "ts", "event_type", got)


def test_late_rows_are_counted(spark):
    base = tempfile.mkdtemp(prefix="shelfcast-test-")
    src, root = os.path.join(base, "src"), os.path.join(base, "root")
    total = 0
    for k, day0 in enumerate((20, 10, 2)):      # newest first: the rest is late
        _file(spark, src, f"d{k}", _events(100 * k, 3, day0))
        total += 60
        got, late = _run(spark, src + "/*", root)
        sums = late.groupBy().sum("n_source", "n_counted", "n_late").first()
        assert sums[0] == total and sums[1] + sums[2] == total
        assert sums[1] == sum(r.n_events for r in got.collect())
    assert sums[2] > 0


def test_restart_goes_on_and_repeats_nothing(spark):
    base = tempfile.mkdtemp(prefix="shelfcast-test-")
    src, root = os.path.join(base, "src"), os.path.join(base, "root")
    _file(spark, src, "d0", _events(0, 3, 2))
    _run(spark, src + "/*", root)
    again, _ = _run(spark, src + "/*", root)       # nothing new
    assert sum(r.n_events for r in again.collect()) == 60
    _file(spark, src, "d1", _events(100, 3, 4))
    more, late = _run(spark, src + "/*", root)
    assert sum(r.n_events for r in more.collect()) == 120 and late.where("n_late > 0").isEmpty()


def test_latest_row_survives_a_restart(spark):
    base = tempfile.mkdtemp(prefix="shelfcast-test-")
    src, root = os.path.join(base, "src"), os.path.join(base, "root")
    schema = spark.createDataFrame([], SCHEMA).schema
    run = lambda: {r.user_id: r.event_id for r in ST.upsert_latest(
        spark, src + "/*", schema, "user_id", "event_id", ["event_type", "value"], root=root).collect()}
    _file(spark, src, "d0", _events(0, 3, 2))
    first = run()
    assert first == {0: 57, 1: 58, 2: 59}
    _file(spark, src, "d1", [(500, dt.datetime(2024, 1, 9), 1, "a", 1.0), (3, dt.datetime(2024, 1, 9), 2, "a", 1.0)])
    assert run() == {0: 57, 1: 500, 2: 59}
    assert run() == {0: 57, 1: 500, 2: 59}


def test_upserted_table_stays_bounded_and_survives_a_repeated_batch(spark):
    base = tempfile.mkdtemp(prefix="shelfcast-test-")
    rows = [[(100 * n + i, dt.datetime(2024, 1, 1), (i * 7 + n) % 40, "ab"[i % 2], float(n)) for i in range(20)] for n in range(7)]
    frames = [spark.createDataFrame(r, SCHEMA).select("user_id", "event_id", "event_type", "value") for r in rows]
    table = ST.BucketedTable(spark, base + "/t", "user_id", "event_id", frames[0].schema, buckets=4)
    assert table.read().count() == 0
    expected = {}
    for n, batch in enumerate(frames):
        table.merge(batch, n)
        if n in (2, 6):
            table.merge(batch, n)                   # run again after a failure
        expected.update({r[2]: r[0] for r in sorted(rows[n])})
        assert {r.user_id: r.event_id for r in table.read().collect()} == expected
    folders = [d for d, _, files in os.walk(base + "/t/state") if any(f.endswith(".parquet") for f in files)]
    assert len(folders) <= 2 * 4 and len(os.listdir(base + "/t/lists")) <= 2
    table.merge(frames[0].limit(0), 7)              # a batch without rows
    assert {r.user_id: r.event_id for r in table.read().collect()} == expected


def test_late_rows_by_batch(spark):
    base = tempfile.mkdtemp(prefix="shelfcast-test-")
    src, root = os.path.join(base, "src"), os.path.join(base, "root")
    for k, day0 in enumerate((20, 10, 21)):
        _file(spark, src, f"d{k}", _events(100 * k, 3, day0))
        _run(spark, src + "/*", root)
    got = ST.late_by_batch(spark, root, "event_type").orderBy("batch").collect()
    assert [(r.n_rows, r.n_counted, r.n_late) for r in got] == [(60, 60, 0), (60, 0, 60), (60, 60, 0)]
