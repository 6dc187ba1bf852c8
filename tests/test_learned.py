"""Learned quantiles, permutation importance and as-of joins on small cases."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import importance as IM
from shelfcast.operators import quantile_boost as QB
from shelfcast.operators import scenarios as SC


@pytest.fixture(scope="module")
def toy(spark):
    """Two groups; x decides the spread, z is noise, x is sometimes unknown."""
    rows = []
    for g, shift in (("a", 0.0), ("b", 1000.0)):
        for x, width in ((0.0, 10), (1.0, 100), (None, 1)):
            rows += [(g, x, float(i % 7), shift + i % width) for i in range(700)]
    return spark.createDataFrame(rows, "fold string, x double, z double, y double")


def test_learned_quantiles_follow_the_features(spark, toy):
    model = QB.fit(toy, "fold", "y", ["x", "z"], rounds=12, rate=0.5)
    new = spark.createDataFrame([(g, x, 3.0) for g in ("a", "b", "new") for x in (0.0, 1.0, None)], "fold string, x double, z double")
    got = {(r.fold, r.x): (r.lo, r.mid, r.hi) for r in model.predict(new, "fold", ["lo", "mid", "hi"]).collect()}
    for g, shift in (("a", 0.0), ("b", 1000.0)):
        for x, width in ((0.0, 10), (1.0, 100), (None, 1)):
            exact = [shift + q * (width - 1) for q in (0.1, 0.5, 0.9)]
            assert got[g, x] == pytest.approx(exact, abs=0.06 * width + 0.5), (g, x)
    assert got["new", 0.0] == (None, None, None)


def test_learning_from_nothing_and_from_constants(spark, toy):
    none = QB.fit(toy.limit(0), "fold", "y", ["x"])
    assert none.groups == []
    flat = QB.fit(toy.withColumn("y", F.lit(5.0)), "fold", "y", ["x", "z"])
    assert {tuple(r) for r in flat.predict(toy, "fold", ["lo", "mid", "hi"]).select("lo", "mid", "hi").collect()} == {(5.0, 5.0, 5.0)}


def test_permutation_importance_ranks_noise_last(spark):
    rng = random.Random(8)
    rows = [(i, rng.random(), rng.random(), rng.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, a double, b double, noise double").withColumn("y", 3 * F.col("a") + F.col("b"))
    got = IM.permutation_importance(df, ["id"], ["noise", "b", "a"], "y", lambda c: 3 * c["a"] + c["b"]).orderBy("rank").collect()
    assert [r.feature for r in got] == ["a", "b", "noise"]
    assert got[2].increase == 0.0 and got[0].increase > got[1].increase > 0.1 and got[0].base_error < 1e-12
    again = IM.permutation_importance(df.repartition(7), ["id"], ["noise", "b", "a"], "y", lambda c: 3 * c["a"] + c["b"])
    assert {(r.feature, round(r.increase, 9)) for r in again.collect()} == {(r.feature, round(r.increase, 9)) for r in got}


def test_permutation_keeps_the_values_of_a_column(spark):
    df = spark.range(500).withColumn("v", F.col("id") % 50)
    moved = IM.permuted(df, ["id"], ["v"])
    assert sorted(r[0] for r in moved.select("v_permuted").collect()) == sorted(i % 50 for i in range(500))
    assert moved.where("v <> v_permuted").count() > 400


def test_permutation_follows_the_hashes_and_sorts_no_rows(spark):
    """Each row takes the value of the row before it by md5 in its bucket, nulls
    too; the rows themselves are not sorted."""
    rows = [(i, None if i % 9 == 0 else f"k{i}", None if i % 5 == 0 else float(i), dt.date(2020, 1, 1 + i % 28)) for i in range(2000)]
    df = spark.createDataFrame(rows, "o0 long, key string, _bucket double, day date")
    moved = IM.permuted(df, ["o0", "key"], ["_bucket", "day"])
    assert moved.columns == ["o0", "key", "_bucket", "day", "_bucket_permuted", "day_permuted"]
    plan = moved._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan

    def digest(r, salt):
        return hashlib.md5("|".join([str(r[0]), *([r[1]] if r[1] else []), salt]).encode()).hexdigest()

    want = {r[0]: list(r) for r in rows}
    for column, name in ((2, "_bucket"), (3, "day")):
        buckets = {}
        for r in rows:
            buckets.setdefault(digest(r, "")[:2], []).append(r)
        for own in buckets.values():
            own.sort(key=lambda r: digest(r, name))
            for before, r in zip([own[-1], *own], own):
                want[r[0]].append(before[column])
    assert {r[0]: list(r) for r in moved.collect()} == want


def test_permutation_breaks_equal_halves_of_hashes():
    import numpy as np
    high, low = np.array([[7, 7, 7, 5, 1], [3, 1, 2, 9, 1]], "uint64")
    assert IM._source(high, low, np.array([0, 0, 0, 0, 1])).tolist() == [2, 3, 1, 0, 4]
    assert IM._source(high, low, np.zeros(5, int)).tolist() == [2, 3, 1, 4, 0]


def test_as_of_join_takes_the_last_row_before_each_anchor(spark):
    day = lambda n: None if n is None else dt.date(2020, 1, 1) + dt.timedelta(days=n)
    history = [("a", 1, 1.0, "p"), ("a", 5, None, "q"), ("a", 9, 3.0, None), ("b", 2, 4.0, "r"), (None, 1, 9.0, "s"), ("a", None, 8.0, "t")]
    asks = [("a", 0), ("a", 1), ("a", 4), ("a", 5), ("a", 5), ("a", 50), ("b", 1), ("b", 2), ("c", 9), (None, 3), ("a", None)]
    left = spark.createDataFrame([(i, k, day(n)) for i, (k, n) in enumerate(asks)], "id int, key string, at date")
    right = spark.createDataFrame([(k, day(n), x, w) for k, n, x, w in history], "key string, day date, x double, w string")
    got = {r.id: (r.x, r.w, r.found) for r in SC.as_of_join(left, right, "key", "at", "day", ["x", "w"], found="found").collect()}
    assert len(got) == len(asks)
    for i, (k, n) in enumerate(asks):
        rows = [h for h in history if k is not None and n is not None and h[0] == k and h[1] is not None and h[1] <= n]
        last = max(rows, key=lambda h: h[1], default=(None, None, None, None))
        assert got[i] == (last[2], last[3], day(last[1])), (i, k, n)
    near = SC.as_of_join(left, right, "key", "at", "day", ["x"], found="found", most_days=3)
    assert {r.id: r.x for r in near.collect() if r.x is not None} == {1: 1.0, 2: 1.0, 7: 4.0}


def test_tree_growing_passes_stay_small_and_exact(spark, monkeypatch):
    """Leaf quantiles come from counts by binary digits, never from all of a
    group's distinct values, and equal the exact ones."""
    rng = random.Random(3)
    rows = [("a", float(rng.randint(0, 1)), rng.choice((1, -1)) * rng.random() * 10 ** rng.randint(-3, 5)) for _ in range(4000)]
    df = spark.createDataFrame(rows, "fold string, x double, y double")
    for few in (QB.FEW, 3):
        monkeypatch.setattr(QB, "FEW", few)
        model = QB.fit(df, "fold", "y", ["x"], rounds=1, rate=1.0)
        ys = sorted(y for _, _, y in rows)
        for q, level in enumerate((0.1, 0.5, 0.9)):
            at = (len(ys) - 1) * level
            low, high = ys[int(at)], ys[min(int(at) + 1, len(ys) - 1)]
            assert model.start[0, q] == pytest.approx(low + (high - low) * (at - int(at)), rel=1e-12)
    import inspect
    assert "percentile(" not in inspect.getsource(QB.fit)


def test_rows_are_numbered_and_scored_in_batches(spark, toy, monkeypatch):
    """No expression of a row compares every feature with every edge: such a
    method is too long for Java's compiler. Null, NaN and values on an edge
    get the bins of the comparisons."""
    import math
    plans = []
    monkeypatch.setattr(QB, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or df.localCheckpoint())
    model = QB.fit(toy, "fold", "y", ["x", "z"], rounds=1)
    plans.append(model.predict(toy, "fold", ["lo", "mid", "hi"])._jdf.queryExecution().toString())
    assert len(plans) == 2 and all("MapInArrow" in p and "aggregate(" not in p for p in plans)
    import pyarrow as pa
    values = [None, -1.0, 0.0, -0.0, 0.5, 1.0, 1.5, math.inf, math.nan]
    got = QB._numbers({"x": [0.0, 1.0], "z": []}, [pa.array(values, from_pandas=False)] * 2)
    assert got[0].tolist() == [0, 1, 1, 1, 2, 2, 3, 3, 3] and got[1].tolist() == [0, *[1] * 8]
