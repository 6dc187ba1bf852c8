"""Hard-negative mining against a brute-force version."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import hardneg

ROWS = "vec_id long, label int, embedding array<double>, row string, stripe int, place string"


def vectors():
    rng = random.Random(3)
    rows = [(i, rng.randrange(3), [rng.gauss(0, 1) for _ in range(6)]) for i in range(240)]
    rows += [(300 + i, i % 3, [0.5] * 6) for i in range(90)]                   # ties
    rows += [rows[100], rows[100], rows[7], rows[205]]                          # repeated rows, anchors and others
    rows += [(500, 1, [2.0, -1.0]), (501, 0, []), (100, 2, [1.0] * 6)]          # short, empty, an id with two vectors
    rows += [(600, None, [1.0] * 6), (700, 1, None), (800, 1, [1.0, None]), (None, 1, [1.0] * 6),
             (900, 1, [float("nan")] * 6), (1000, 2, [float("inf")] * 6), (1100, 7, [1.0] * 6)]
    return rows


def brute(rows, positives=5, negatives=5):
    ok = [(i, b, [math.floor(256 * x) for x in v]) for i, b, v in rows
          if i is not None and b is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, b, v in ok:
        if i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, c) for j, c, w in ok if j != i)
        for s, p, _ in [x for x in scored if x[2] == b][:positives]:
            fit = [(t, j) for t, j, c in scored if c != b and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(i, p, k + 1, j, -s, -t) for k, (t, j) in enumerate(fit[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("most_rows", [hardneg.MOST_ROWS, 50])
def test_mine_equals_brute_force(spark, monkeypatch, most_rows):
    monkeypatch.setattr(hardneg, "MOST_ROWS", most_rows)
    monkeypatch.setattr(hardneg, "HELD", 700)
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], ROWS)
    got = hardneg.mine(df, lambda i: i % 100 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_nothing_to_mine(spark):
    df = spark.createDataFrame([], ROWS)
    assert hardneg.mine(df, lambda i: i % 100 == 0).count() == 0
    one = spark.createDataFrame([(100, 1, [1.0]), (101, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    assert hardneg.mine(one, lambda i: i % 100 == 0).count() == 0                # no other label
    assert hardneg.mine(one, lambda i: i < 0).count() == 0                       # no anchor
    empty = one.withColumn("embedding", F.array().cast("array<float>"))
    assert hardneg.mine(empty, lambda i: i % 100 == 0).count() == 0


@pytest.mark.parametrize("most", [1, 3, 200, 10 ** 6, 10 ** 9, 10 ** 20])
def test_packed_products_are_exact(most):
    rng = np.random.default_rng(most % 97)
    x, a = (np.floor(rng.uniform(-1, 1, (n, 5)) * most) for n in (37, 4))
    words = hardneg.Words(x, most)
    assert words.wide == (most >= 10 ** 9) and (words.fields > 1) == (most <= 200 or words.wide)
    exact = [[sum(int(p) * int(q) for p, q in zip(r, c)) for c in x] for r in a]
    held = [[min(max(s, -2 ** 63 + 1), 2 ** 63 - 1) for s in r] for r in exact]
    assert words.scores(a).tolist() == held
    assert words.scores(a, 3, 30).tolist() == [r[3:30] for r in held]
    assert words.scores(a, 5, 5).shape == (4, 0)


def test_very_large_components(spark):
    rows = [(100, 1, [1e30, 2.0]), (101, 1, [1.0, 1.0]), (102, 2, [1.0, 0.5]), (103, 2, [0.9, -1e3])]
    got = hardneg.mine(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), lambda i: i == 100)
    most = 2 ** 63 - 1                                                           # both products are beyond 64 bits
    assert sorted(map(tuple, got.collect())) == [(100, 101, 1, 102, most, most), (100, 101, 2, 103, most, most)]
