"""Hard-negative mining by Kronecker-packed products.

An anchor's positives are its best rows of the same label; its hard negatives
are the best rows of other labels whose score lies in a stated part of a
positive's score. Scores are exact integer inner products, computed for
several candidates by one multiplication: their components, made non-negative
by a bias, lie in separated bit fields of one wide integer. The product of an
anchor component with that word is the product with every field at once; after
the last component each field is cut out and the biases are taken off.

A word is a whole number of up to 53 bits kept in a double, so that the sums of
word products run through the matrix product without rounding. If one field
alone needs more, words are Python integers of any width.

The plan: valid rows are stored once and dealt into stripes by a running number
(so no id, label or group of copies is one task's load); every anchor row goes
to every stripe, where candidates come first and the anchors stream past them
in bounded batches. A stripe's best rows of each anchor are merged by a window.
Anchors go round twice: for the positives, and with their scores for the
negatives.

Defined results: rows without an id or label, without a vector, or with a null
or non-finite component take no part; a shorter vector counts as padded with
zeros. "Other rows" are those of another id. Rows that repeat an id count one
by one, as candidates and as anchors. Equal scores go to the smaller id; labels
are whole numbers. Scores beyond 64 bits count as the nearest 64-bit number.
Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: A negative's score in hundredths of the positive's.
LOW, HIGH = 80, 100
#: Candidates that a stripe holds in memory at most, and at least if there are
#: fewer stripes than cores.
MOST_ROWS, LEAST_ROWS = 1 << 17, 1 << 12
#: Scores that are held at a time.
HELD = 1 << 21
#: Whole numbers of so many bits are exact in a double.
EXACT_BITS = 53
#: Fields of a word that is a Python integer.
WIDE_FIELDS = 16

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_INT64 = np.iinfo(np.int64)


class Words:
    """Candidates' vectors (rows of whole numbers) packed into words."""

    def __init__(self, x: np.ndarray, most: int):
        """``most``: no component of a candidate or an anchor is larger."""
        self.n, self.width = x.shape
        self.bias = most
        #: Bits of a field: sums of products of two biased components.
        self.bits = max(1, (self.width * (2 * most) ** 2).bit_length())
        self.wide = self.bits > EXACT_BITS
        self.fields = WIDE_FIELDS if self.wide else EXACT_BITS // self.bits
        count = -(-self.n // self.fields)
        kind = object if self.wide else np.float64
        biased = np.zeros((count * self.fields, self.width), kind)
        biased[:self.n] = whole(x, self.wide) + self.bias
        self.words = np.zeros((count, self.width), kind)
        for j in range(self.fields):
            self.words += biased[j::self.fields] * (1 << j * self.bits if self.wide else float(1 << j * self.bits))
        self.sums = whole(x, self.wide).sum(1)

    def scores(self, a: np.ndarray, first: int = 0, end: int | None = None) -> np.ndarray:
        """Inner products of the rows of ``a`` with candidates first..end-1."""
        end = self.n if end is None else end
        if first >= end:
            return np.zeros((len(a), 0), np.int64)
        a = whole(a, self.wide)
        at, to = first // self.fields, -(-end // self.fields)
        product = (a + self.bias) @ self.words[at:to].T
        if not self.wide:
            product = product.astype(np.int64)
        out = np.empty((len(a), (to - at) * self.fields), product.dtype)
        for j in range(self.fields):
            out[:, j::self.fields] = product >> j * self.bits & (1 << self.bits) - 1
        out = out[:, first - at * self.fields:end - at * self.fields]
        off = self.bias * a.sum(1)[:, None] + self.bias * self.sums[None, first:end] + self.width * self.bias ** 2
        if self.wide:
            exact = out - off
            return np.array([[min(max(s, _INT64.min + 1), _INT64.max) for s in r] for r in exact.tolist()], object)
        return out - off.astype(np.int64)


def whole(x: np.ndarray, wide: bool) -> np.ndarray:
    """Whole numbers in doubles, as Python integers if ``wide``."""
    if not wide or x.dtype == object:
        return x
    return np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)


def best(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int):
    """(row, column) of the k highest allowed scores of each row, equal ones by
    smaller id."""
    if scores.shape[1] > k:
        s = np.where(allowed, scores, _INT64.min)
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        allowed = allowed & (scores >= least[:, None])
    r, c = np.nonzero(allowed)
    if not len(r):
        return r, c
    s = scores[r, c].astype(np.int64)
    by = np.lexsort((ids[c], ~s, r))
    r, c = r[by], c[by]
    first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    place = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
    return r[place < k], c[place < k]


def _vectors(column, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of an Arrow list column, padded with zeros."""
    import pyarrow.compute as pc
    flat = np.floor(pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    begin = np.cumsum(sizes) - sizes
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(begin, sizes)] = flat
    return out


def _long(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


class Stripe:
    """The candidates of a stripe, by label, and what they answer to anchors."""

    def __init__(self, ids, labels, x, most: int):
        by = np.lexsort((ids, labels))
        self.ids, self.labels = ids[by], labels[by]
        self.words = Words(x[by], most)

    def _of_label(self, label):
        return np.searchsorted(self.labels, [label, label + 1]) if label < _INT64.max else (
            np.searchsorted(self.labels, label), len(self.labels))

    def positives(self, a, a_ids, a_labels, k: int):
        """(anchor number, candidate id, score) of the best rows of its label."""
        for label in np.unique(a_labels):
            first, end = self._of_label(label)
            own = np.flatnonzero(a_labels == label)
            step = max(1, HELD // max(1, end - first))
            for s in range(0, len(own) if end > first else 0, step):
                part = own[s:s + step]
                scores = self.words.scores(a[part], first, end)
                ids = self.ids[first:end]
                r, c = best(scores, ids[None, :] != a_ids[part][:, None], ids, k)
                yield part[r], ids[c], scores[r, c]

    def negatives(self, a, a_ids, a_labels, ceilings, k: int, low: int, high: int):
        """(anchor number, place of the positive, candidate id, score);
        ``ceilings``: the positives' scores of each anchor, best first."""
        step = max(1, HELD // max(1, len(self.ids)))
        places = max(map(len, ceilings), default=0)
        for s in range(0, len(a), step):
            scores = self.words.scores(a[s:s + step])
            other = (self.labels[None, :] != a_labels[s:s + step, None]) & (self.ids[None, :] != a_ids[s:s + step, None])
            for place in range(places):
                has = np.array([len(x) > place for x in ceilings[s:s + step]])
                p = np.array([x[place] if len(x) > place else 0 for x in ceilings[s:s + step]], scores.dtype)[:, None]
                hundred = scores * 100
                allowed = other & has[:, None] & (hundred >= p * low) & (hundred <= p * high)
                r, c = best(scores, allowed, self.ids, k)
                yield s + r, np.full(len(r), place), self.ids[c], scores[r, c]


def _search(batches, width: int, most: int, scale: int, answer, names: list[str]):
    """Rows of one or more stripes, candidates before anchors: ``answer`` of
    every batch of anchors to the stripe that stands before it."""
    import pyarrow as pa
    now = stripe = None
    held: list = []
    for batch in batches:
        at = _long(batch.column(0))
        kinds = _long(batch.column(1))
        edges = np.flatnonzero((np.diff(at) != 0) | (np.diff(kinds) != 0)) + 1
        for a, b in zip([0, *edges], [*edges, len(at)]):
            part = batch.slice(a, b - a)
            if at[a] != now:
                now, stripe, held = at[a], None, []
            row, ids, labels = (_long(part.column(k)) for k in (2, 3, 4))
            x = _vectors(part.column(5), width, scale)
            if kinds[a] == 0:
                held.append((ids, labels, x))
                continue
            if stripe is None:
                if not held:
                    continue
                stripe, held = Stripe(*(np.concatenate(c) for c in zip(*held)), most), []
            for number, *found in answer(stripe, x, ids, labels, part.column(6)):
                yield pa.RecordBatch.from_arrays([pa.array(row[number]), *(pa.array(f.astype(np.int64)) for f in found)], names)


def mine(vectors: DataFrame, is_anchor: Callable[[Column], Column], positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """``RESULT`` rows of ``vectors`` (vec_id, label, embedding); ``is_anchor``
    is a condition on vec_id. rank counts the negatives of a positive."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"),
                          F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    valid = materialize(rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
                        .select(F.monotonically_increasing_id().alias("row"), "id", "label", "v"), "hardneg-vectors")
    size = valid.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"),
                     F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    if not size.n:
        return spark.createDataFrame([], RESULT)
    width, most = size.width or 1, int(np.ceil((size.most or 0) * scale)) + 1
    stripes = max(-(-size.n // MOST_ROWS), min(-(-size.n // LEAST_ROWS), 2 * spark.sparkContext.defaultParallelism))
    none = F.lit(None).cast("array<bigint>")
    candidates = valid.select(F.pmod(F.xxhash64("row"), F.lit(stripes)).cast("int").alias("stripe"), F.lit(0).alias("kind"),
                              "row", "id", "label", "v", none.alias("ceilings"))
    anchors = valid.where(is_anchor(F.col("id")))

    def search(asked: DataFrame, answer, names: list[str]) -> DataFrame:
        asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"), F.lit(1).alias("kind"),
                             "row", "id", "label", "v", "ceilings")
        dealt = candidates.unionByName(asked).repartitionById(stripes, F.col("stripe")).sortWithinPartitions("stripe", "kind")
        return dealt.mapInArrow(lambda b: _search(b, width, most, scale, answer, names), ", ".join(f"{n} long" for n in names))

    found = search(anchors.withColumn("ceilings", none),
                   lambda stripe, x, ids, labels, _: stripe.positives(x, ids, labels, positives),
                   ["row", "positive_id", "positive_score"])
    order = Window.partitionBy("row").orderBy(F.col("positive_score").desc(), "positive_id")
    chosen = materialize(found.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < positives),
                         "hardneg-positives")
    ceilings = chosen.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))),
                                                     lambda x: x["positive_score"]).alias("ceilings"))
    found = search(anchors.join(ceilings, "row"),
                   lambda stripe, x, ids, labels, c: stripe.negatives(x, ids, labels, c.to_pylist(), negatives, low, high),
                   ["row", "place", "negative_id", "negative_score"])
    order = Window.partitionBy("row", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.join(chosen, ["row", "place"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
