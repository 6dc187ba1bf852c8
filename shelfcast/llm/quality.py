"""Quality classifier: Bradley-Terry pairwise ranking of documents.

A document's strength is linear in features of its whole text. Preference
pairs (a good document against a bad one) give a logistic loss on the feature
*differences*; the fitted strengths are cut at the quantile of the score that
equals the labelled share of bad documents, and ``score`` is the probability
that a document beats one that lies exactly on that cut.

Defined results: a null or empty text has the features of zero words and is
scored like any other; a null ``doc_id`` is never held out; repeated rows get
equal scores; without labels of both classes every score is 0.5; columns named
``score`` or ``predicted`` in the input are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import replace_columns, texts_of

#: Documented bound of the sample that the model is fitted on, per class.
TRAIN_ROWS = 4096
#: Opponents that each labelled document meets.
OPPONENTS = 8

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"-()|"]] = True
_UPPER = slice(65, 91)
_LOWER = slice(97, 123)
_DIGIT = slice(48, 58)


def features(text: bytes) -> list[float]:
    """Shape of one whole text: sizes, character classes, repetition."""
    n_bytes = len(text)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x]
    per_byte, per_word, per_line = 1 / max(1, n_bytes), 1 / max(1, n), 1 / max(1, len(lines))
    letters = max(1, int(hist[_UPPER].sum() + hist[_LOWER].sum() + hist[128:].sum()))
    distinct = len(set(words)) if n else 0
    adjacent = sum(map(eq, words, words[1:]))
    same_lines = len(lines) - len(set(lines))
    same_bytes = n_bytes - sum(map(len, set(lines))) if same_lines else 0
    shares = [
        float(hist[_SYMBOLS].sum()) * per_word,
        float(hist[_UPPER].sum()) / letters,
        float(hist[124]) * per_word,                       # bars
        float(hist[33] + hist[63]) * per_word,             # ! and ?
        float(hist[_DIGIT].sum()) * per_byte,
        adjacent * per_word,
        same_lines * per_line,
        same_bytes * per_byte,
    ]
    rest = [
        np.log1p(n),
        np.log1p(len(lines)),
        n_bytes * per_word,
        np.log1p(distinct) - np.log1p(n),
        float(hist[44] + hist[46]) * per_word,             # , and .
        float(hist[128:].sum()) * per_byte,
    ]
    # Shares also enter saturated: a junk part counts even in a long document.
    return [float(x) for x in (*shares, *(x / (x + 0.02) for x in shares), *rest)]


@dataclass(frozen=True)
class Model:
    """Strength = weights . (x - mean) / scale; ``cut`` is the score quantile."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    cut: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(rows), 0.5)
        z = np.clip((rows - np.array(self.mean)) / np.array(self.scale), -20, 20)
        return 1 / (1 + np.exp(-np.clip(z @ np.array(self.weights) - self.cut, -500, 500)))


def fit_pairs(good: np.ndarray, bad: np.ndarray, share_bad: float, l2: float = 1e-2) -> Model:
    """Newton steps on the logistic loss of feature differences good - bad."""
    if not len(good) or not len(bad):
        return Model((), (), (), 0.0)
    both = np.vstack([good, bad])
    mean, scale = both.mean(0), both.std(0)
    scale[scale < 1e-9] = 1.0
    g, b = (np.clip((x - mean) / scale, -20, 20) for x in (good, bad))
    most = max(len(g), len(b))
    at = np.arange(most)
    d = np.vstack([g[(at + 7 * s) % len(g)] - b[(at * (1 + s % 3) + s) % len(b)] for s in range(OPPONENTS)])
    w = np.zeros(d.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))     # the loser's chance
        grad = d.T @ p / len(d) - l2 * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + l2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w + step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    strength = np.concatenate([g @ w, b @ w])
    weight = np.concatenate([np.full(len(g), (1 - share_bad) / len(g)), np.full(len(b), share_bad / len(b))])
    order = np.argsort(strength, kind="stable")
    at = int(np.searchsorted(np.cumsum(weight[order]), share_bad))
    around = strength[order][max(0, at - 1):at + 2]
    return Model(tuple(mean), tuple(scale), tuple(w), float((around[0] + around[-1]) / 2))


def _feature_rows(batches):
    import pyarrow as pa
    for batch in batches:
        rows = [features(t) for t in texts_of(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["y", "x"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents of each class (the smallest
    hashes of doc_id, so the sample spreads over the whole label table).
    ``labels`` holds doc_id and quality and only rows allowed for training."""
    known = (labels.select("doc_id", F.col("quality").cast("int").alias("y"))
             .where("y in (0, 1) and doc_id is not null").distinct())
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model((), (), (), 0.0)
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        picked = part if picked is None else picked.unionByName(part)
    # 2 * rows ids at most: small enough to send to every executor. A repeated
    # doc_id stands for one of its texts (the smallest hash).
    texts = (docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
             .withColumn("h", F.xxhash64("text")))
    firsts = texts.groupBy("doc_id", "y").agg(F.min("h").alias("h"))
    chosen = texts.join(firsts, ["doc_id", "y", "h"], "left_semi").groupBy("doc_id", "y", "h").agg(
        F.first("text").alias("text"))
    got = chosen.select("y", "text").mapInArrow(_feature_rows, "y int, x array<double>").orderBy("x").collect()
    by = {y: np.array([r.x for r in got if r.y == y], float) for y in (0, 1)}
    return fit_pairs(by[1], by[0], sizes[0] / (sizes[0] + sizes[1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every input column plus ``score`` (0 to 1) and ``predicted`` (1 if the
    score is at least 0.5)."""
    docs = replace_columns(docs, ("score", "predicted"))
    at = [c.lower() for c in docs.columns].index("text")
    names = [*docs.columns, "score", "predicted"]

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            x = np.array([features(t) for t in texts_of(batch.column(at))], float)
            s = model.score(x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                names)

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(run, schema)


def held_out(doc_id) -> F.Column:
    """crc32(doc_id as text) mod 3 is 1; such rows never train."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` that the model predicts as good, columns unchanged."""
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            if batch.num_rows:
                s = model.score(np.array([features(t) for t in texts_of(batch.column(at))], float))
                yield batch.filter(pa.array(s >= 0.5))

    return docs.mapInArrow(run, docs.schema)
