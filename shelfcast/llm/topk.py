"""Exact top-k search by inner product with norm-sorted vectors.

Candidates are laid out in blocks by descending length. A first look at a
bounded number of the longest vectors gives every query a score that its k-th
best cannot fall below. A query then visits only the blocks that the
Cauchy-Schwarz bound on lengths leaves, and inside a block only candidates
whose partial sum over the leading SVD directions plus the bound on the
residuals can still reach it; those are scored exactly, in integers. Bounds
carry a margin for rounding, so no tie is lost.

The SVD comes from the Gram matrix of all candidates, added up in tasks (its
size depends on the dimension only). The rest of the plan is an equality join
of packed queries with the blocks they still need.

Components are floor(1024 * x). Defined results: vectors that are null, or
hold null or non-finite components, and rows without an id take no part; a
shorter vector counts as padded with zeros; rows that carry the query's own
vec_id are not its candidates; repeated rows of another id are candidates one
by one; equal scores go to the smaller vec_id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

K = 10
SCALE = 1024
BLOCK_ROWS = 4096
#: At most about this many blocks, so that their lengths stay a small table.
MOST_BLOCKS = 1 << 16
FIRST_LOOK = 2048
QUERY_ROWS = 256
LEADING = 16
_STEP = 512


def _packed(batches, width: int, scale: int):
    """(id, little-endian 64-bit components, squared length) of valid rows."""
    import pyarrow as pa
    for batch in batches:
        ids, rows = [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if i is None or v is None or None in v:
                continue
            x = np.floor(np.array(v, np.float64) * scale)
            if not np.isfinite(x).all():
                continue
            x = np.pad(x, (0, width - len(x)))
            ids.append(i)
            rows.append(x)
        raw = np.array(rows).reshape(len(rows), width)
        yield pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([r.astype("<i8").tobytes() for r in raw], pa.binary()),
            pa.array(np.sqrt((raw * raw).sum(1)))], ["id", "v", "norm"])


def _matrix(raw: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<i8").reshape(len(raw), width)


def _gram_rows(batches, width: int):
    import pyarrow as pa
    total = np.zeros((width, width))
    for batch in batches:
        x = _matrix(batch.column(0).to_pylist(), width).astype(float)
        total += x.T @ x
    yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["g"])


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows: floating products are exact while
    every sum stays below 2**53, beyond that whole numbers are used."""
    if not len(q) or not len(x) or float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2.0 ** 53:
        return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
    return q @ x.T


def search_block(q, q_id, least, x, x_id, x_norm, turn, k: int):
    """(query row, candidate row, score) of candidates that can be among the k
    best; x by descending length; ``least``: known lower bounds of the k-th."""
    lead = min(LEADING, q.shape[1])
    qr, xr = q @ turn, x @ turn
    q_norm = np.sqrt((qr * qr).sum(1))
    q_rest, x_rest = np.sqrt((qr[:, lead:] ** 2).sum(1)), np.sqrt((xr[:, lead:] ** 2).sum(1))
    bound = least.astype(float)
    best = np.full((len(q), k), -np.inf)
    out = []
    for a in range(0, len(x), _STEP):
        b = min(len(x), a + _STEP)
        slack = 1e-7 * q_norm * x_norm[a] + 1e-6
        live = np.flatnonzero(q_norm * x_norm[a] + slack >= bound)
        if not len(live):
            if (q_norm * x_norm[a] + slack < bound).all():
                break
            continue
        upper = qr[live, :lead] @ xr[a:b, :lead].T + q_rest[live, None] * x_rest[None, a:b] + slack[live, None]
        qi, xi = np.nonzero(upper >= bound[live, None])
        if not len(qi):
            continue
        scores = np.full(upper.shape, -np.inf)
        if len(qi) * 4 > upper.size:
            scores[qi, xi] = exact_scores(q[live], x[a:b])[qi, xi]
        else:
            for s in range(0, len(qi), 1 << 16):
                p, r = qi[s:s + (1 << 16)], xi[s:s + (1 << 16)]
                scores[p, r] = (q[live[p]] * x[a + r]).sum(1)
        scores[q_id[live][:, None] == x_id[None, a:b]] = -np.inf
        both = np.concatenate([best[live], scores], 1)
        best[live] = -np.partition(-both, k - 1, axis=1)[:, :k]
        bound[live] = np.maximum(bound[live], best[live, k - 1])
        qi, xi = np.nonzero((scores >= bound[live, None]) & (scores > -np.inf))
        out.append((live[qi], a + xi, scores[qi, xi]))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64)
    qi, xi, s = (np.concatenate(c) for c in zip(*out))
    s = s.astype(np.int64)
    by = np.lexsort((x_id[xi], -s, qi))
    qi, xi, s = qi[by], xi[by], s[by]
    first = np.concatenate([[0], np.flatnonzero(np.diff(qi)) + 1]) if len(qi) else np.zeros(0, int)
    place = np.arange(len(qi)) - np.repeat(first, np.diff(np.append(first, len(qi))))
    return qi[place < k], xi[place < k], s[place < k]


def top_k(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score; ``vectors`` has vec_id and embedding,
    ``is_query`` is a condition on vec_id."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    empty = "query_id long, rank int, vec_id long, score long"
    if width <= 0:
        return spark.createDataFrame([], empty)
    valid = materialize(rows.mapInArrow(lambda b: _packed(b, width, scale), "id long, v binary, norm double"), "topk-vectors")
    n = valid.count()
    if n == 0:
        return spark.createDataFrame([], empty)
    gram = sum(np.array(r.g) for r in valid.select("v").mapInArrow(lambda b: _gram_rows(b, width), "g array<double>").toLocalIterator())
    turn = np.ascontiguousarray(np.linalg.eigh(gram.reshape(width, width))[1][:, ::-1])

    size = max(BLOCK_ROWS, -(-n // MOST_BLOCKS))

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        part, number = TaskContext.get().partitionId(), 0

        def block(ids, raw, norms):
            return pa.RecordBatch.from_arrays([
                pa.array([part << 24 | number]), pa.array([norms[0]]), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()),
                pa.array([b"".join(raw)], pa.binary()), pa.array([np.array(norms, "<f8").tobytes()], pa.binary())],
                ["block", "most", "ids", "vs", "norms"])

        ids, raw, norms = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            raw += batch.column(1).to_pylist()
            norms += batch.column(2).to_pylist()
            while len(ids) >= size:
                yield block(ids[:size], raw[:size], norms[:size])
                ids, raw, norms, number = ids[size:], raw[size:], norms[size:], number + 1
        if ids:
            yield block(ids, raw, norms)

    order = [F.col("norm").desc(), F.col("id").asc()]
    blocks = materialize(valid.repartitionByRange(max(1, -(-n // size)), *order).sortWithinPartitions(*order).mapInArrow(
        pack, "block long, most double, ids binary, vs binary, norms binary"), "topk-blocks")
    lengths = sorted(((r.most, r.block) for r in blocks.select("most", "block").collect()), reverse=True)
    head = valid.orderBy(*order).limit(FIRST_LOOK).select("id", "v").collect()
    sent = spark.sparkContext.broadcast((np.array([r.id for r in head]), np.frombuffer(b"".join(bytes(r.v) for r in head), "<i8"),
                                         np.array([m for m, _ in lengths]), np.array([b for _, b in lengths]), turn))

    def first_look(batches):
        import pyarrow as pa
        h_id, h, most, number, _ = sent.value
        h = h.reshape(-1, width)
        for batch in batches:
            for a in range(0, batch.num_rows, QUERY_ROWS):
                ids = np.array(batch.column(0)[a:a + QUERY_ROWS].to_pylist(), np.int64)
                raw = batch.column(1)[a:a + QUERY_ROWS].to_pylist()
                q = _matrix(raw, width)
                s = exact_scores(q, h).astype(float)
                s[ids[:, None] == h_id[None, :]] = -np.inf
                least = -np.partition(-s, k - 1, axis=1)[:, k - 1] if s.shape[1] >= k else np.full(len(q), -np.inf)
                norm = np.sqrt((q.astype(float) ** 2).sum(1))
                reach = (norm[None, :] * most[:, None] * (1 + 1e-7) + 1e-6 >= least[None, :]).any(1)
                yield pa.RecordBatch.from_arrays([
                    pa.array([number[reach].tolist()], pa.list_(pa.int64())), pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                    pa.array([b"".join(raw)], pa.binary()), pa.array([least.astype("<f8").tobytes()], pa.binary())],
                    ["needs", "q_ids", "qs", "least"])

    queries = valid.where(is_query(F.col("id"))).select("id", "v").mapInArrow(
        first_look, "needs array<bigint>, q_ids binary, qs binary, least binary")
    pairs = queries.select(F.explode("needs").alias("block"), "q_ids", "qs", "least").join(
        blocks.select("block", "ids", "vs", "norms"), "block")

    def run(batches):
        import pyarrow as pa
        turn = sent.value[4]
        for batch in batches:
            for r in batch.to_pylist():
                q_id, x_id = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["ids"], "<i8")
                q, x = np.frombuffer(r["qs"], "<i8").reshape(-1, width), np.frombuffer(r["vs"], "<i8").reshape(-1, width)
                qi, xi, s = search_block(q, q_id, np.frombuffer(r["least"], "<f8"), x, x_id, np.frombuffer(r["norms"], "<f8"), turn, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_id[qi]), pa.array(x_id[xi]), pa.array(s)], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


ORACLE = """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10"""
