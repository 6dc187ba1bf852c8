"""M7: permutation importance of a model's features.

A column is re-paired with the rows by hashed keys: rows go to a bucket by one
hash of their key, and inside the bucket each row takes the column's value of
the row before it in the order of a second, column-wise hash (the first takes
the last one's). That is a permutation of the column, the same on every run and
partitioning, in one shuffle for all columns; buckets keep any task's sort
small. The error of the model with one column re-paired, less its error on the
true rows, is that column's importance; all columns are evaluated in one pass.

A task gets one bucket and sorts its hashes as numbers, column by column; the
rows themselves are never sorted. It holds a bucket, one part in 256 of the
rows, with 16 bytes for each hash and 8 for most values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets by the first two hex digits of the key's hash.
_BUCKET_DIGITS = 2
#: Rows that a task gives back at once.
BATCH = 10_000


def _hash(keys: list[str], salt: str) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(f"`{k}`").cast("string") for k in keys], F.lit(salt)))


def _source(high, low, bucket):
    """Number of the row whose value each row takes: the one before it in the
    order of the hashes (two halves) among its bucket's, or the last."""
    import numpy as np
    source = np.empty(len(bucket), "int64")
    whole = bucket.min() == bucket.max()
    for b in bucket[:1] if whole else np.unique(bucket):
        own = slice(None) if whole else np.flatnonzero(bucket == b)
        first = high[own]
        at = np.argsort(first)
        ordered = first[at]
        if (ordered[1:] == ordered[:-1]).any():
            at = np.lexsort((low[own], first))
        before = np.roll(at, 1)
        source[at if whole else own[at]] = before if whole else own[before]
    return source


def _paired(n: int, changed: list[int]):
    """Task function over a bucket, the first column, then ``n`` columns and the
    hashes: the ``n`` columns and those by the numbers ``changed`` re-paired."""
    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa
        held, buckets, orders = [], [], [[] for _ in changed]
        for batch in batches:
            buckets.append(batch.column(0).to_numpy())
            held.append(pa.RecordBatch.from_arrays(batch.columns[1:n + 1], names=[f"c{i}" for i in range(n)]))
            for i, o in enumerate(orders):
                pairs = batch.column(n + 1 + i).cast(pa.binary(16))
                halves = np.frombuffer(pairs.buffers()[1], ">u8", 2 * len(pairs), pairs.offset * 16)
                o.append([halves[k::2].astype("uint64") for k in (0, 1)])
        if not held:
            return
        bucket, rows = np.concatenate(buckets), pa.Table.from_batches(held).combine_chunks()
        del held, buckets
        for i, c in enumerate(changed):
            source = _source(*map(np.concatenate, zip(*orders[i])), bucket)
            orders[i] = None
            rows = rows.append_column(f"p{i}", rows.column(c).take(pa.array(source)))
        yield from rows.to_batches(max_chunksize=BATCH)
    return run


def permuted(df: DataFrame, keys: list[str], columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Every column of ``df`` (or those of ``keep``) and <column>_permuted for
    each of ``columns``; ``keys`` identify a row."""
    keep = df.columns if keep is None else list(dict.fromkeys([*keep, *columns]))
    bucket = F.conv(F.substring(_hash(keys, ""), 1, _BUCKET_DIGITS), 16, 10).cast("int")
    # Numbered columns clash with no name of the rows. Hashes are made after the shuffle: they would be most of it.
    used = list(dict.fromkeys([*keep, *keys]))
    number = {c: f"c{i}" for i, c in enumerate(used)}
    dealt = df.select(bucket.alias("bucket"), *[F.col(f"`{c}`").alias(n) for c, n in number.items()]).repartitionById(
        16 ** _BUCKET_DIGITS, F.col("bucket"))
    staged = dealt.select("bucket", *[number[c] for c in keep], *[
        F.unhex(_hash([number[k] for k in keys], c)).alias(f"o{i}") for i, c in enumerate(columns)])
    fields = [T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(keep)]
    fields += [T.StructField(f"p{i}", df.schema[c].dataType) for i, c in enumerate(columns)]
    return staged.mapInArrow(_paired(len(keep), [keep.index(c) for c in columns]), T.StructType(fields)).toDF(
        *keep, *[f"{c}_permuted" for c in columns])


def permutation_importance(df: DataFrame, keys: list[str], features: list[str], target: str,
                           predict: Callable[[dict[str, Column]], Column],
                           error: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """feature, base_error, permuted_error, increase, rank (1: largest
    increase, ties by name). ``predict`` makes the prediction from a mapping of
    feature names to columns; ``error`` of (actual, prediction) is averaged
    (default: absolute)."""
    error = error or (lambda a, p: F.abs(a - p))
    own = {f: F.col(f) for f in features}
    y = F.col(target)
    changed = [F.avg(error(y, predict(own | {f: F.col(f"{f}_permuted")}))).alias(f"e{i}") for i, f in enumerate(features)]
    sums = permuted(df, keys, features, [*features, target]).agg(F.avg(error(y, predict(own))).alias("base"), *changed)
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col("base").alias("base_error"), F.col(f"e{i}").alias("permuted_error"),
                              (F.col(f"e{i}") - F.col("base")).alias("increase")) for i, f in enumerate(features)])
    # One row for each feature.
    order = Window.orderBy(F.round("increase", 9).desc(), "feature")
    return sums.select(F.inline(rows)).withColumn("rank", F.row_number().over(order))
