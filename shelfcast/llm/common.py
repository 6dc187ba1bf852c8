"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, whatever the locale or script."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def replace_columns(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Drop columns that an operator is about to add, so that its results
    replace columns of the same name (in any case) instead of clashing."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def texts_of(column) -> Iterator[bytes]:
    """UTF-8 bytes of an Arrow string column, one row at a time; null: empty."""
    import pyarrow as pa
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    else:
        column = column.cast(pa.binary())
    for v in column:
        b = v.as_py()
        yield b"" if b is None else b


def per_process(key, make):
    """``make()``, once in this Python worker process for each key."""
    import sys
    import types
    held = sys.modules.setdefault("_shelfcast_worker", types.ModuleType("_shelfcast_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def pieces_of(split):
    """Of an Arrow array of lists of strings: the distinct strings, the number
    of each string in order, and where each list begins and ends."""
    import numpy as np
    import pyarrow as pa
    if isinstance(split, pa.ChunkedArray):
        split = split.combine_chunks()
    coded = split.flatten().dictionary_encode()
    offsets = split.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), offsets - offsets[0]


def gather_ids(raw: list[bytes], which, offsets):
    """Token ids of every text, whose pieces are ``which[a:b]`` by offsets;
    ``raw``: each distinct piece's ids as little-endian 32-bit integers."""
    import numpy as np
    flat = np.frombuffer(b"".join(raw), "<i4")
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
    starts = np.cumsum(sizes) - sizes
    n = sizes[which]
    ends = np.cumsum(n)
    at = np.repeat(starts[which] - (ends - n), n)
    at += np.arange(len(at))
    ids = flat[at]
    bounds = np.concatenate([[0], ends])[offsets]
    return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def bounded_runs(batch, at: int, size: int = 1 << 22):
    """Slices of a record batch with about ``size`` bytes of whole texts in
    column ``at`` each."""
    import pyarrow as pa
    import pyarrow.compute as pc
    lengths = pc.fill_null(pc.binary_length(batch.column(at).cast(pa.large_string())), 0).to_pylist()
    begin = total = 0
    for i, n in enumerate(lengths):
        total += n
        if total >= size:
            yield batch.slice(begin, i + 1 - begin)
            begin, total = i + 1, 0
    if begin < len(lengths):
        yield batch.slice(begin)
