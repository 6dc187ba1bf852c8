"""SimHash near-duplicates by deletion-variant signatures.

Fingerprint: words are runs of characters other than ASCII white space, after
lower-casing A-Z; each shingle of ``shingle`` words (the whole sequence if
there are fewer) is hashed by XXH64, and a bit is set if more than half of the
hashes set it. A text without words has fingerprint zero.

Two fingerprints are linked if they differ in at most two bits. The 64 bits
are cut into only two segments, so that of two differing bits at least one
segment holds at most one. Each distinct fingerprint is indexed by every
segment with one bit replaced by a wildcard (and by the bare segment), and an
equality join pairs the fingerprint whose wildcard bit is 0 with the one whose
bit is 1. To keep groups of near copies from meeting in one bucket, a key also
carries a part of the other segment that must agree: with one bit left to
differ one of two halves agrees, with two bits left one of three parts. Every
pair is verified. Components run over distinct fingerprints only, so copies
are never expanded into pairs.

Defined results: null text counts as empty; rows with equal fingerprints
(repeated rows and empty texts included) are one group; a null doc_id takes
part in links, and a component has a null id only if it has no other doc_id.
Input columns named like a result are replaced.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import replace_columns, texts_of
from .components import connected

#: Bits that may differ; the signature scheme below is built for exactly two.
MAX_BITS = 2
SHINGLE = 3
SEED = 42
_CHUNK = 1 << 18


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of one whole text as an unsigned number."""
    import xxhash
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams, n = iter([b" ".join(words)]), 1
    else:
        grams, n = map(b" ".join, zip(*(words[i:] for i in range(shingle)))), len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        size = min(_CHUNK, n - at)
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED, size)), np.uint64, size)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(size, 8), axis=1,
                              bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE, keep_text: bool = True) -> DataFrame:
    """Every input column (``text`` only if asked for) plus ``fp``: the
    fingerprint as a signed long."""
    docs = replace_columns(docs, ("fp",))
    at = [c.lower() for c in docs.columns].index("text")
    stay = [i for i in range(len(docs.columns)) if keep_text or i != at]
    names = [docs.columns[i] for i in stay] + ["fp"]

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in texts_of(batch.column(at))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in stay), pa.array(fps.view(np.int64))], names)

    schema = T.StructType([*(docs.schema.fields[i] for i in stay), T.StructField("fp", T.LongType())])
    return docs.mapInArrow(run, schema)


def _signatures(fps: DataFrame) -> DataFrame:
    """One row per index key of each distinct fingerprint: ``key``, ``side``
    (0: the wildcard bit is 0, 1: it is 1, 2: no wildcard), ``fp``."""
    half = F.array(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32))
    base = fps.select("fp", F.posexplode(F.array(F.struct(half[0].alias("own"), half[1].alias("other")),
                                                 F.struct(half[1].alias("own"), half[0].alias("other")))).alias("seg", "s"))
    own, other = F.col("s.own"), F.col("s.other")
    one = base.select("fp", "seg", own.alias("own"), other.alias("other"),
                      F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v"))
    mask = F.expr("shiftleft(CAST(1 AS BIGINT), CAST(v % 32 AS INT))")
    agreed = F.when(F.col("v") < 32, F.col("other").bitwiseAND(F.lit(0xFFFF))).otherwise(
        F.shiftrightunsigned("other", 16))
    wildcard = one.select(
        F.xxhash64("seg", "v", F.col("own").bitwiseAND(F.bitwise_not(mask)), agreed).alias("key"),
        F.when(F.col("own").bitwiseAND(mask) != 0, 1).otherwise(0).cast("byte").alias("side"), "fp")
    cuts = F.array(other.bitwiseAND(F.lit(0x7FF)), F.shiftrightunsigned(other, 11).bitwiseAND(F.lit(0x7FF)),
                   F.shiftrightunsigned(other, 22))
    bare = (base.select("fp", "seg", own.alias("own"), F.posexplode(cuts).alias("part", "agreed"))
            .select(F.xxhash64("seg", F.col("part") + 64, "own", "agreed").alias("key"),
                    F.lit(2).cast("byte").alias("side"), "fp"))
    return wildcard.unionByName(bare)


def links(fps: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of distinct fingerprints (column ``fp``, without
    repeats) at most two bits apart. A pair may come more than once."""
    keyed = _signatures(fps)
    # Spark sizes the keys by the fingerprints' file, as if none were exploded,
    # so it would broadcast both hundred times what it counts on: never here.
    left = keyed.where("side != 1").select("key", "side", F.col("fp").alias("a"))
    right = keyed.where("side != 0").select("key", F.col("side").alias("side_b"), F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    kinds = ((F.col("side") == 0) & (F.col("side_b") == 1)) | \
            ((F.col("side") == 2) & (F.col("side_b") == 2) & (F.col("a") < F.col("b")))
    return left.join(right.hint("merge"), "key").where(kinds & near).select("a", "b")


def components(fps: DataFrame) -> DataFrame:
    """``fp`` and ``label`` (one fingerprint of its component) for distinct
    fingerprints ``fp``."""
    linked = connected(links(fps), "a", "b").withColumnRenamed("node", "fp")
    return fps.join(linked, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"))


def _checked(max_bits: int) -> None:
    if max_bits != MAX_BITS:
        raise ValueError("the two-segment signatures are built for two differing bits")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id
    reachable over links, the own one included) of every row."""
    _checked(max_bits)
    marked = materialize(with_fingerprint(docs.select("doc_id", "text"), shingle, keep_text=False), "simhash-docs")
    heads = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-fps")
    grouped = heads.join(components(heads.select("fp")), "fp")
    smallest = grouped.groupBy("label").agg(F.min("first_id").alias("component_id"))
    per_fp = grouped.select("fp", "label").join(smallest, "label").select("fp", "component_id")
    return marked.join(per_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component stays: the first by (doc_id, nulls last; hash
    of the text); of fully equal rows one. Columns are unchanged."""
    _checked(max_bits)
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    marked = materialize(with_fingerprint(hashed, shingle, keep_text=False), "simhash-docs")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    heads = materialize(marked.groupBy("fp").agg(F.min(order).alias("first")), "simhash-fps")
    grouped = heads.join(components(heads.select("fp")), "fp")
    winners = grouped.groupBy("label").agg(F.min("first").alias("first")).select(
        F.col("first.doc_id").alias("k_id"), F.col("first.h").alias("k_h"))
    found = docs.withColumn("k_h_", F.xxhash64("text")).join(
        winners, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("k_h_") == F.col("k_h")), "left_semi")
    if marked.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return found.drop("k_h_")
    # Rows that share doc_id and text are one document: one of them stays.
    rest = [c for c in docs.columns if c.lower() != "doc_id"]
    return found.groupBy("doc_id", "k_h_").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("r")).select(
        *[F.col("doc_id") if c.lower() == "doc_id" else F.col(f"r.`{c}`") for c in docs.columns])
