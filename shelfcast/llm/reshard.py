"""Minimum-cost-flow resharding.

Old shards supply their bytes, new shards demand equal capacities; bytes that
stay in their shard cost nothing, bytes that move cost one each. A minimum-cost
flow over the shards says how many bytes each old shard sends to each new one
and so moves the fewest bytes; blocks of documents then fill those amounts.
``Plan.write`` lays out every document in the new shards; ``Plan.move``, for old
shards that lie in place already, writes only those whose shard changes.

Within an old shard documents lie in blocks by falling size class, so that
every border between two new shards falls among small documents. Offsets are
two-level prefix sums: sums per block (grouped, then added up over the blocks
of a shard), and running sums inside a block; no shard is ever one task. The
number of blocks grows with the rows, so blocks stay bounded; the driver holds
one number per old shard and per flow.

Law ``bytes``: sizes are near equal (each border is off by at most half a
document). A document's size is its text's UTF-8 bytes (null: none) plus 8.
Defined results: null doc_ids and repeated rows are placed like any other;
equal rows may trade places. Input columns named like a result are replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ensure_checkpoint_dir, materialize
from .common import replace_columns

OVERHEAD = 8
#: The sharding that the query starts from: so many shards by doc_id.
OLD_SHARDS = 16
NEW_SHARDS = 24
ROWS_PER_PART = 1_000_000
_RESULT = ("size", "text_crc32", "old_shard", "shard", "slot")


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Flows (old, new) -> bytes of a cheapest transport, by successive
    shortest augmenting paths. Total capacity must cover the supply."""
    if sum(capacity) < sum(supply):
        raise ValueError("the new shards cannot hold all bytes")
    m, n = len(supply), len(capacity)
    left, room = list(supply), list(capacity)
    flow: dict[tuple[int, int], int] = {}
    while any(left):
        # Bellman-Ford from the old shards that still hold bytes; backward
        # arcs exist where something flows.
        far_old = [0 if left[i] else float("inf") for i in range(m)]
        far_new = [float("inf")] * n
        from_old: list = [None] * n
        from_new: list = [None] * m
        changed = True
        while changed:
            changed = False
            for i in range(m):
                if far_old[i] == float("inf"):
                    continue
                for j in range(n):
                    d = far_old[i] + cost(i, j)
                    if d < far_new[j]:
                        far_new[j], from_old[j], changed = d, i, True
            for (i, j), f in flow.items():
                if f and far_new[j] - cost(i, j) < far_old[i]:
                    far_old[i], from_new[i], changed = far_new[j] - cost(i, j), j, True
        end = min((j for j in range(n) if room[j]), key=lambda j: far_new[j])
        path, j, amount = [], end, room[end]
        while True:
            i = from_old[j]
            path.append((i, j, 1))
            if from_new[i] is None or (left[i] and far_old[i] == 0):
                amount = min(amount, left[i])
                break
            j = from_new[i]
            path.append((i, j, -1))
            amount = min(amount, flow[(i, j)])
        for a, b, sign in path:
            flow[(a, b)] = flow.get((a, b), 0) + sign * amount
        left[i] -= amount
        room[end] -= amount
    return {k: v for k, v in flow.items() if v}


def size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def even(total: int, shards: int) -> list[int]:
    """Capacities that differ by one byte at most."""
    return [total // shards + (j < total % shards) for j in range(shards)]


class Plan:
    """Where every document goes. ``blocks`` has, per block, its offset in the
    old shard and its first slot in each new shard; ``borders`` the ends of the
    pieces of each old shard and their new shards."""

    def __init__(self, docs: DataFrame, old_shard: Column, n_old: int, n_new: int, capacity: list[int] | None = None):
        self.n_new = n_new
        rows = docs.count()
        self.parts = 1 + rows // ROWS_PER_PART
        self.old_shard = old_shard
        light = materialize(self._base(docs.select("doc_id", "text")).drop("text"), "reshard-sizes")
        key = ["old_shard", "class", "part"]
        blocks = materialize(light.groupBy(*key).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "reshard-blocks")
        along = Window.partitionBy("old_shard").orderBy(F.col("class").desc(), "part").rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.withColumn("offset", F.coalesce(F.sum("bytes").over(along), F.lit(0)))
        sizes = {r.old_shard: r.s for r in blocks.groupBy("old_shard").agg(F.sum("bytes").alias("s")).collect()}
        supply = [sizes.get(i, 0) for i in range(n_old)]
        self.capacity = capacity or even(sum(supply), n_new)
        self.flow = min_cost_flow(supply, self.capacity, lambda i, j: int(i != j))
        borders = []
        for i in range(n_old):
            mine = sorted(((j != i, j, f) for (o, j), f in self.flow.items() if o == i))
            end, ends = 0, []
            for _, j, f in mine:
                end += f
                ends.append((end, j))
            if ends:
                borders.append((i, ends))
        spark = docs.sparkSession
        self.borders = spark.createDataFrame(borders, "old_shard int, ends array<struct<till: bigint, to: int>>")
        self.offsets = blocks.select(*key, "offset")
        counts = self._placed(light).groupBy("shard", *key).agg(F.count("*").alias("n"))
        before = Window.partitionBy("shard").orderBy("old_shard", F.col("class").desc(), "part").rowsBetween(
            Window.unboundedPreceding, -1)
        first = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
        self.blocks = materialize(self.offsets.join(
            first.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("shard", "first"))).alias("firsts")), key),
            "reshard-plan")
        self.light = light

    def _base(self, docs: DataFrame) -> DataFrame:
        own = size()
        return replace_columns(docs, _RESULT).select(
            "*", own.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
            self.old_shard.cast("int").alias("old_shard"), F.floor(F.log2(own) * 4).cast("int").alias("class"),
            F.pmod(F.xxhash64(F.lit(3), "doc_id", "text"), F.lit(self.parts)).cast("int").alias("part"))

    def _placed(self, base: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
        """Adds ``shard``: the piece in which the document's middle lies."""
        key = ["old_shard", "class", "part"]
        inside = Window.partitionBy(*key).orderBy(F.col("size").desc(), "doc_id", "text_crc32").rowsBetween(
            Window.unboundedPreceding, -1)
        at = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2
        # One row per old shard: small enough to send everywhere.
        got = base.join(blocks if blocks is not None else self.offsets, key).withColumn("at", at).join(F.broadcast(self.borders), "old_shard")
        piece = F.filter("ends", lambda e: e["till"] > F.col("at"))
        return got.withColumn("shard", F.coalesce(F.get(piece, F.lit(0)), F.element_at("ends", -1))["to"])

    def assign(self, docs: DataFrame | None = None) -> DataFrame:
        """Every column of ``docs`` (without: doc_id) plus size, text_crc32,
        old_shard, shard and slot (gapless from 0 in each shard)."""
        base = self.light if docs is None else self._base(docs)
        names = [c for c in base.columns if c not in ("class", "part")] + ["shard", "slot"]
        order = Window.partitionBy("old_shard", "class", "part", "shard").orderBy(F.col("size").desc(), "doc_id", "text_crc32")
        return self._placed(base, self.blocks).withColumn(
            "slot", (F.element_at("firsts", F.col("shard")) + F.row_number().over(order) - 1).cast("long")).select(*names)

    def _written(self, rows: DataFrame, root: str | None) -> DataFrame:
        spark = rows.sparkSession
        root = root or f"{ensure_checkpoint_dir(spark).rstrip('/')}/reshard-{uuid.uuid4().hex}"
        rows.write.partitionBy("shard").parquet(root)
        return spark.read.schema(rows.schema).parquet(root)

    def move(self, docs: DataFrame, root: str | None = None) -> DataFrame:
        """Writes the documents whose shard changes to ``root``/shard=K and
        returns them as read from there. What stays is not touched."""
        return self._written(self.assign(docs).where("shard != old_shard"), root)

    def write(self, docs: DataFrame, root: str | None = None) -> DataFrame:
        """Writes every document, moved or not, to ``root``/shard=K and returns
        the whole new layout as read from there."""
        return self._written(self.assign(docs), root)


def old_layout(n_old: int = OLD_SHARDS) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(n_old)).cast("int")
