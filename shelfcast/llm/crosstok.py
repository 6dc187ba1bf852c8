"""Alignment of two tokenizers over the same texts, in Arrow.

Both tokenizers cut the same bytes (a blank and the text). A task takes a run
of whole texts and works on flat Arrow columns: the lists of token ids are
flattened with their parent indices, byte lengths are looked up and summed up
within each document, and the two tables of token ends are joined by Acero on
(document, end). Where both sides match, a group ends; in the order of the
ends, every row of the outer join is the overlap of exactly one token of each
side (the next end of either side is that of the token which covers it), so the
rows are the links. ``Table.group_by`` counts the links of each document and
lists for each run its pairs of ids: in which documents and how often.

Spark adds the partial counts of all runs up to the number of documents that
hold a pair, marks the best partners of every id of the first tokenizer, joins
the result back to the runs' rows and sums it up by document. Texts are read
and encoded once; the run rows are stored in the shared folder.

A run is cut after ``RUN_BYTES`` of whole texts; results don't depend on it.

Defined results: a text that is null or empty, or whose joined token bytes of
either side are not the blank and the text, has no tokens (counts 0, an empty
digest). Strings of special tokens inside texts are plain text. Every row is a
document of its own, repeated rows and rows without an id too. Input columns
named like a result are replaced; ``text`` is not among the results.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import materialize
from .bpe import byte_symbols
from .common import bounded_runs, per_process, replace_columns

RUN_BYTES = 1 << 21
#: A run's documents at most, and how often a pair is linked in one entry at
#: most: both fit into a 32-bit number. More links take several entries.
RUN_DOCS, TIMES_BITS = 1 << 13, 17
#: The public pre-tokenizer rule of byte-level BPE (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Text of a token of raw bytes in a piece vocabulary, and its mark of a blank.
BLANK = "▁"
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


class ByteSide:
    """Byte-level BPE of a tokenizers JSON file."""

    def __init__(self, spec: bytes):
        import tiktoken
        data = json.loads(spec)
        model, before = data["model"], data["pre_tokenizer"] or {}
        if (model["type"], before.get("type")) != ("BPE", "ByteLevel") or data["normalizer"] or before.get("add_prefix_space"):
            raise ValueError("not a plain byte-level BPE tokenizer")
        back = {c: b for b, c in enumerate(byte_symbols())}
        own = {bytes(back[c] for c in t): i for t, i in model["vocab"].items() if all(c in back for c in t)}
        merged = [own[bytes(back[c] for c in "".join(pair.split(" ") if isinstance(pair, str) else pair))]
                  for pair in model["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])):
            raise ValueError("ids are not in the order of the merges")
        # Ids in merge order are the ranks; what is only an added token is no result of merges.
        reach = set(merged) | {own[bytes([b])] for b in range(256)}
        ranks = {t: i for t, i in own.items() if i in reach}
        self.coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.bytes_of[i] = t

    def encode(self, texts: list[str]) -> list:
        return [self.coder.encode_ordinary(" " + t) for t in texts]


class PieceSide:
    """A sentencepiece model that adds the blank itself."""

    def __init__(self, spec: bytes):
        import sentencepiece
        self.coder = s = sentencepiece.SentencePieceProcessor(model_proto=spec)
        self.bytes_of = [bytes([int(p[3:5], 16)]) if s.is_byte(i) else b"" if s.is_control(i) else p.replace(BLANK, " ").encode()
                         for i, p in ((i, s.id_to_piece(i)) for i in range(s.get_piece_size()))]

    def encode(self, texts: list[str]) -> list:
        return self.coder.encode(texts, num_threads=1)


class Tables:
    """Arrow tables of a tokenizer: bytes, byte length and decimal name of every id."""

    def __init__(self, side):
        import pyarrow as pa
        self.encode = side.encode
        self.bytes_of = pa.array(side.bytes_of, pa.large_binary())
        self.sizes = pa.array([len(b) for b in side.bytes_of], pa.int64())
        self.names = pa.array(list(map(str, range(len(side.bytes_of)))), pa.large_string())


def _sides(key: str, a: bytes, b: bytes) -> tuple[Tables, Tables]:
    return per_process(("crosstok", key), lambda: (Tables(ByteSide(a)), Tables(PieceSide(b))))


def _spells(tables: Tables, lists, raw: list[bytes]) -> np.ndarray:
    """Whether each document's joined token bytes are the given ones."""
    import pyarrow.compute as pc
    taken = pc.take(tables.bytes_of, pc.list_flatten(lists))
    offsets = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, taken.offset * 8)
    bounds = offsets[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
    data = memoryview(taken.buffers()[2] or b"").cast("B")
    return np.array([b - a == len(r) and data[a:b] == r for a, b, r in zip(bounds[:-1], bounds[1:], raw)], bool)


def _ends(tables: Tables, lists, name: str):
    """(doc, end, id) of every token: the end counts bytes from the document's start."""
    import pyarrow as pa
    import pyarrow.compute as pc
    ids, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
    total = pc.cumulative_sum(pc.take(tables.sizes, ids))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    last = np.cumsum(counts)
    ends = np.concatenate([[0], total.to_numpy()])
    before = pa.array(ends[last - counts])
    return pa.table({"doc": doc, "end": pc.subtract(total, pc.take(before, doc)), name: ids})


def _join(strings, offsets, by: str):
    """Each stretch of strings as one."""
    import pyarrow as pa
    import pyarrow.compute as pc
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), strings)
    return pc.binary_join(lists, pa.scalar(by, strings.type))


def _joined(names, ids, offsets):
    """Decimal ids of each stretch, joined by commas."""
    import pyarrow.compute as pc
    return _join(pc.take(names, ids), offsets, ",")


def align_run(a: Tables, b: Tables, texts: list[str | None]):
    """Of a run of texts: n_a, n_b, n_groups, n_links and the groups' text, one
    for each document, and the table (doc, a, b, times) of its linked pairs."""
    import pyarrow as pa
    import pyarrow.compute as pc
    n = len(texts)
    full = [i for i, t in enumerate(texts) if t]
    own = [texts[i] for i in full]
    lists = [pa.array(s.encode(own), pa.list_(pa.int32())) for s in (a, b)]
    raw = [b" " + t.encode() for t in own]
    fits = np.logical_and(*(_spells(s, x, raw) for s, x in zip((a, b), lists)))
    docs = np.array(full, np.int64)[fits]
    lists = [x.filter(pa.array(fits)) for x in lists]
    counts = np.zeros((4, n), np.int64)
    groups = [""] * n
    left, right = (_ends(s, x, name) for s, x, name in zip((a, b), lists, "ab"))
    # Ends that only one side has are kept with the other side's id null.
    ends = left.join(right, ["doc", "end"], join_type="full outer", use_threads=False).sort_by(
        [("doc", "ascending"), ("end", "ascending")]).combine_chunks()
    if not ends.num_rows:
        return counts, groups, pa.table({"doc": pa.array([], pa.int32()), "a": pa.array([], pa.int32()),
                                         "b": pa.array([], pa.int32()), "times": pa.array([], pa.int64())})
    doc = ends["doc"].combine_chunks()
    of_doc = doc.to_numpy(zero_copy_only=False)
    is_a, is_b = (ends[s].is_valid().to_numpy(zero_copy_only=False) for s in "ab")
    both = is_a & is_b
    for k, chosen in enumerate((is_a, is_b, both, np.ones(len(both), bool))):
        counts[k, docs] = np.bincount(of_doc[chosen], minlength=len(docs))
    # A group ends at a token of either side that ends with one of the other.
    parts = [_joined(s.names, ids["ab"[k]].combine_chunks(), np.concatenate([[0], np.flatnonzero(both[own]) + 1]))
             for k, (s, ids, own) in enumerate(((a, left, is_a), (b, right, is_b)))]
    each = pc.binary_join_element_wise(*parts, pa.scalar("|", parts[0].type))
    per_doc = np.concatenate([[0], np.cumsum(counts[2, docs])])
    for i, text in zip(docs.tolist(), _join(each, per_doc, ";").to_pylist()):
        groups[i] = text
    links = pa.table({"doc": pc.take(pa.array(docs, pa.int32()), doc), "a": pc.fill_null_backward(ends["a"]),
                      "b": pc.fill_null_backward(ends["b"])})
    pairs = links.group_by(["doc", "a", "b"], use_threads=False).aggregate([([], "count_all")])
    return counts, groups, pairs.rename_columns(["doc", "a", "b", "times"])


def entries(pairs):
    """(a, b, docs, first): each document of a pair as document << TIMES_BITS |
    times; ``first`` is 1 once for each document."""
    import pyarrow as pa
    times = pairs["times"].to_numpy().astype(np.int64)
    most = (1 << TIMES_BITS) - 1
    parts = -(-times // most)
    at = np.repeat(np.arange(len(times)), parts)
    first = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)
    part = np.where(first, times[at] - (parts[at] - 1) * most, most)
    code = pairs["doc"].to_numpy().astype(np.int64)[at] << TIMES_BITS | part
    return pa.table({"a": pairs["a"].take(pa.array(at)), "b": pairs["b"].take(pa.array(at)), "docs": pa.array(code.astype(np.int32)),
                     "first": pa.array(first.astype(np.int32))})


class Alignment:
    """The aligned corpus: what each document has, and how ids pair up."""

    def __init__(self, docs: DataFrame, byte_bpe_path: str, piece_path: str, texts: bool = False):
        """``texts``: keep the groups' text of each document as column ``groups``."""
        with open(byte_bpe_path, "rb") as f, open(piece_path, "rb") as g:
            spec = f.read(), g.read()
        key = hashlib.sha256(spec[0] + spec[1]).hexdigest()
        sent = docs.sparkSession.sparkContext.broadcast(spec)
        own = replace_columns(docs, (*RESULTS, "groups", "text"))
        names = own.columns
        kept = docs.select(F.struct(F.lit(0).alias("row"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("own"),
                           F.col("text").cast("string").alias("text"))
        whole = [("run", T.LongType()), ("pos", T.IntegerType()), ("own", kept.schema["own"].dataType)]
        whole += [(c, T.LongType()) for c in RESULTS[:4]]
        whole += [("groups_sha256", T.StringType()), ("groups", T.StringType()), ("pairs", T.ArrayType(T.StructType([
            T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("n", T.IntegerType()),
            T.StructField("docs", T.ArrayType(T.IntegerType()))])))]
        schema = T.StructType([T.StructField(c, t) for c, t in whole])

        def work(batches):
            import pyarrow as pa
            import pyarrow.compute as pc
            from pyspark import TaskContext
            sides = _sides(key, *sent.value)
            run = TaskContext.get().partitionId() << 32
            for batch in batches:
                pair = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32()), ("docs", pa.list_(pa.int32()))])
                kinds = {"own": batch.schema.field("own").type, "groups_sha256": pa.string(), "groups": pa.string(),
                         "run": pa.int64(), "pos": pa.int32(), "pairs": pa.list_(pair)} | dict.fromkeys(RESULTS[:4], pa.int64())

                def rows(size, **columns):
                    return pa.RecordBatch.from_arrays(
                        [columns[c].cast(kinds[c]) if c in columns and c != "own" else columns.get(c, pa.nulls(size, kinds[c]))
                         for c, _ in whole], [c for c, _ in whole])

                slices = (batch.slice(k, RUN_DOCS) for k in range(0, batch.num_rows, RUN_DOCS))
                for part in (p for s in slices for p in bounded_runs(s, 1, RUN_BYTES)):
                    counts, groups, pairs = align_run(*sides, part.column(1).to_pylist())
                    size, run = part.num_rows, run + 1
                    digests = pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups], pa.string())
                    yield rows(size, run=pa.array([run] * size), pos=pa.array(np.arange(size)), own=part.column(0),
                               groups_sha256=digests, **({"groups": pa.array(groups, pa.string())} if texts else {}),
                               **{c: pa.array(x) for c, x in zip(RESULTS, counts)})
                    by = entries(pairs).group_by(["a", "b"], use_threads=False).aggregate(
                        [("first", "sum"), ("docs", "list")]).combine_chunks()
                    columns = [by[c].combine_chunks().cast(pair.field(f).type) for f, c in
                               (("a", "a"), ("b", "b"), ("n", "first_sum"), ("docs", "docs_list"))]
                    held = pa.StructArray.from_arrays(columns, fields=list(pair))
                    yield rows(1, run=pa.array([run]), pairs=pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held))

        self._runs = materialize(kept.mapInArrow(work, schema), "crosstok-runs")
        self._names, self._texts = names, texts

    def _pairs(self) -> DataFrame:
        """The pairs of each run by number ``i``."""
        return self._runs.where("pairs IS NOT NULL").select("run", F.posexplode("pairs").alias("i", "p")).select(
            "run", "i", "p.a", "p.b", "p.n")

    def pair_counts(self) -> DataFrame:
        """a, b, documents (how many hold the two ids linked), best (no partner
        of ``a`` is in more documents)."""
        counts = self._pairs().groupBy("a", "b").agg(F.sum("n").alias("documents"))
        most = F.max("documents").over(Window.partitionBy("a"))
        return counts.withColumn("best", F.col("documents") == most)

    def documents(self) -> DataFrame:
        """Every input column but text, and ``RESULTS``.

        The runs' pairs are looked up without their documents; what was found
        goes back to its run, one row a run on both sides, so the sums by
        document stay within the run and add no shuffle of their own."""
        known = self._pairs().join(self.pair_counts(), ["a", "b"]).groupBy("run").agg(
            F.array_sort(F.collect_list(F.struct("i", "documents", "best"))).alias("known"))
        runs = self._runs.where("pairs IS NOT NULL").select("run", "pairs")
        linked = runs.join(known, "run").select("run", F.inline(F.arrays_zip(
            F.col("pairs.docs").alias("docs"), F.col("known.documents").alias("documents"), F.col("known.best").alias("best")))).select(
            "run", "documents", "best", F.explode("docs").alias("code")).select(
            "run", F.shiftright("code", TIMES_BITS).alias("pos"), F.col("code").bitwiseAND((1 << TIMES_BITS) - 1).alias("times"),
            "documents", "best")
        sums = linked.groupBy("run", "pos").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                                                F.sum(F.col("times") * F.col("documents")).alias("count_sum"))
        rows = self._runs.where("pairs IS NULL").join(sums, ["run", "pos"], "left")
        zero = F.lit(0).cast("long")
        return rows.select(*[F.col(f"own.c{i}").alias(c) for i, c in enumerate(self._names)], *RESULTS[:4],
                           F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"),
                           "groups_sha256", *["groups"] * self._texts)
