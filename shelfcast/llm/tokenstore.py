"""Token-id files: documents compressed one by one with a shared dictionary.

A zstandard dictionary is trained on the serialized id arrays of a bounded
sample of documents. Every document's ids are serialized as little-endian
unsigned integers (two bytes wide if the vocabulary allows, else four) and
compressed on their own with that dictionary, so a reader decompresses only
the document it wants.

File layout (all numbers little-endian):
  8 bytes   magic ``SCTOK001``
  32 bytes  SHA-256 of the dictionary
  8 bytes   width of an id, 8 bytes number of documents, 8 bytes flags (0)
  frames    one zstandard frame per document, back to back
  index     per document: offset of its frame (u64), ids before it in the
            file (u64), its number of ids (u64); then the end of the frames
  8 bytes   offset of the index, 8 bytes magic again

Documents lie in ascending order of doc_id (nulls first, ties by the text's
hash) within and across files. A task writes its file under a name of its own
and its name reaches the manifest only if the task succeeds, so retried or
duplicate tasks never mix; the manifest, dictionary and files are in one
folder under the shared checkpoint folder.

Defined results: null text counts as empty; each document ends with ``end_id``
(an empty one holds nothing else); repeated rows are stored once each.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import uuid
import zlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, materialize
from .common import bounded_runs, gather_ids, per_process, pieces_of

MAGIC = b"SCTOK001"
#: Bounded sample that the dictionary is trained on.
SAMPLE_DOCS = 1000
SAMPLE_CHARS = 8192
DICTIONARY_BYTES = 1 << 16
LEVEL = 3
#: Pieces that a worker remembers before it starts anew.
REMEMBERED = 1_200_000


#: Letters of one alphabet with at most one mark after them: the tokenizer sees
#: a word, and the mark as a word of its own.
_SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)")


class CachedTokenizer:
    """The tokenizers library behind a table of pieces already encoded.

    Pieces are cut at blanks and line ends, which the tokenizer drops; a piece
    is encoded by the library the first time it is seen. New plain words go to
    the library many at a time and are told apart by their word-end tokens.
    What may be cut, lower-cased or joined is probed on the tokenizer itself.
    """

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer
        self.t = Tokenizer.from_str(spec.decode())
        self.t.no_truncation()
        self.t.no_padding()
        self.seen: dict[str, bytes] = {}
        data = json.loads(spec)
        model = data["model"]
        self.special = [t["content"] for t in data["added_tokens"]]
        suffix = model.get("end_of_word_suffix")
        self.ends = np.zeros(self.t.get_vocab_size(with_added_tokens=True) + 1, bool)
        if suffix:
            self.ends[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True
        apart = lambda *words: b"".join(map(self._one, words))
        # Only a tokenizer that treats blanks as mere separators may be cut.
        self.cuts = all(self._one(x) == apart("a", "b") for x in ("a b", "a  b", " a b ", "a\nb", "a \r\n\t\v\fb"))
        probes = [chr(c) for c in range(65, 256) if _SIMPLE.fullmatch(chr(c))]
        self.plain = self.cuts and bool(suffix) and all(
            self._one("a" + c) == self._one("a" + c.lower()) and self.ends[np.frombuffer(self._one("a" + c), "<i4")].sum() == 1
            and all(self._one(c + m) == apart(c, m) for m in ".,;:!?") for c in probes)

    def _one(self, text: str) -> bytes:
        return np.array(self.t.encode(text, add_special_tokens=False).ids, "<i4").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        seen, words, rest, later = self.seen, set(), [], []
        for p in pieces:
            m = _SIMPLE.fullmatch(p) if self.plain else None
            if m is None:
                rest.append(p)
                continue
            word = m[1].lower()
            later.append((p, word, m[2]))
            if word not in seen:
                words.add(word)
        todo = list(words)
        for at in range(0, len(todo), 8192):
            part = todo[at:at + 8192]
            lines = [part[i:i + 64] for i in range(0, len(part), 64)]
            for line, x in zip(lines, self.t.encode_batch_fast([" ".join(w) for w in lines], add_special_tokens=False)):
                ids = np.array(x.ids, "<i4")
                stop = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
                if len(stop) != len(line):
                    raise ValueError("the tokenizer's words differ from its probes")
                raw = ids.tobytes()
                seen.update(zip(line, [raw[a:b] for a, b in zip([0, *stop], stop)]))
        for at in range(0, len(rest), 4096):
            part = rest[at:at + 4096]
            seen.update(zip(part, (np.array(x.ids, "<i4").tobytes()
                                   for x in self.t.encode_batch_fast(part, add_special_tokens=False))))
        for p, word, mark in later:
            if mark and mark not in seen:
                seen[mark] = self._one(mark)
            seen[p] = seen[word] + seen[mark] if mark else seen[word]

    def encode_batch(self, texts) -> list[np.ndarray]:
        """Ids of each text of an Arrow string array (null: none)."""
        import pyarrow.compute as pc
        texts = pc.fill_null(texts, "")
        if not self.cuts:
            return [np.array(x.ids, "<i4") for x in self.t.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        if self.plain:
            # Letters' case is lost in the tokenizer anyway, unless it makes a special token.
            low = pc.ascii_lower(texts)
            if not any(pc.any(pc.match_substring(low, s, ignore_case=True)).as_py() for s in self.special):
                texts = low
        distinct, which, offsets = pieces_of(pc.ascii_split_whitespace(texts))
        if len(self.seen) > REMEMBERED:
            self.seen = {}
        unseen = [p for p in distinct if p not in self.seen]
        if unseen:
            self._learn(unseen)
        return gather_ids(list(map(self.seen.__getitem__, distinct)), which, offsets)


def _tokenizer(spec: bytes) -> CachedTokenizer:
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark runs one task per core
    return per_process(("tokens", hashlib.sha256(spec).digest()), lambda: CachedTokenizer(spec))


def train_dictionary(docs: DataFrame, spec: bytes, end_id: int, width: int, sample_docs: int = SAMPLE_DOCS) -> bytes:
    """Dictionary from the ids of the beginnings of a fixed number of
    documents, those with the smallest hashes."""
    import zstandard
    sample = (docs.where("text is not null").select(F.xxhash64("text").alias("h"), F.substring("text", 1, SAMPLE_CHARS).alias("t"))
              .orderBy("h", "t").limit(sample_docs).select("t"))

    def run(batches):
        import pyarrow as pa
        coder = _tokenizer(spec)
        for batch in batches:
            got = [x for part in bounded_runs(batch, 0) for x in coder.encode_batch(part.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([_serialized(x, end_id, width) for x in got], pa.binary())], ["b"])

    samples = [bytes(r.b) for r in sample.mapInArrow(run, "b binary").collect()]
    if sum(map(len, samples)) < 1 << 14 or len(samples) < 8:
        return b""                                      # too little to train on: plain frames
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _serialized(ids: np.ndarray, end_id: int, width: int) -> bytes:
    return np.append(ids, end_id).astype(f"<u{width}").tobytes()


def _codec(dictionary: bytes):
    import zstandard
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_dict_id=True), zstandard.ZstdDecompressor(dict_data=d)


def _store(root: str):
    """The file system of a URI or plain path, and the path in it."""
    from pyarrow import fs
    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


class Writer:
    """Writes one token file."""

    def __init__(self, stream, dictionary: bytes, width: int):
        self.stream, self.width, self.codec = stream, width, _codec(dictionary)[0]
        self.head = MAGIC + hashlib.sha256(dictionary).digest()
        self.rows: list[tuple[int, int, int]] = []
        self.at, self.before = len(self.head) + 24, 0
        # The number of documents is known at the end only and stands in the index.
        stream.write(self.head + np.array([width, 0, 0], "<u8").tobytes())

    def add(self, serialized: bytes) -> None:
        frame, n = self.codec.compress(serialized), len(serialized) // self.width
        self.stream.write(frame)
        self.rows.append((self.at, self.before, n))
        self.at, self.before = self.at + len(frame), self.before + n

    def close(self) -> None:
        self.stream.write(np.array([x for r in self.rows for x in r] + [self.at], "<u8").tobytes()
                          + np.array([self.at, len(self.rows)], "<u8").tobytes() + MAGIC)
        self.stream.close()


class Reader:
    """Reads single documents of one token file by their place in it."""

    def __init__(self, stream, dictionary: bytes):
        self.stream = stream
        size = stream.size()
        stream.seek(0)
        head = stream.read(64)
        stream.seek(size - 24)
        tail = stream.read(24)
        if head[:8] != MAGIC or tail[-8:] != MAGIC:
            raise ValueError("not a whole token file")
        if head[8:40] != hashlib.sha256(dictionary).digest():
            raise ValueError("the file was written with another dictionary")
        self.width = int(np.frombuffer(head[40:48], "<u8")[0])
        at, n = np.frombuffer(tail[:16], "<u8").tolist()
        stream.seek(at)
        index = np.frombuffer(stream.read(8 * (3 * n + 1)), "<u8").astype(np.int64)
        self.offsets = np.append(index[:-1:3], index[-1])
        self.before, self.sizes, self.codec = index[1:-1:3], index[2:-1:3], _codec(dictionary)[1]

    def __len__(self) -> int:
        return len(self.sizes)

    def ids(self, place: int) -> np.ndarray:
        a, b = int(self.offsets[place]), int(self.offsets[place + 1])
        self.stream.seek(a)
        raw = self.codec.decompress(self.stream.read(b - a), max_output_size=int(self.sizes[place]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}")


def write(docs: DataFrame, tokenizer_path: str, end_id: int, root: str | None = None) -> tuple[DataFrame, bytes]:
    """Encode and store whole texts; returns the manifest and the dictionary.
    Manifest: file (order), path, n_docs, n_ids, doc_ids (in file order)."""
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        spec = f.read()
    from tokenizers import Tokenizer
    most = max(end_id + 1, max(Tokenizer.from_str(spec.decode()).get_vocab(with_added_tokens=True).values()) + 1)
    width = 2 if most <= 1 << 16 else 4
    dictionary = train_dictionary(docs.select("text"), spec, end_id, width)
    root = root or f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    sent = spark.sparkContext.broadcast((spec, dictionary))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        spec, dictionary = sent.value
        coder, writer, ids = _tokenizer(spec), None, []
        gc.disable()                                   # the table of pieces is large and has no cycles
        number = TaskContext.get().partitionId()
        name = f"{number:06d}-{uuid.uuid4().hex}.tok"
        store, folder = _store(root)
        for batch in batches:
            if writer is None and batch.num_rows:
                store.create_dir(folder, recursive=True)
                writer = Writer(store.open_output_stream(f"{folder}/{name}"), dictionary, width)
            ids += batch.column(0).to_pylist()
            for part in bounded_runs(batch, 1):
                for got in coder.encode_batch(part.column(1)):
                    writer.add(_serialized(got, end_id, width))
        gc.enable()
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([
                pa.array([number]), pa.array([name]), pa.array([len(ids)]), pa.array([writer.before]),
                pa.array([ids], pa.list_(pa.int64()))], ["file", "path", "n_docs", "n_ids", "doc_ids"])

    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    laid = (docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
            .repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text"))
    manifest = materialize(laid.mapInArrow(
        run, "file long, path string, n_docs long, n_ids long, doc_ids array<bigint>"), "token-manifest")
    return manifest.withColumn("path", F.concat(F.lit(root + "/"), "path")), dictionary


def read(manifest: DataFrame, dictionary: bytes, per_document, schema: str) -> DataFrame:
    """``per_document(doc_id, start, ids)`` of every stored document, read back
    from the files; start: the ids of all documents before it."""
    spark = manifest.sparkSession
    # One number per file: the ids in the files before it.
    sizes = manifest.groupBy("file").agg(F.sum("n_ids").alias("n")).orderBy("file").collect()
    before = dict(zip((r.file for r in sizes), np.concatenate([[0], np.cumsum([r.n for r in sizes])]).tolist()))
    sent = spark.sparkContext.broadcast((before, dictionary))

    def run(batches):
        import pyarrow as pa
        before, dictionary = sent.value
        for batch in batches:
            for r in batch.to_pylist():
                store, name = _store(r["path"])
                with store.open_input_file(name) as f:
                    reader = Reader(f, dictionary)
                    if len(reader) != len(r["doc_ids"]):
                        raise ValueError("the file and its manifest differ")
                    for a in range(0, len(reader), 5000):
                        rows = [per_document(r["doc_ids"][i], before[r["file"]] + int(reader.before[i]), reader.ids(i))
                                for i in range(a, min(a + 5000, len(reader)))]
                        yield pa.RecordBatch.from_pylist(rows)

    # A file is one task's work: spread the few manifest rows over the cluster.
    return manifest.select("file", "path", "doc_ids").repartition(max(1, len(sizes)), "file").mapInArrow(run, schema)


def digest(doc_id, start: int, ids: np.ndarray) -> dict:
    return {"doc_id": doc_id, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}
