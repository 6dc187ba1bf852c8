"""Benchmark decontamination with an FM-index per training shard.

Words are runs of ASCII letters and digits and of characters beyond ASCII,
A-Z lower-cased. A window is ten consecutive words of a benchmark item; an
item of fewer words (but not none) is one window. Every task cuts its
documents into shards of a bounded number of words, indexes each shard, finds
all windows by backward search over wavelet ranks, locates the occurrences by
sampled suffix positions and merges them into spans of hit words. Documents
are never shuffled. A document longer than a shard is indexed in pieces that
overlap by a window.

The benchmark's windows travel to the executors in groups of at most
``GROUP_BYTES`` of text; a larger benchmark takes several passes over rows
that carry the spans found so far, so the result is the same.

Defined results: null or wordless texts have no words and no hits; items
without words match nothing; rows that repeat an item_id are one item (a null
item_id counts as the empty string); input columns named like a result are
replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import replace_columns, texts_of
from .fmindex import FMIndex

WINDOW = 10
SHARD_WORDS = 1 << 20
GROUP_BYTES = 16 << 20
#: Each byte as the word rule sees it: lower-cased, or a blank.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


def windows(items: list[tuple[str, bytes]], size: int = WINDOW) -> dict[tuple[bytes, ...], set[str]]:
    """Each distinct window and the items that hold it."""
    out: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            out.setdefault(tuple(w[i:i + size]), set()).add(item)
    return out


class _Shard:
    """Pieces of documents that are indexed together."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = {}
        self.pieces: list[tuple[int, int, np.ndarray]] = []   # document, its word where the piece begins, word ids
        self.size = 0

    def ids(self, words: list[bytes]) -> np.ndarray:
        v = self.vocabulary
        for w in set(words).difference(v):
            v[w] = len(v) + 2                                  # 0: end, 1: between pieces
        return np.fromiter(map(v.__getitem__, words), np.int64, len(words))

    def add(self, doc: int, start: int, ids: np.ndarray) -> None:
        self.pieces.append((doc, start, ids))
        self.size += len(ids) + 1

    def find(self, wins: list[tuple[bytes, ...]]):
        """(document, word, window) of every occurrence."""
        v = self.vocabulary
        by_length: dict[int, list[tuple[int, list[int]]]] = {}
        for k, win in enumerate(wins):
            ids = [v.get(w, 0) for w in win]
            if all(ids):
                by_length.setdefault(len(ids), []).append((k, ids))
        if not by_length:
            return
        gap = np.ones(1, np.int64)
        index = FMIndex(np.concatenate([x for _, _, ids in self.pieces for x in (ids, gap)]), len(v) + 2)
        begins = np.cumsum([0] + [len(ids) + 1 for _, _, ids in self.pieces])
        docs, starts = np.array([p[0] for p in self.pieces]), np.array([p[1] for p in self.pieces])
        for group in by_length.values():
            lo, hi = index.search(np.array([ids for _, ids in group], np.int64))
            some = np.flatnonzero(hi > lo)
            n = (hi - lo)[some]
            if not len(some):
                continue
            rows = np.repeat(lo[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = index.locate(rows)
            piece = np.searchsorted(begins, at, "right") - 1
            yield docs[piece], starts[piece] + at - begins[piece], np.repeat(np.array([k for k, _ in group])[some], n)


def merge_spans(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Flat [start, end, start, end, ...] of the words covered, in order."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, last, -1)
    hit = np.concatenate([[False], np.cumsum(step[:n]) > 0, [False]])
    return np.flatnonzero(hit[1:] != hit[:-1])


def _search(docs: list[tuple[list[bytes], np.ndarray, set[str]]], shard: _Shard, wins, owners):
    """Adds the shard's occurrences to each document's [spans, items]."""
    sizes = np.array([len(w) for w in wins])
    for doc, at, k in shard.find(wins):
        by = np.argsort(doc, kind="stable")
        doc, at, k = doc[by], at[by], k[by]
        for part in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc)) + 1):
            d = docs[doc[part[0]]]
            d[0].append((at[part], at[part] + sizes[k[part]]))
            for i in np.unique(k[part]):
                d[1].update(owners[i])


def scan(texts, wins, owners, shard_words: int = SHARD_WORDS):
    """(n_words, spans, items) of each text."""
    texts = list(texts)
    longest = max(map(len, wins), default=1)
    found, counts, shard = [([], set()) for _ in texts], [], _Shard()
    for d, text in enumerate(texts):
        words = words_of(text)
        counts.append(len(words))
        at = 0
        while at < len(words):
            room = max(longest, shard_words - shard.size)
            shard.add(d, at, shard.ids(words[at:at + room]))
            done = at + room >= len(words)
            at += len(words) if done else room - longest + 1
            if shard.size >= shard_words:
                _search(found, shard, wins, owners)
                shard = _Shard()
    _search(found, shard, wins, owners)
    for (spans, items), n in zip(found, counts):
        if spans:
            merged = merge_spans(np.concatenate([a for a, _ in spans]), np.concatenate([b for _, b in spans]), n)
        else:
            merged = np.zeros(0, np.int64)
        yield n, merged, items


def _groups(benchmark: DataFrame, group_bytes: int):
    """The items, in groups of a bounded size. The driver holds one at a time."""
    group, size = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), "text").where(
        "text is not null").distinct()
    for r in rows.toLocalIterator():
        text = r.text.encode()
        if group and size + len(text) > group_bytes:
            yield group
            group, size = [], 0
        group.append((r.i, text))
        size += len(text)
    if group:
        yield group


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS,
         group_bytes: int = GROUP_BYTES, cut: bool = False) -> DataFrame:
    """Every input column plus n_words, spans (flat starts and ends of hit
    words) and items (the item_ids whose windows occur). With ``cut`` the
    columns stay as they are, the spans are cut out of the texts, and a
    document left without any word by that is dropped."""
    docs = replace_columns(docs, tuple(_RESULT.names))
    at, width = [c.lower() for c in docs.columns].index("text"), len(docs.columns)
    schema, names = T.StructType([*docs.schema.fields, *_RESULT.fields]), [*docs.columns, *_RESULT.names]

    def one_pass(df: DataFrame, table: dict, first: bool, last: bool) -> DataFrame:
        session = df.sparkSession
        sent = session.sparkContext.broadcast(list(table.items()))

        def run(batches):
            import pyarrow as pa
            wins = [w for w, _ in sent.value]
            owners = [o for _, o in sent.value]
            for batch in batches:
                got = list(scan(texts_of(batch.column(at)), wins, owners, shard_words))
                n = [x[0] for x in got]
                spans, items = [x[1] for x in got], [x[2] for x in got]
                if not first:
                    for i, (s, o) in enumerate(zip(batch.column(width + 1).to_pylist(), batch.column(width + 2).to_pylist())):
                        if s:
                            both = np.concatenate([spans[i], np.array(s, np.int64)])
                            spans[i] = merge_spans(both[::2], both[1::2], n[i])
                        items[i] = items[i] | set(o)
                if cut and last:
                    yield _cut_batch(batch, names, width, at, spans)
                    continue
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:width], pa.array(n, pa.int64()), pa.array([s.tolist() for s in spans], pa.list_(pa.int64())),
                     pa.array([sorted(o) for o in items], pa.list_(pa.string()))], names)

        return df.mapInArrow(run, kept if cut and last else schema)

    kept, out, first = docs.schema, docs, True
    groups = _groups(benchmark, group_bytes)
    group = next(groups, [])
    while True:
        following = next(groups, None)
        out = one_pass(out, windows(group, window), first, following is None)
        if following is None:
            return out
        group, first = following, False


def n_hit(spans: str = "spans") -> F.Column:
    """Words covered by the flat spans."""
    return F.aggregate(F.transform(F.col(spans), lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)),
                       F.lit(0).cast("long"), lambda s, x: s + x)


def cut_spans(text: bytes, spans: list[int]) -> bytes:
    """The text without the words of the spans (and what stands between the
    words of one span)."""
    word = np.frombuffer(text.translate(_BYTES), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], word.astype(np.int8), [0]]))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(text[at:begins[a]])
        at = ends[b - 1]
    return b"".join([*out, text[at:]])


def _cut_batch(batch, names, width, at, spans):
    import pyarrow as pa
    columns, keep = list(batch.columns[:width]), [True] * batch.num_rows
    if any(len(s) for s in spans):
        texts = columns[at].to_pylist()
        for i, s in enumerate(spans):
            if len(s):
                left = cut_spans(texts[i].encode(), s)
                keep[i] = bool(words_of(left))
                texts[i] = left.decode()
        columns[at] = pa.array(texts, columns[at].type)
    return pa.RecordBatch.from_arrays(columns, names[:width]).filter(pa.array(keep, pa.bool_()))


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents with every hit span cut out of the text; the columns stay.
    A document left without any word by the cuts is dropped."""
    # Other names meanwhile, so that columns named like a result stay too.
    plain = docs.toDF(*["text" if c.lower() == "text" else f"column_{i}" for i, c in enumerate(docs.columns)])
    return find(plain, benchmark, window, cut=True).toDF(*docs.columns)
