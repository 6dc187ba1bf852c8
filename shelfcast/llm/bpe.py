"""Byte-level BPE with a minimal acyclic transducer lexicon.

The corpus' frequent words are counted over all documents, encoded once, and
compiled into a transducer (see ``transducer``) that every worker maps into
memory. Texts are cut before single blanks, where the pre-tokenizer always
cuts; a piece is looked up in the lexicon pre-token by pre-token, and words
that the lexicon lacks are merged exactly by rank. Whole texts are encoded.

A word is frequent if it makes up more than one in ``1 / SHARE`` of all words,
so there are at most ``SHARE`` of them whatever the corpus.

Defined results: null text counts as empty and has no tokens; added special
tokens in a text become their ids, as the tokenizer file says; repeated rows
get equal results; input columns named like a result are replaced.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_runs, gather_ids, per_process, pieces_of, replace_columns
from .transducer import Lexicon, build, image

SHARE = 1 << 19
#: Words that a worker remembers beside the lexicon before it starts anew.
REMEMBERED = 200_000
#: Text that is encoded at a time.
RUN_BYTES = 1 << 21
#: The public pre-tokenizer rule of byte-level BPE (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space before a blank: such texts are cut by the slower, general rule.
_BEFORE_BLANK = "[\t-\r \x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] "
_MARKS = (".", ",", ";", ":", "!", "?")
_CUTS = re.compile(r"(?<=\S)(?=[ \t\n\r])")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a vocabulary:
    itself if it is visible Latin-1, else the next unused from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = [""] * 256, 256
    for b in range(256):
        if b in seen:
            out[b] = chr(b)
        else:
            out[b], more = chr(more), more + 1
    return out


class Tokenizer:
    """Exact byte-level BPE from a tokenizers JSON file's bytes."""

    def __init__(self, spec: bytes):
        import regex
        data = json.loads(spec)
        model, before = data["model"], data["pre_tokenizer"] or {}
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or data["normalizer"] or before.get("add_prefix_space"):
            raise ValueError("not a plain byte-level BPE tokenizer")
        vocabulary = model["vocab"]
        back = {c: b for b, c in enumerate(byte_symbols())}
        self.bytes_of: dict[int, bytes] = {i: bytes(back[c] for c in t) for t, i in vocabulary.items()}
        self.by_byte = [vocabulary[c] for c in byte_symbols()]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(vocabulary[a] << 32 | vocabulary[b], (rank, vocabulary[a + b]))
        keys = np.array(list(self.merges), np.int64)
        by = np.argsort(keys)
        self.pair_keys = keys[by] if len(keys) else np.full(1, -1)
        self.pair_ranks = np.array([r for r, _ in self.merges.values()], np.int64)[by] if len(keys) else np.zeros(1, np.int64)
        self.none = len(model["merges"]) + 1
        self.merged = np.zeros(self.none + 1, np.int64)
        for rank, new in self.merges.values():
            self.merged[rank] = new
        self.byte_ids = np.array(self.by_byte, np.int64)
        self.special = {}
        for t in data["added_tokens"]:
            if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]:
                raise ValueError("added tokens with rules are not supported")
            self.special[t["content"]] = t["id"]
            self.bytes_of[t["id"]] = t["content"].encode()
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None
        self.pretokens = regex.compile(PATTERN).findall
        self.byte_table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.text_of = list(map(str, range(max(self.bytes_of) + 1)))

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Token ids of one pre-token."""
        return tuple(np.frombuffer(self.merge_all([word])[0], "<i4").tolist())

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], self.none)

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Token ids of pre-tokens, as little-endian 32-bit integers: in each round every word that still can
        merges its pair of the lowest rank, the leftmost first."""
        out = [b""] * len(words)
        for i, w in enumerate(words):
            if len(w) > 48:
                out[i] = self._merge_long([self.by_byte[x] for x in w])
        short = [i for i, w in enumerate(words) if 0 < len(w) <= 48]
        if not short:
            return out
        which = np.array(short)
        sizes = np.fromiter((len(words[i]) for i in short), np.int64, len(short))
        symbols = self.byte_ids[np.frombuffer(b"".join([words[i] for i in short]), np.uint8)]
        owner = np.repeat(np.arange(len(short)), sizes)
        ranks = np.full(len(symbols), self.none, np.int64)           # of the pair that begins here
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        ranks[inner] = self._pair_ranks(symbols[inner], symbols[inner + 1])
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.append(starts, len(symbols)))
            least = np.minimum.reduceat(ranks, starts)
            done = least == self.none
            if done.any():
                final = np.repeat(done, sizes)
                ids, ends = symbols[final].astype("<i4").tobytes(), (np.cumsum(sizes[done]) * 4).tolist()
                begin = 0
                for k, end in zip(which[owner[starts[done]]].tolist(), ends):
                    out[k] = ids[begin:end]
                    begin = end
                symbols, owner, ranks = symbols[~final], owner[~final], ranks[~final]
                sizes, least = sizes[~done], least[~done]
                if not len(symbols):
                    break
            hit = np.flatnonzero(ranks == np.repeat(least, sizes))
            hit = hit[np.concatenate([[True], owner[hit[1:]] != owner[hit[:-1]]])]
            symbols[hit] = self.merged[ranks[hit]]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            symbols, owner, ranks = symbols[stay], owner[stay], ranks[stay]
            at = hit - np.arange(len(hit))                            # where the new tokens are now
            touched = np.concatenate([at, at[(at > 0)] - 1])
            ranks[touched] = self.none
            touched = touched[touched + 1 < len(symbols)]
            touched = touched[owner[touched] == owner[touched + 1]]
            ranks[touched] = self._pair_ranks(symbols[touched], symbols[touched + 1])
        return out

    def _merge_long(self, ids: list[int]) -> bytes:
        """The same with a queue of pairs, for words of any length."""
        n, get = len(ids), self.merges.get
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := get(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(queue)
        while queue:
            _, i, new, a, b = heapq.heappop(queue)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q < n and (m := get(ids[p] << 32 | ids[q])):
                    heapq.heappush(queue, (m[0], p, m[1], ids[p], ids[q]))
        return np.array([x for x in ids if x >= 0], "<i4").tobytes()

    def decode(self, ids) -> bytes:
        """UTF-8 text of token ids (bytes that are no UTF-8 are replaced)."""
        raw = b"".join(map(self.byte_table.__getitem__, ids))
        return raw.decode("utf-8", "replace").encode()


class Encoder:
    """Whole texts to ids, with the lexicon first and exact merges after."""

    def __init__(self, tokenizer: Tokenizer, lexicon: Lexicon | None = None):
        self.t, self.lexicon = tokenizer, lexicon
        # Token ids as little-endian 32-bit integers of what follows a blank (the
        # blank left out), and of marks.
        self.pieces: dict[str, bytes] = {}
        self.marks = dict(zip(_MARKS, tokenizer.merge_all([m.encode() for m in _MARKS])))

    def _encode_all(self, parts: list[str]) -> list[bytes]:
        """Ids of parts that the pre-tokenizer keeps apart."""
        split = self.t.pretokens
        # A blank and letters only, the usual case, are one pre-token.
        cut = [(p,) if p[1:].isalpha() and p[0] == " " else split(p) for p in parts]
        distinct = list(set(chain.from_iterable(cut)))
        raw = [w.encode() for w in distinct]
        found = self.lexicon.numbers(raw).tolist() if self.lexicon else [-1] * len(raw)
        rest = iter(self.t.merge_all([b for b, k in zip(raw, found) if k < 0]))
        words = {w: self.lexicon.ids_of(k) if k >= 0 else next(rest) for w, k in zip(distinct, found)}
        return [words[x[0]] if len(x) == 1 else b"".join(map(words.__getitem__, x)) for x in cut]

    def _learn(self, pieces: set[str]) -> None:
        """Ids of new pieces that follow a blank. A word with one mark after it
        is the word and the mark, which the pre-tokenizer keeps apart."""
        known, marked, todo = self.pieces, [], set()
        for p in pieces:
            if p[-1:] in _MARKS and p[:-1].isalpha():
                marked.append(p)
                if p[:-1] not in known:
                    todo.add(p[:-1])
            else:
                todo.add(p)
        new = list(todo)
        known.update(zip(new, self._encode_all([" " + p for p in new])))
        known.update([(p, known[p[:-1]] + self.marks[p[-1]]) for p in marked])

    def encode_batch(self, texts) -> list[np.ndarray]:
        """Ids of each text of an Arrow string array (null: none); call with a
        bounded amount of text at a time."""
        import pyarrow as pa
        import pyarrow.compute as pc
        texts = pc.fill_null(texts, "").cast(pa.string())
        odd = pc.match_substring_regex(texts, _BEFORE_BLANK)
        for s in self.t.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        if len(self.pieces) > REMEMBERED:
            self.pieces = {}
        out: list = [None] * len(texts)
        plain = np.flatnonzero(~odd.to_numpy(zero_copy_only=False))
        if len(plain):
            distinct, which, offsets = pieces_of(pc.split_pattern(texts.take(pa.array(plain)), " "))
            # What a text begins with follows no blank: those pieces come after the distinct ones.
            begins = offsets[:-1]
            heads, place = np.unique(which[begins], return_inverse=True)
            which = which.astype(np.int64)
            which[begins] = len(distinct) + place
            self._learn({p for p in distinct if p not in self.pieces})
            raw = list(map(self.pieces.__getitem__, distinct)) + self._encode_all([distinct[h] for h in heads.tolist()])
            for i, ids in zip(plain.tolist(), gather_ids(raw, which, offsets)):
                out[i] = ids
        for i, ids in enumerate(out):
            if ids is None:
                out[i] = self._encode_odd(texts[i].as_py())
        return out

    def _encode_odd(self, text: str) -> np.ndarray:
        """A text with special tokens or blanks after white space."""
        raw = []
        for s in self.t.cut_special.split(text) if self.t.cut_special else (text,):
            if s in self.t.special:
                raw.append(np.array([self.t.special[s]], "<i4").tobytes())
            else:
                raw.extend(self._encode_all(_CUTS.split(s)))
        return np.frombuffer(b"".join(raw), "<i4")


def frequent_words(docs: DataFrame, share: int = SHARE) -> list[str]:
    """Words (cut at blanks) that make up more than one in ``share`` of all
    words of all texts: fewer than ``share`` of them."""
    blanks = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    total = docs.where("text is not null").agg(F.sum(blanks + 1)).first()[0] or 0
    words = docs.select(F.explode(F.split("text", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    # The bound keeps what comes to the driver small for any corpus; words of
    # extreme length are left to the exact merges.
    return [r.w for r in words.where((F.col("n") * share > total) & (F.col("n") > 1) & (F.length("w") <= 64)).collect()]


def compile_lexicon(words: list[str], tokenizer: Tokenizer) -> bytes:
    """Image of the transducer of the words' pre-tokens."""
    parts = set()
    for w in words:
        parts.update(tokenizer.pretokens(" " + w))
    raw = sorted(p.encode() for p in parts)
    return image(build(raw, tokenizer.merge_all(raw)))


def _encoder(key, spec: bytes, lexicon: bytes) -> Encoder:
    return per_process(("bpe", key), lambda: Encoder(Tokenizer(spec), Lexicon(lexicon)))


def encode(docs: DataFrame, tokenizer_path: str, share: int = SHARE, digests: bool = False, ids: bool = True) -> DataFrame:
    """Every input column plus n_tokens and ``ids``; with ``digests`` also
    ids_sha256 and decoded_sha256, taken from the ids and from their decoding."""
    with open(tokenizer_path, "rb") as f:
        spec = f.read()
    lexicon = compile_lexicon(frequent_words(docs.select("text"), share), Tokenizer(spec))
    added = [T.StructField("n_tokens", T.LongType())]
    added += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids
    added += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] * digests
    docs = replace_columns(docs, tuple(x.name for x in added))
    at, names = [c.lower() for c in docs.columns].index("text"), [*docs.columns, *(x.name for x in added)]
    key = hashlib.sha256(spec + lexicon).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast((spec, lexicon))

    def run(batches):
        import pyarrow as pa
        coder = _encoder(key, *sent.value)
        gc.disable()                     # the table of pieces is large and has no cycles
        text_of = coder.t.text_of.__getitem__
        for batch in batches:
            for part in bounded_runs(batch, at, RUN_BYTES):
                got = coder.encode_batch(part.column(at))
                counts = np.fromiter(map(len, got), np.int64, len(got))
                columns = [*part.columns, pa.array(counts)]
                if ids:
                    columns.append(pa.ListArray.from_arrays(
                        np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), np.concatenate(got)))
                if digests:
                    own = [x.tolist() for x in got]
                    columns.append(pa.array([hashlib.sha256(",".join(map(text_of, x)).encode()).hexdigest() for x in own]))
                    columns.append(pa.array([hashlib.sha256(coder.t.decode(x)).hexdigest() for x in own]))
                yield pa.RecordBatch.from_arrays(columns, names)
        # An idle worker must not keep what later work could use.
        coder.pieces = {}
        gc.enable()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def decode(rows: DataFrame, tokenizer_path: str, column: str = "ids", to: str = "text") -> DataFrame:
    """Every input column plus the text of the token ids (null ids: empty)."""
    with open(tokenizer_path, "rb") as f:
        spec = f.read()
    rows = replace_columns(rows, (to,))
    at, names = rows.columns.index(column), [*rows.columns, to]
    key = hashlib.sha256(spec).hexdigest()
    sent = rows.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        import pyarrow as pa
        coder = per_process(("bpe", key), lambda: Tokenizer(sent.value))
        for batch in batches:
            texts = [coder.decode(x.as_py() or ()).decode() for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(to, T.StringType())]))
