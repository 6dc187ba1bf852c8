"""Cross-tokenizer alignment against a plain version with both libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfcast.llm import crosstok
from shelfcast.llm.bpe import byte_symbols

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def texts():
    rng = random.Random(11)
    words = ["the", "of", "Thing", "über", "naïve,", "end.", "日本", "x1", "we'll", "a" * 70, "🙂", "é", "\t", "\n"]
    odd = [None, "", " ", "  two  blanks", "\n\nline\n", "<|endoftext|>", "</s> <s> <unk> <0x41>", "has ▁ mark", "\x00\x01",
           "tab\there", "trailing  ", "ﬁ ligature Ⅻ", "=" * 500, "a" * 3000, " " * 2000, "1" * 999, "　wide blank"]
    return odd + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(40)] + [
        " ".join(rng.choice(words) for _ in range(20000))]


def brute(docs):
    """Of (key, text) rows: the result columns by key."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    back = {c: i for i, c in enumerate(byte_symbols())}

    def spans(ids, raw):
        ends, at = [], 0
        for r in raw:
            ends.append((at, at + len(r)))
            at += len(r)
        return list(zip(ids, ends)), b"".join(raw)

    out, pairs, seen = {}, {}, Counter()
    for key, text in docs:
        pairs[key], out[key] = Counter(), dict(n_a=0, n_b=0, n_groups=0, n_links=0, groups_sha256="")
        if not text:
            continue
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        sa, ra = spans(ia, [bytes(back[c] for c in a.id_to_token(i)) for i in ia])
        sb, rb = spans(ib, [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else
                            b.id_to_piece(i).replace("▁", " ").encode() for i in ib])
        if not ra == rb == (" " + text).encode():
            continue
        cuts = sorted({e for _, (_, e) in sa} & {e for _, (_, e) in sb})
        groups, i, j = [], 0, 0
        for cut in cuts:
            x, y = i, j
            while i < len(sa) and sa[i][1][1] <= cut:
                i += 1
            while j < len(sb) and sb[j][1][1] <= cut:
                j += 1
            groups.append((sa[x:i], sb[y:j]))
        for left, right in groups:
            pairs[key].update((p, q) for p, (s, e) in left for q, (u, v) in right if max(s, u) < min(e, v))
        said = ";".join(",".join(str(p) for p, _ in x) + "|" + ",".join(str(q) for q, _ in y) for x, y in groups)
        out[key] = dict(n_a=len(ia), n_b=len(ib), n_groups=len(groups), n_links=sum(pairs[key].values()),
                        groups_sha256=hashlib.sha256(said.encode()).hexdigest())
        seen.update(pairs[key].keys())
    most = defaultdict(int)
    for (p, _), n in seen.items():
        most[p] = max(most[p], n)
    for key, own in pairs.items():
        out[key] |= dict(n_best=sum(k for (p, q), k in own.items() if seen[p, q] == most[p]),
                         count_sum=sum(k * seen[p] for p, k in own.items()))
    return out, seen, most


@pytest.mark.parametrize("run_bytes, times_bits", [(crosstok.RUN_BYTES, crosstok.TIMES_BITS), (2000, 4)])
def test_alignment_equals_plain_version(spark, monkeypatch, run_bytes, times_bits):
    monkeypatch.setattr(crosstok, "RUN_BYTES", run_bytes)
    monkeypatch.setattr(crosstok, "TIMES_BITS", times_bits)          # many entries for a pair that is linked often
    rows = list(enumerate(texts()))
    rows += [(100 + i, rows[20][1]) for i in range(5)]
    docs = spark.createDataFrame(rows, "key int, text string").withColumns(
        {"N_A": F.lit("x"), "run": F.lit(1), "pos": F.lit(2), "a": F.lit(3), "documents": F.lit("d"), "own": F.lit("o"), "row": F.lit(0)})
    docs = docs.unionByName(docs.where("key = 30"))                    # a repeated row
    got = crosstok.Alignment(docs.repartition(3), A, B, texts=True)
    expected, seen, most = brute(rows + [(1000, rows[30][1])])
    expected[30] = expected[1000]
    table = got.documents().collect()
    assert len(table) == len(rows) + 1 and got.documents().columns == [
        "key", "run", "pos", "a", "documents", "own", "row", *crosstok.RESULTS, "groups"]
    for r in table:
        assert {c: r[c] for c in crosstok.RESULTS} == expected[r.key], (r.key, rows[r.key % 100][1][:50])
        assert (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") == r.groups_sha256
        assert (r.own, r.run, r.documents) == ("o", 1, "d")
    counts = {(r.a, r.b): (r.documents, r.best) for r in got.pair_counts().collect()}
    assert counts == {p: (n, n == most[p[0]]) for p, n in seen.items()}


def test_nothing_to_align(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert crosstok.Alignment(none, A, B).documents().count() == 0
    empty = spark.createDataFrame([(1, None), (1, ""), (None, None)], "doc_id long, text string")
    got = [tuple(r) for r in crosstok.Alignment(empty, A, B).documents().collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 0, 0, 0, 0, 0, ""), (1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")], key=str)


def test_other_tokenizer_files_are_refused(tmp_path):
    with pytest.raises((ValueError, KeyError)):
        crosstok.ByteSide(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read())
