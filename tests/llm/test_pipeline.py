"""The pipeline's stages on the smallest tables, held against their own rules."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from shelfcast.llm import simhash
from tests.conftest import SF001
from tests.llm.test_operators import LOWER, WORD, brute_lines, components, fingerprint


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline
    from shelfcast.session import materialize
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF001), name))
    return out


def test_columns_and_order(stages):
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "bpe_encoding"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_classifier_keeps_good_documents(spark, stages):
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    kept = {r.doc_id for r in stages[1].select("doc_id").collect()}
    good = [r.doc_id for r in labels.where("quality = 1").collect()]
    bad = [r.doc_id for r in labels.where("quality = 0").collect()]
    assert sum(d in kept for d in good) >= 0.97 * len(good) and sum(d in kept for d in bad) <= 0.15 * len(bad)


def test_one_document_of_each_group_stays(stages):
    before = {r.doc_id: r.component_id for r in simhash.near_duplicates(stages[2]).collect()}
    kept = [r.doc_id for r in stages[3].select("doc_id").collect()]
    assert sorted(kept) == sorted(set(before.values()))


def test_no_benchmark_window_is_left(spark, stages):
    word, low = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), str.maketrans(
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    items = [word.findall(r.text.translate(low)) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    windows = {tuple(w[i:i + 10]) for w in items for i in range(max(1, len(w) - 9))}
    for r in stages[4].collect():
        w = word.findall(r.text.translate(low))
        assert not any(tuple(w[i:i + 10]) in windows for i in range(len(w) - 9))
        assert r.n_chars == len(r.text)


def test_run_returns_the_last_stage(spark, stages):
    import corpus_pipeline
    got = corpus_pipeline.run(spark, SF001)
    assert got.count() == stages[-1].count() == stages[4].count()


def test_empty_documents(spark, stages):
    import corpus_pipeline
    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF001)
        assert docs.count() == 0


def plain_features(text):
    """The classifier's features, counted character by character."""
    raw = text.encode()
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    count = lambda f: sum(map(f, raw))
    symbol = lambda c: 33 <= c < 127 and not chr(c).isalnum() and chr(c) not in ".,;:!?'\"-()|"
    upper, high = count(lambda c: 65 <= c <= 90), count(lambda c: c >= 128)
    letters = max(1, upper + high + count(lambda c: 97 <= c <= 122))
    n, size, n_lines = max(1, len(words)), max(1, len(raw)), max(1, len(lines))
    again = len(lines) - len(set(lines))
    shares = [count(symbol) / n, upper / letters, count(lambda c: c == 124) / n, count(lambda c: c in (33, 63)) / n,
              count(lambda c: 48 <= c <= 57) / size, sum(a == b for a, b in zip(words, words[1:])) / n, again / n_lines,
              (len(raw) - sum(map(len, set(lines)))) / size if again else 0]
    return [*shares, *(x / (x + 0.02) for x in shares), math.log1p(len(words)), math.log1p(len(lines)), len(raw) / n,
            math.log1p(len(set(words))) - math.log1p(len(words)), count(lambda c: c in (44, 46)) / n, high / size]


def plain_classifier(rows, labels):
    """Good documents by pairs of good and bad ones that are not held out."""
    known = {i: y for i, y in labels if y in (0, 1) and zlib.crc32(str(i).encode()) % 3 != 1}
    x = {i: np.array(plain_features(t or "")) for i, t in rows}
    good, bad = (sorted(x[i].tolist() for i, y in known.items() if y == k and i in x) for k in (1, 0))
    both = np.array(good + bad)
    mean, scale = both.mean(0), np.where(both.std(0) < 1e-9, 1, both.std(0))
    z = lambda v: np.clip((np.array(v) - mean) / scale, -20, 20)
    g, b, most = z(good), z(bad), max(len(good), len(bad))
    pairs = np.array([g[(k + 7 * s) % len(g)] - b[(k * (1 + s % 3) + s) % len(b)] for s in range(8) for k in range(most)])
    w = np.zeros(pairs.shape[1])
    for _ in range(200):
        loses = 1 / (1 + np.exp(pairs @ w))
        step = np.linalg.solve((pairs * (loses * (1 - loses))[:, None]).T @ pairs / len(pairs) + 0.01 * np.eye(len(w)),
                               pairs.T @ loses / len(pairs) - 0.01 * w)
        w += step / max(1, abs(step).max() / 2)
    share = sum(y == 0 for y in known.values()) / len(known)
    ranked = sorted([(v @ w, (1 - share) / len(g)) for v in g] + [(v @ w, share / len(b)) for v in b])
    at, total = 0, ranked[0][1]
    while total < share:
        at += 1
        total += ranked[at][1]
    around = [s for s, _ in ranked[max(0, at - 1):at + 2]]
    return [(i, t) for i, t in rows if z(x[i]) @ w >= (around[0] + around[-1]) / 2]


def plain_decontamination(rows, items):
    word, low = WORD, LOWER
    windows = {}
    for text in items:
        w = word.findall((text or "").translate(low))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i:i + 10])] = {"item"}
    sizes = {len(w) for w in windows}
    out = []
    for i, text in rows:
        found = list(word.finditer((text or "").translate(low)))
        w = [m[0] for m in found]
        hit = {k for n in sizes for a in range(len(w) - n + 1) if tuple(w[a:a + n]) in windows for k in range(a, a + n)}
        left, at = "", 0
        for k in sorted(hit):
            if k - 1 not in hit:
                left += text[at:found[k].start()]
            at = found[k].end()
        left = left + text[at:] if hit else text
        if not hit or word.search(left):
            out.append((i, left))
    return out


def test_run_equals_a_plain_replay(spark, stages):
    """All five stages again without the operators: every id and digest, and
    the text after each stage."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer
    rows = sorted((r.doc_id, r.text) for r in stages[0].collect())
    assert len({i for i, _ in rows}) == len(rows)
    texts = lambda k: sorted((r.doc_id, r.text) for r in stages[k].collect())

    rows = plain_classifier(rows, [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF001}/labels.parquet").collect()])
    assert rows == texts(1)

    cut = brute_lines([(i, t) for i, t in rows if t is not None], 4, 50)
    rows = [(i, cut[i][0] if i in cut else t) for i, t in rows if i not in cut or not cut[i][1] or cut[i][0].strip(" ")]
    assert rows == texts(2) and any(n for _, n in cut.values())

    marks = {i: fingerprint(t) for i, t in rows}
    root, first = components(set(marks.values()), lambda a, b: bin(a ^ b).count("1") <= 2), {}
    for i, _ in rows:
        first.setdefault(root[marks[i]], i)
    before, rows = len(rows), [(i, t) for i, t in rows if first[root[marks[i]]] == i]
    assert rows == texts(3) and len(rows) < before

    whole = rows
    rows = plain_decontamination(rows, [r.text for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()])
    assert rows == texts(4) and rows != whole

    t, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, SF001).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
