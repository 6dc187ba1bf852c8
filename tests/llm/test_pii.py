"""Personal data: base rules against their plain forms, the boosted selection,
redaction, hostile texts."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from shelfcast.llm import pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    double = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in double)) % 10 == 0


def plain(text):
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in PLAIN[kind].finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "ip" and max(map(int, m.group().split("."))) > 255 or kind == "phone" and not 8 <= len(digits) <= 15
                    or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits))):
                continue
            out.append((k, m.start(), m.end()))
    return out


CARD = "4539 1488 0343 6467"
TEXTS = [
    None, "", " ", "no data", "a@b.co_x@y.com", "x..a@b-.c.d, a@b a@b. @b.c", "🙂é a@b.co é🙂 1.2.3.4", "1.2.3.4.5.6.7.8", "1.2.3.256 01.002.0003.4",
    "0000000001.2.3.0255", CARD, CARD.replace(" ", "-"), "1" + CARD, CARD + " 7", "0" * 16, "0" * 19, "0" * 20, CARD + "\n" + CARD,
    "+1 (217) 555-0199", "+12345678", "+1234567", "++49 30 1234567.", "+1 (2) +3 (4) 567-890-123-", "+1-" + " " * 50, "call (217) 555-0199 now",
    "+123456789012345 +1234567890123456", "v1.2.3.4-beta", "a%b+c@host-1.example.com.", "one@a.b two@c.d", "١.٢.٣.٤ ｅ@ｘ.ｙ",
]


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice(p) for _ in range(rng.randint(1, 60))) for p in
                     ("aB1.@-_ %é🙂\n", "0123456789. ", "0459 -", "+0123456789 ().-x", "a@.1 ") for _ in range(100)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(5, TEXTS[5]), (None, "q@w.e")], "doc_id long, text string")
    docs = docs.withColumns({"SPANS": F.lit("x"), "row": F.lit(1), "own": F.lit(2), "held": F.lit(3), "email": F.lit(4), "n_ip": F.lit(5)})
    return texts, docs, pii.find(docs, keep_text=True).collect()


def test_base_spans_equal_the_plain_rules(found):
    texts, docs, rows = found
    assert len(rows) == len(texts) + 2
    for r in rows:
        base, every = [tuple(s) for s in r.base_spans], [tuple(s) for s in r.spans]
        assert base == plain(r.text), r.text
        assert [getattr(r, f"n_{k}") for k in pii.KINDS] == [sum(s[0] == i for s in base) for i in range(4)]
        assert set(base) <= set(every) and every == sorted(set(every))
        assert all(0 <= a < b <= len(r.text or "") for _, a, b in every)
        assert (r.row, r.own, r.held, r.email) == (1, 2, 3, 4)
    assert len({str(r.spans) for r in rows if r.doc_id == 5}) == 1


def test_written_spans(spark):
    df = spark.createDataFrame([([(0, 1, 5), (3, 0, 9)],), ([],)], "s array<struct<kind:int,start:int,end:int>>")
    assert [r[0] for r in df.select(pii.said(F.col("s"))).collect()] == ["email:1:5,phone:0:9", ""]


def corpus():
    rng = random.Random(4)
    number = lambda: f"({rng.randint(200, 989)}) {rng.randint(200, 989)}-{rng.randint(1000, 9999)}"
    out = [f"you can call +1 {number()} any day {i}" for i in range(150)]
    out += [f"you can call {number()} any day {i}" for i in range(3)]                       # a relative of the base form
    out += [f"order no. {rng.randint(10 ** 8, 10 ** 9)} of {i} 20{i % 90 + 10}-11-{i % 9 + 10}" for i in range(150)]   # decoys
    out += [f"plain words {i}" for i in range(50)]
    return out


def test_boosting_adds_relatives_and_leaves_decoys(spark):
    texts = corpus()
    rows = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        text, base = texts[r.doc_id], plain(texts[r.doc_id])
        added = [text[a:b] for k, a, b in r.spans if (k, a, b) not in base]
        assert [tuple(s) for s in r.base_spans] == base
        if text.startswith("you can call ("):
            assert added == [text[13:text.index(" any")]]
        elif not text.startswith("you"):
            assert added == []


def test_redaction(spark):
    texts = ["a@b.co", "x a@b.co y +1 217 555 0199 z", None, "", "nothing", "🙂a@b.co🙂" + CARD, "a@b.co c@d.ee " * 700]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "id int, text string, Spans string")
    rows = {r.id: r for r in pii.redact(docs, "#").collect()}
    assert rows[0].Spans == "k"
    assert [rows[i].text for i in range(7)] == ["#", "x # y # z", None, "", "nothing", "🙂#🙂#", "# # " * 700]


def test_long_and_repetitive_texts_take_linear_time(spark):
    n = 20_000
    texts = ["a" * n, "1" * n, "1 " * n, "a." * n + "@" + "b." * n, "1." * n, "+1 " * n, "(" * n, " " * n, "@" * n,
             "me@x.yz " * 4_000, "+1" + " " * n, "a at b dot " * 4_000, "1.2.3.4 " * 4_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    begin = time.time()
    rows = pii.find(docs).collect()
    assert time.time() - begin < 90
    for r in rows:
        assert [tuple(s) for s in r.base_spans] == plain(texts[r.doc_id]), texts[r.doc_id][:20]


def test_running_results(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        values = [(i * 37) % 11 - 5 for i in range(n)]
        got = spark.createDataFrame([(values,)], "v array<int>").select(
            pii.running(F.col("v"), lambda a, b: a + b, F.lit(0)).alias("s"), pii.running(F.col("v"), lambda a, b: F.greatest(a, b), F.lit(-9)).alias("m")).first()
        assert got.s == [sum(values[:i + 1]) for i in range(n)] and got.m == [max(values[:i + 1]) for i in range(n)]


def test_nothing_to_find(spark):
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert pii.redact(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trees_learn_from_every_vector(spark):
    n = 70_000
    one = F.array(F.struct(F.lit(False).alias("base"), F.array((F.col("id") % 300).cast("int"), (F.col("id") / 300).cast("int")).alias("x")))
    rows = spark.range(n).select(F.lit(False).alias("held"), one.alias("email"),
                                 *[F.slice(one, 1, 0).alias(k) for k in pii.KINDS if k != "email"])
    assert pii.vectors_of(rows).count() == n
