"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base rules (below) find e-mail and IP addresses, card and phone numbers; what
they find is always redacted. High-recall generators propose further spans of
the same kinds, overlapping as they may: written-out or spaced addresses,
numbers with other separators, lengths or prefixes. Boosted trees learn from
the corpus itself which candidates look like base finds, by coarse format and
by context (the labels are "found by a base rule"; features leave out what
tells a base rule's exact form, so that its relatives score alike). A held-out
fold of documents gives each kind its threshold: the lowest score from which on
at least ``PRECISION`` of the candidates are base finds, and halfway from there
to the next lower one; a candidate of another form at or above it is added.

One pass over the texts stores candidates with their features as arrays of the
document's row, so nothing is exploded for scoring, and no text is shuffled.
The trees grow level by level from sums of gradients by (kind, node, feature,
value) over all distinct feature vectors of the corpus; features have few
values, so the vectors are far fewer than the candidates. A vector counts
1 + ln(its occurrences), so that a large group of copies does not decide. A finished tree is a SQL expression.

Spans count code points, the end exclusive. Defined results: null text counts
as empty and has no spans; each row is judged by itself, so repeated rows get
equal results; without base finds of a kind in both folds nothing of that kind
is added; input columns named like a result are replaced.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import ascii_lower, replace_columns

#: Kinds in the order of results.
KINDS = ("email", "ip", "card", "phone")

# The base rules. Quantifiers are possessive and runs are entered at their
# beginning only (or where the match before ended), which finds the same spans
# as the plain forms in time that grows with the text.
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"[0-9](?<![0-9]{2})[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9]{2})(?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_PARTS = rf"^{_PART}(?:[^0-9]+{_PART}){{3}}$"

# The generators: a superset of forms, wrong ones among them.
_AT_MARK = r"(?: @ |@| ?[\[({] ?(?:@|at|AT) ?[\])}] ?)"
_DOT_MARK = r"(?: \. |\.| ?[\[({] ?(?:\.|dot|DOT) ?[\])}] ?)"
_AT, _DOT = rf"(?:{_AT_MARK}| (?:at|AT) )", rf"(?:{_DOT_MARK}| (?:dot|DOT) )"
WIDE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++{_AT}{_HOST}++(?:{_DOT}{_HOST}++)++",
    "ip": rf"[0-9](?<![0-9]{{2}})[0-9]{{0,2}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])",
    "card": r"[0-9](?<![0-9]{2})(?:[ ./_-]{0,2}[0-9]){12,18}+(?![0-9])",
    "phone": r"(?:[+(](?<![A-Za-z0-9].)[0-9]|[0-9](?<![A-Za-z0-9+(].))(?:[ ().-]{0,2}[0-9]){6,14}+(?![0-9])",
}
#: Where these don't occur, no rule or generator of the kind can match.
_NEEDS = {"email": r"@|[\[({] ?(?:at|AT) ?[\])}]| (?:dot|DOT) |[\[({] ?(?:\.|dot|DOT) ?[\])}]", "ip": r"[0-9](?: (?:dot|DOT)| ?[.\[({])",
          "card": r"[0-9](?:[ ./_-]{0,2}[0-9]){12}", "phone": r"[0-9](?:[ ().-]{0,2}[0-9]){2}|\+[0-9]"}
#: Words that announce a kind (as text before a span, lower case).
CUES = {
    "email": r"(?:e-?mail|mailto|contact|correo|courriel|write)[^a-z]*\w*[^a-z]*$",
    "ip": r"(?:\bip|address|host|server|adresse)[^a-z]*\w*[^a-z]*$",
    "card": r"(?:card|visa|mastercard|amex|karte|carte|tarjeta)[^a-z]*\w*[^a-z]*$",
    "phone": r"(?:phone|tel|call|mobile|fax|telefon|llame)[^a-z]*\w*[^a-z]*$",
}
#: Characters of context before and after a span that features look at.
BEFORE, AFTER = 32, 8

PRECISION = 0.9
ROUNDS, RATE, SHRINK = 8, 0.5, 1.0
#: Every how many-th of the documents calibrates thresholds (by text hash).
FOLDS = 5
_BLOCK = 256
_MATCH = "array<struct<m:string,start:int,end:int,before:string,after:string>>"
_FEATURES = ("digits", "groups", "mark", "luhn", "parts", "spaces", "label", "left", "right", "cue", "near", "distinct",
             "separators", "joined")


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, op, zero: Column) -> Column:
    """Inclusive running results of an array. Appending to an array copies it,
    so this goes by blocks: the work is n * _BLOCK, not n * n."""
    def append(state, x):
        return let(op(state["at"], x), lambda now: F.struct(now.alias("at"), F.concat(state["out"], F.array(now)).alias("out")))

    def run(items, start):
        none = F.struct(start.alias("at"), F.slice(F.array(start), 1, 0).alias("out"))
        return F.aggregate(items, none, append)["out"]

    def whole(v):
        count = F.ceil(F.size(v) / _BLOCK).cast("int")
        blocks = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(v, k * _BLOCK + 1, F.lit(_BLOCK))))
        return F.when(count == 0, v).otherwise(let(blocks, lambda b: let(
            run(F.transform(b, lambda x: F.aggregate(x, zero, op)), zero), lambda ends: F.flatten(
                F.transform(b, lambda x, i: run(x, F.when(i > 0, F.get(ends, i - 1)).otherwise(zero)))))))

    return let(values, whole)


def matches(text: Column, pattern: str) -> Column:
    """All matches from left to right with their place and what stands between
    them and their neighbours (up to BEFORE and AFTER characters)."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))

    def place(v):
        steps = F.transform(v["m"], lambda m, i: F.length(m) + F.length(F.get(v["p"], i)))
        return let(running(steps, lambda a, b: a + b, F.lit(0)), lambda ends: F.transform(v["m"], lambda m, i: F.struct(
            m.alias("m"), (F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"),
            F.substring(F.get(v["p"], i), -BEFORE, BEFORE).alias("before"),
            F.substring(F.get(v["p"], i + 1), 1, AFTER).alias("after"))))

    return let(both, place)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def valid(kind: str, m: Column) -> Column:
    """Whether a match of the kind's base rule passes its check."""
    if kind == "ip":
        return m.rlike(_PARTS)
    if kind == "card":
        return let(_digits(m), lambda d: F.length(d).between(16, 19) & F.call_function("luhn_check", d))
    return F.length(_digits(m)).between(8, 15) if kind == "phone" else F.lit(True)


def core(kind: str, m: Column) -> Column:
    """A match without what only the exact form of the base rule has: other
    marks and separators become the usual ones, a country prefix goes."""
    if kind in ("email", "ip"):
        m = F.regexp_replace(m, _AT_MARK, "@") if kind == "email" else m
        return F.regexp_replace(m, _DOT_MARK, ".")
    return F.regexp_replace(m, "[./_-]", " ") if kind == "card" else F.regexp_replace(m, r"^(?:\+|00)[0-9]{1,3}(?=[ ().-])[ .-]*", "")


def features(kind: str, c: Column) -> Column:
    """Small whole numbers in the order of ``_FEATURES``."""
    def kind_of(x: Column) -> Column:
        return (F.when(x.rlike(r"^$|\s"), 0).when(x.rlike(r"[A-Za-z]|[^\x00-\x7F]"), 1).when(x.rlike("[0-9]"), 2)
                .when(x.rlike("[.,;:!?)\"'|]"), 3).otherwise(4))

    m = core(kind, c["m"])
    bins = lambda d: (F.when(F.length(d) < 7, 0).when(F.length(d) < 10, 1).when(F.length(d) < 13, 2)
                      .when(F.length(d) < 20, 3).otherwise(4))
    kinds = F.array_distinct(F.split(F.regexp_replace(m, "[A-Za-z0-9]", ""), ""))
    return let(_digits(m), lambda d: F.array(
        bins(d), F.least(F.size(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))), F.lit(9)),
        m.rlike("^[(]").cast("int"), ((d != "") & F.call_function("luhn_check", d)).cast("int"), m.rlike(_PARTS).cast("int"),
        F.least(F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit(""))), F.lit(3)), m.rlike("[A-Za-z]{2,6}$").cast("int"),
        kind_of(F.substring(c["before"], -1, 1)), kind_of(F.substring(c["after"], 1, 1)),
        ascii_lower(c["before"]).rlike(CUES[kind]).cast("int"), F.least(F.length(_digits(c["before"])), F.lit(3)),
        F.least(F.size(F.array_distinct(F.split(d, ""))), F.lit(10)), F.least(F.size(kinds), F.lit(4)),
        m.contains("@").cast("int")).cast("array<int>"))


def candidates(kind: str, text: Column) -> Column:
    """Of a text: start, end, base (found by the base rule) and features x."""
    def found(pattern):
        return F.when(text.rlike(_NEEDS[kind]), matches(text, pattern)).otherwise(F.array().cast(_MATCH))

    def described(c, base):
        return F.struct(c["start"], c["end"], F.lit(base).alias("base"), features(kind, c).alias("x"))

    own = F.filter(found(BASE[kind]), lambda c: valid(kind, c["m"]))
    other = F.filter(found(WIDE[kind]), lambda c: ~(c["m"].rlike(f"^(?:{BASE[kind]})$") & valid(kind, c["m"])))
    return F.concat(F.transform(own, lambda c: described(c, True)), F.transform(other, lambda c: described(c, False)))


class Trees:
    """Boosted trees of depth two of every kind, and the kinds' thresholds."""

    def __init__(self):
        self.start: dict[int, float] = {}
        #: By kind: (feature, bound), the children's (feature, bound) and the four leaves.
        self.trees: dict[int, list] = {}
        self.least: dict[int, float] = {}

    def margin(self, kind: Column, x: Column) -> Column:
        """Sum of the leaves that ``x`` reaches; the trees are one literal, so
        the expression is the same however many there are."""
        def row(split, inner, leaves):
            numbers = [n for at in (split, *inner) for n in at or (0, 1 << 30)]
            return "array(" + ",".join(f"{float(n)!r}D" for n in (*numbers, *leaves)) + ")"

        def side(t, i, yes, no):
            return F.when(F.get(x, t[i].cast("int")) <= t[i + 1], yes).otherwise(no)

        none = "slice(array(array(0D)), 1, 0)"
        every = ",".join("array(" + ",".join(row(*t) for t in own) + ")" if own else none
                         for own in (self.trees.get(k) for k in range(len(KINDS))))
        starts = ",".join(f"{self.start.get(k, 0.0)!r}D" for k in range(len(KINDS)))
        return F.aggregate(F.get(F.expr(f"array({every})"), kind), F.get(F.expr(f"array({starts})"), kind), lambda total, t:
                           total + side(t, 0, side(t, 2, t[6], t[7]), side(t, 4, t[8], t[9])))

    @staticmethod
    def _side(x: Column, split) -> Column:
        return F.get(x, F.lit(split[0])) <= split[1] if split else F.lit(True)


def _best_split(cells: dict, total: tuple[float, float]):
    """Feature and bound of the greatest gain; cells: (feature, value) to sums
    of gradients and curvatures. None if nothing is gained."""
    def worth(g, h):
        return g * g / (h + SHRINK)

    best, split = 1e-6, None
    for feature in sorted({f for f, _ in cells}):
        g = h = 0.0
        for value in sorted(v for f, v in cells if f == feature)[:-1]:
            g, h = g + cells[feature, value][0], h + cells[feature, value][1]
            gain = round(worth(g, h) + worth(total[0] - g, total[1] - h) - worth(*total), 6)
            if gain > best:
                best, split = gain, (feature, value)
    return split


def fit(vectors: DataFrame) -> Trees:
    """Learn from distinct vectors: kind, held (calibration fold), base, x, n."""
    trees = Trees()
    rows = vectors.select("kind", "held", F.col("base").cast("int").alias("y"), "x", (1 + F.log("n")).alias("w"))
    train = rows.where(~F.col("held"))
    for r in train.groupBy("kind").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("y")).collect():
        share = min(max(r.y / r.w, 1e-3), 1 - 1e-3)
        trees.start[r.kind] = math.log(share / (1 - share))
        trees.trees[r.kind] = []

    def sums(node: Column):
        p = 1 / (1 + F.exp(-trees.margin(F.col("kind"), F.col("x"))))
        cells = train.select("kind", node.alias("node"), (F.col("w") * (p - F.col("y"))).alias("g"),
                             (F.col("w") * p * (1 - p)).alias("h"), F.posexplode("x").alias("feature", "value"))
        out: dict = {}
        for r in cells.groupBy("kind", "node", "feature", "value").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            out.setdefault((r.kind, r.node), {})[r.feature, r.value] = (r.g, r.h)
        return out

    def total(cells):
        own = [v for (f, _), v in cells.items() if f == 0]
        return sum(g for g, _ in own), sum(h for _, h in own)

    for _ in range(ROUNDS if trees.start else 0):
        first = {k: _best_split(c, total(c)) for (k, _), c in sums(F.lit(0)).items()}
        if not any(first.values()):
            break
        side = F.coalesce(*[F.when(F.col("kind") == k, F.when(trees._side(F.col("x"), s), 0).otherwise(1)) for k, s in first.items()])
        below = sums(side)
        for k, split in first.items():
            if split is None:
                continue
            inner, leaves = [], []
            for node in (0, 1):
                cells = below.get((k, node), {})
                inner.append(_best_split(cells, total(cells)) if cells else None)
                low = {c: v for c, v in cells.items() if inner[-1] and c[0] == inner[-1][0]}
                part = [total(cells)] * 2 if not inner[-1] else [
                    [sum(v[i] for c, v in low.items() if (c[1] <= inner[-1][1]) == keep) for i in (0, 1)] for keep in (True, False)]
                leaves += [round(-RATE * g / (h + SHRINK), 9) for g, h in part]
            trees.trees[k].append((split, inner, leaves))

    held = rows.where("held").select("kind", "y", "w", F.round(trees.margin(F.col("kind"), F.col("x")), 9).alias("margin"))
    seen = held.groupBy("kind", "margin").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("y")).collect()
    for k in trees.start:
        w = y = 0.0
        least = below = None
        for r in sorted((r for r in seen if r.kind == k and r.margin is not None), key=lambda r: -r.margin):
            w, y = w + r.w, y + r.y
            if r.y > 0 and y >= PRECISION * w:
                least, below = r.margin, None
            elif below is None:
                below = r.margin
        if least is not None:
            # Halfway to the candidates that would cost too much precision.
            trees.least[k] = least if below is None else round((least + below) / 2, 9)
    return trees


def _candidate_rows(docs: DataFrame, names: list[str]) -> DataFrame:
    """The stored rows: the caller's columns (as c0, c1, ... of ``own``), the
    fold and the candidates by kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return materialize(docs.select(
        F.struct(F.lit(0).alias("row"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("own"),
        (F.pmod(F.xxhash64(text), F.lit(FOLDS)) == 0).alias("held"), *[candidates(k, text).alias(k) for k in KINDS]), "pii-candidates")


def vectors_of(rows: DataFrame) -> DataFrame:
    """Every distinct feature vector of all candidates with its occurrences."""
    def numbered(n: int, kind: str) -> Column:
        return F.transform(kind, lambda c: F.struct(F.lit(n).alias("kind"), c["base"].alias("base"), c["x"].alias("x")))

    each = F.concat(*[numbered(n, k) for n, k in enumerate(KINDS)])
    keys = ["kind", "held", "base", "x"]
    counted = rows.select("held", F.inline(each)).groupBy(*keys).agg(F.count("*").alias("n"))
    return materialize(counted, "pii-vectors")


def _all_spans(rows: DataFrame, trees: Trees | None) -> Column:
    """Spans of the base rules and, with trees, what they add."""
    def spans(n: int, kind: str) -> Column:
        def chosen(c):
            if trees is None or n not in trees.least:
                return c["base"]
            return c["base"] | (F.round(trees.margin(F.lit(n), c["x"]), 9) >= trees.least[n])
        return F.transform(F.filter(kind, chosen), lambda c: F.struct(
            F.lit(n).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return F.array_sort(F.concat(*[spans(n, k) for n, k in enumerate(KINDS)]))


def find(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Every input column (text only with ``keep_text``), n_<kind> of the base
    rules, base_spans and spans: arrays of (kind number, start, end) by kind and place."""
    names = replace_columns(docs, ("spans", *(f"n_{k}" for k in KINDS), "base_spans", *(() if keep_text else ("text",)))).columns
    rows = _candidate_rows(docs, names)
    trees = fit(vectors_of(rows))
    return rows.select(*[F.col(f"own.c{i}").alias(c) for i, c in enumerate(names)],
                       *[F.size(F.filter(k, lambda c: c["base"])).cast("long").alias(f"n_{k}") for k in KINDS],
                       _all_spans(rows, None).alias("base_spans"), _all_spans(rows, trees).alias("spans"))


def said(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, mark: str = "[PII]") -> DataFrame:
    """The documents with every stretch of spans replaced by ``mark``."""
    names = docs.columns
    rows = _candidate_rows(docs, names)
    found = rows.select("own", _all_spans(rows, fit(vectors_of(rows))).alias("spans"))
    at = [c.lower() for c in names].index("text")
    text = F.coalesce(F.col(f"own.c{at}"), F.lit(""))
    # In the order of starts a stretch begins where no span before reaches.
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def cut(s):
        def pieces(reach):
            begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (
                F.get(s["start"], i) > F.get(reach, F.greatest(i - 1, F.lit(0)))))
            def around(b):
                kept = F.transform(b, lambda i, k: F.struct(
                    F.when(k == 0, 0).otherwise(F.get(reach, i - 1)).alias("from"), F.get(s["start"], i).alias("to")))
                head = F.transform(kept, lambda p: F.substr(text, p["from"] + 1, p["to"] - p["from"]))
                return F.concat(F.array_join(head, mark), F.lit(mark), F.substr(text, F.get(reach, F.size(s) - 1) + 1))
            return let(begins, around)
        return let(running(s["end"], lambda a, b: F.greatest(a, b), F.lit(0)), pieces)

    clean = F.when(F.size("spans") > 0, let(order, cut)).otherwise(F.col(f"own.c{at}"))
    return found.select(*[(clean if i == at else F.col(f"own.c{i}")).alias(c) for i, c in enumerate(names)])
