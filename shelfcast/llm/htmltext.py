"""HTML extraction by equivalence-class template deduction.

A page's markup is read as tokens: an element under its path of enclosing
elements (tag, class, id, role; numbers in them do not count). Over the pages
of one host, tokens with the same occurrence vector (how often on each page)
form an equivalence class. A class is valid if it has two tokens or more, occurs
once on each of its pages, and has ``LEAST_PAGES`` pages, however many the host
has; so every layout of a host has its own. Valid classes nest by their paths
into the host's template. Text belongs to the slot of the nearest token around
it that is in the template, through any holders that are not.

Every slot that holds article text is kept, and a page's text is what it has in
such slots, in page order: its articles; if it has none, its main part; else
the slots that have more running text than link text, and ``LEAST_TEXT``
characters of it on an average page. A smaller slot of only some of the pages
goes with the slot around it. Where a page has more text than that in a part of
the template that has next to none on other pages, that part is kept too.

Text blocks are tokens too: a block that stands in the same place on three
quarters of the pages that have the place, ``LEAST_PAGES`` at least, is
template text and left out. If such blocks make up more than half of their
pages' text, the pages are copies of one article, and nothing is left out.

Menus, page headers, footers, sidebars, notices, adverts, forms, hidden parts
and reader comments are recognized by markup and by words of class and id, but
this is a vote only: it is void for an element that holds most of the running
text of the pages it is on, or by its words alone hides their only article,
unless an article or main part without votes has at least a quarter of the
element's text. Elements that never hold text (scripts, styles, controls) go.

Vectors are never gathered: a vector is represented by sums of a hash of
(page, count) that are added up before and after the shuffle, so a host with a
third of all pages is no larger than any other. Hosts with fewer than
``LEAST_PAGES`` pages use the template deduced from the pages of all hosts.

Each block's character references are decoded, its white space becomes single
blanks, and blocks are joined by line ends in page order.

Defined results: null or empty html has an empty text; a null url has the
empty host; repeated rows get equal results; pages that lack the host's slot
fall back to their own article or body, with votes counted on that page.
Input columns named like a result are replaced.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import replace_columns
from .urlfilter import host

LEAST_PAGES = 4
#: Running text, without blanks, that a slot has on an average page.
LEAST_TEXT = 30
#: Templates of so many hosts are sent to all executors; more are joined.
SENT_HOSTS = 5_000

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: An unquoted value at the end of a tag, whose slash is its own.
_OPEN_VALUE = re.compile(r"=\s*[^\s\"'>=]+\Z")
_WORDS = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without text of the page.
DROPPED = frozenset("script style template iframe svg button select option textarea object embed canvas audio video head title input "
                    "applet map math frameset".split())
#: Elements that seldom hold article text.
VOTED = frozenset("nav footer aside form noscript dialog menu fieldset".split())
#: Words of class or id that mark such parts.
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion promoted "
    "cookie cookies consent gdpr notice notices alert newsletter subscribe subscription popup modal overlay paywall "
    "comment comments commentlist replies respond disqus discussion sidebar aside rail menu nav navbar navigation breadcrumb "
    "breadcrumbs share sharing social related recommended recommendations footer masthead topbar toolbar pager pagination "
    "login signup search searchbox widget widgets copyright disclaimer hidden skip".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MAIN_WORDS = frozenset("article post entry story articlebody maincontent postcontent entrycontent content main text body".split())
_QUALIFIED = frozenset("has with without no".split())
_PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption".split())
_CLOSES_P = frozenset("p div ul ol dl table h1 h2 h3 h4 h5 h6 pre blockquote section article main nav aside header footer form hr "
                      "fieldset figure address details menu".split())
_HOLDERS = frozenset("article section main div td th body li dd blockquote table figure aside header footer nav form".split())
_SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "td": ("td", ("tr",)), "th": ("th", ("tr",)), "tr": ("tr", ("table",)),
             "dt": ("dd", ("dl",)), "dd": ("dt", ("dl",)), "option": ("option", ("select",))}

#: Parts of lists, tables and figures, which are inside of slots.
_UNSLOTTED = _PARAGRAPHS - {"td"} | frozenset("ul ol dl table caption thead tbody tfoot tr figure hr br".split())

#: What an element is to the extraction; TEXT is a main part by its words only.
PLAIN, DROP, MAIN, ARTICLE, HEADER, TEXT = range(6)
#: Who votes against an element.
BY_WORD, BY_MARKUP = 1, 2


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}


def element(tag: str, raw: str, cache: dict) -> tuple[str, int, int]:
    """The element's signature in a path, what it is, and who votes against it."""
    got = cache.get((tag, raw))
    if got is not None:
        return got
    a = _attributes(raw) if raw.strip(" /\t\n\r") else {}
    role = a.get("role", "").lower()
    words = _WORDS.findall(_CAMEL.sub(" ", a.get("class", "") + " " + a.get("id", "")).lower())
    plain = [w for i, w in enumerate(words) if not (i and words[i - 1] in _QUALIFIED)]
    style = a.get("style", "").replace(" ", "").lower()
    kind, vote = PLAIN, 0
    if tag in DROPPED:
        kind = DROP
    elif tag == "article" or "articlebody" in a.get("itemprop", "").lower():
        kind = ARTICLE
    elif tag == "main" or role == "main":
        kind = MAIN
    elif tag in ("div", "section", "td") and any(w in MAIN_WORDS for w in plain):
        kind = TEXT
    elif tag == "header":
        kind = HEADER
    if tag in VOTED or role in DROPPED_ROLES or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style:
        vote = BY_MARKUP
    elif tag not in ("body", "html", "main") and any(w in DROPPED_WORDS for w in plain):
        vote = BY_WORD
    named = sorted({"0" if w.isdigit() else w for w in words})
    sign = " ".join((tag, ".".join(named), role)) if a else tag
    if len(cache) < 20_000:
        cache[(tag, raw)] = sign, kind, vote
    return sign, kind, vote


def walk(html: str, cache: dict, on_text, on_open, on_close) -> None:
    """Reads a page once. ``on_open(path, tag, kind, vote)`` and ``on_close(tag)``
    follow the elements, ``on_text`` the text between."""
    import xxhash
    stack: list[tuple[str, int]] = []
    paths = [0]
    path_of = cache.setdefault("paths", {})

    def pop_to(k: int) -> None:
        while len(stack) > k:
            on_close(stack.pop()[0])
            paths.pop()

    def find(tags, stops) -> int:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                return k
            if stack[k][0] in stops:
                break
        return -1

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            on_text(html[at:])
            break
        if m.start() > at:
            on_text(html[at:m.start()])
        at = m.end()
        end, tag, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if end:
            k = find((tag,), ()) if tag not in INLINE else find((tag,), _HOLDERS)
            if k >= 0:
                pop_to(k)
            continue
        if tag in _CLOSES_P:
            k = find(("p",), _HOLDERS)
            if k >= 0:
                pop_to(k)
        if tag in _SIBLINGS:
            other, stops = _SIBLINGS[tag]
            k = find((tag, other), stops)
            if k >= 0:
                pop_to(k)
        sign, kind, vote = element(tag, raw, cache)
        if tag in INLINE and not vote:
            path = paths[-1]
        else:
            key = (paths[-1], sign)
            path = path_of.get(key)
            if path is None:
                path = xxhash.xxh64_intdigest(f"{paths[-1]} {sign}") >> 1
                if len(path_of) < 200_000:
                    path_of[key] = path
        on_open(path, tag, kind, vote)
        if tag in VOID or raw.endswith("/") and not _OPEN_VALUE.search(raw):
            on_close(tag)
            continue
        if tag in RAW:
            k = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
            at = k.end() if k else n
            on_close(tag)
            continue
        stack.append((tag, path))
        paths.append(path)
    pop_to(0)


#: Of a token on one page, and summed over pages: occurrences, kind, vote, text without links, link text, text in articles,
#: depth, may it be a slot, parent; then of the whole page: its text, text of articles and main parts without votes, and all text
#: without votes.
N, KIND, VOTE, MASS, LINKS, IN_ARTICLE, DEPTH, HOLDER, PARENT, AROUND, CLEAN, PLAIN_TEXT = range(12)


class Template(NamedTuple):
    """Of a host: paths of articles, main parts, all slots, slots with article
    text, slots with next to no text, and paths whose votes are void; and
    (holder, hash) of template text."""

    articles: frozenset = frozenset()
    mains: frozenset = frozenset()
    slots: frozenset = frozenset()
    content: frozenset = frozenset()
    light: frozenset = frozenset()
    kept: frozenset = frozenset()
    constant: frozenset = frozenset()


def void(vote: int, mass: int, in_article: int, around: int, clean: int) -> bool:
    """Does an element stay although there is a vote against it?"""
    return clean * 4 < mass and (mass * 2 >= around or vote == BY_WORD and in_article * 4 >= around)


class _Survey:
    """Tokens of one page, and its blocks: (holder, hash) -> length."""

    def __init__(self):
        self.tokens: dict[int, list] = {}
        self.blocks: dict[tuple[int, int], int] = {}
        self.open: list[list] = []                   # token or None, path, tag, kind, vote, mass, links, in articles
        self.holders = [0]
        self.dropped = self.links = self.votes = self.articles = self.mains = 0
        self.around = self.clean = self.plain = 0
        self.parts: list[str] = []

    def end_block(self):
        if self.parts:
            key = self.holders[-1], block_hash("".join(self.parts))
            self.blocks[key] = sum(map(len, self.parts)) - sum(x.count(" ") for x in self.parts)
            self.parts = []

    def on_open(self, path, tag, kind, vote):
        inline = tag in INLINE and not vote
        if not inline:
            self.end_block()
        t = None
        self.dropped += kind == DROP
        self.links += tag == "a"
        self.votes += vote > 0
        self.articles += kind == ARTICLE
        self.mains += kind in (ARTICLE, MAIN)
        holder = not inline and (tag not in _PARAGRAPHS or tag in ("td", "li"))
        if not inline and not self.dropped:
            t = self.tokens.get(path)
            if t is None:
                parent, above = next(((f[1], f[0][DEPTH]) for f in reversed(self.open) if f[0] is not None), (0, 0))
                self.tokens[path] = t = [0, PLAIN if tag in _PARAGRAPHS else kind, vote, 0, 0, 0, above + 1,
                                         tag not in _UNSLOTTED and not inline, parent, 0, 0, 0]
            t[N] += 1
        self.open.append([t, path, tag, kind, vote, 0, 0, 0])
        if holder:
            self.holders.append(path)

    def on_close(self, tag):
        t, path, tag, kind, vote, mass, links, in_article = self.open.pop()
        inline = tag in INLINE and not vote
        if not inline:
            self.end_block()
            if tag not in _PARAGRAPHS or tag in ("td", "li"):
                self.holders.pop()
        if t is not None:
            t[MASS] += mass
            t[LINKS] += links
            t[IN_ARTICLE] += in_article
        if self.open:
            up = self.open[-1]
            up[5] += mass
            up[6] += links
            up[7] += in_article
        self.dropped -= kind == DROP
        self.links -= tag == "a"
        self.votes -= vote > 0
        self.articles -= kind == ARTICLE
        self.mains -= kind in (ARTICLE, MAIN)

    def on_text(self, text):
        if self.dropped or not self.open:
            return
        self.parts.append(text)
        n = len(text) - text.count(" ")
        top = self.open[-1]
        if self.links:
            top[6] += n
            return
        top[5] += n
        self.around += n
        if self.articles:
            top[7] += n
        if not self.votes:
            self.plain += n
            if self.mains:
                self.clean += n


def block_hash(raw: str) -> int:
    import xxhash
    return xxhash.xxh64_intdigest(" ".join(raw.split())) >> 1


def survey(html: str, cache: dict) -> _Survey:
    s = _Survey()
    walk(html, cache, s.on_text, s.on_open, s.on_close)
    s.end_block()
    for t in s.tokens.values():
        t[AROUND], t[CLEAN], t[PLAIN_TEXT] = s.around, s.clean, s.plain
    return s


class _Extract:
    """Blocks of text inside the chosen slots. ``main`` (path, tag, kind): does
    a slot with article text begin here (True), another slot (False), or none
    (None)? ``kept``: paths whose votes are void. ``constant``: (holder, hash)
    of template text. ``light``: slots whose running text is counted."""

    def __init__(self, main, kept, constant, light=frozenset()):
        self.main, self.kept, self.constant, self.light = main, kept, constant, light
        self.open: list[tuple] = []
        self.holders = [0]
        self.inside = self.in_light = False
        self.dropped = self.articles = self.links = self.missed = 0
        self.found = False
        self.blocks: list[str] = []
        self.parts: list[str] = []

    def end_block(self):
        if self.parts:
            raw = "".join(self.parts)
            text = " ".join(unescape(raw).split())
            if text and not (self.constant and (self.holders[-1], block_hash(raw)) in self.constant):
                self.blocks.append(text)
            self.parts = []

    def on_open(self, path, tag, kind, vote):
        inline = tag in INLINE and not vote
        if not inline:
            self.end_block()
        elif tag == "br":
            self.parts.append(" ")
        before = self.inside, self.in_light
        drop = kind == DROP or vote > 0 and path not in self.kept
        slot = None if inline or drop or self.dropped else self.main(path, tag, kind)
        # A header belongs to the page unless it stands in an article.
        drop = drop or not (slot and not self.inside) and kind == HEADER and not self.articles and path not in self.kept
        self.articles += kind == ARTICLE
        self.dropped += drop
        self.links += tag == "a"
        if slot is not None and not drop:
            self.found |= slot
            self.inside, self.in_light = slot, path in self.light
        holder = not inline and (tag not in _PARAGRAPHS or tag in ("td", "li"))
        self.open.append((before, drop, kind == ARTICLE, inline, holder))
        if holder:
            self.holders.append(path)

    def on_close(self, tag):
        before, drop, article, inline, holder = self.open.pop()
        if not inline:
            self.end_block()
        if holder:
            self.holders.pop()
        self.inside, self.in_light = before
        self.dropped -= drop
        self.articles -= article
        self.links -= tag == "a"

    def on_text(self, text):
        if self.dropped:
            return
        if self.inside:
            self.parts.append(text)
        elif self.in_light and not self.links:
            self.missed += len(text) - text.count(" ")


def extract(html: str, template: Template, cache: dict) -> str:
    """Main text of one page by its host's template, if it has one."""
    def run(main, kept, light=frozenset()):
        e = _Extract(main, kept, constant, light)
        walk(html, cache, e.on_text, e.on_open, e.on_close)
        e.end_block()
        return e

    template = template or Template()
    constant = template.constant
    for paths in (template.articles, template.mains):
        if paths and (e := run(lambda path, tag, kind, paths=paths: path in paths or None, template.kept)).found:
            return "\n".join(e.blocks)
    content = template.content
    if template.slots:
        e = run(lambda path, tag, kind: path in content if path in template.slots else None, template.kept, template.light)
        if e.missed > 4 * LEAST_TEXT:
            content = content | template.light
            e = run(lambda path, tag, kind: path in content if path in template.slots else None, template.kept)
        if e.found:
            return "\n".join(e.blocks)
    # Without the host's slots, the page's own text weighs the votes.
    kept = template.kept | {path for path, t in survey(html, cache).tokens.items() if (t[VOTE] or t[KIND] == HEADER) and void(
        t[VOTE], t[MASS], t[IN_ARTICLE], t[AROUND], t[CLEAN])}
    for main in (lambda path, tag, kind: kind == ARTICLE or None, lambda path, tag, kind: kind == MAIN or None,
                 lambda path, tag, kind: kind == TEXT or None, lambda path, tag, kind: tag == "body" or None,
                 lambda path, tag, kind: True):
        if (e := run(main, kept)).found:
            return "\n".join(e.blocks)
    return " ".join(unescape(html).split()) if "<" not in html else ""


#: Rows of tokens, and (block not null) of text blocks, of which only site, token, block, pages and mass count.
_ROWS = ("site string, token long, block long, pages long, occurrences long, v1 decimal(38,0), v2 decimal(38,0), kind int, vote int, "
         "mass long, links long, in_article long, depth long, holder boolean, parent long, around long, clean long, "
         "plain long")


def _survey_rows(batches):
    """Tokens and blocks of a batch's pages, already added up per host and,
    tokens, for all."""
    from decimal import Decimal

    import pyarrow as pa
    import xxhash
    cache: dict = {}
    names = [c.split()[0] for c in _ROWS.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}.get(
        c.split()[1], pa.decimal128(38, 0)) for c in _ROWS.split(", ")]
    for batch in batches:
        total: dict[tuple, list] = {}
        blocks: dict[tuple, list] = {}
        for site, url, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
            html = html or ""
            page = xxhash.xxh64_intdigest(f"{url}\0{html}")
            seen = survey(html, cache)
            tokens = seen.tokens
            tokens[0] = [1, DROP, 0, 0, 0, 0, 0, False, 0, seen.around, seen.clean, seen.plain]           # the page itself
            for token, (n, kind, vote, mass, links, art, depth, holder, parent, around, clean, plain) in tokens.items():
                h = xxhash.xxh64_intdigest(f"{page} {n}")
                for s in {site, ""}:
                    t = total.get((s, token))
                    if t is None:
                        t = total[(s, token)] = [None, 0, 0, 0, 0, kind, vote, 0, 0, 0, depth, holder, parent, 0, 0, 0]
                    t[1] += 1
                    t[2] += n
                    t[3] += h >> 32
                    t[4] += h & 0xFFFFFFFF
                    t[7] += mass
                    t[8] += links
                    t[9] += art
                    t[13] += around
                    t[14] += clean
                    t[15] += plain
            for (holder, block), size in seen.blocks.items():
                b = blocks.setdefault((site, holder, block), [0, 0])
                b[0] += 1
                b[1] += size
        rows = [(s, k, *v) for (s, k), v in total.items()]
        rows += [(s, k, b, n, 0, 0, 0, 0, 0, size, 0, 0, 0, False, 0, 0, 0, 0) for (s, k, b), (n, size) in blocks.items()]
        columns = list(map(list, zip(*rows))) if rows else [[] for _ in names]
        for i in (5, 6):
            columns[i] = [Decimal(x) for x in columns[i]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


_CHOSEN = Template._fields[:-1]


def _choose(site: str, rows: list) -> dict:
    """A host's ``Template`` without its text. Rows: tokens of ``LEAST_PAGES``
    pages or more."""
    tokens = {r["token"]: r for r in rows if r["token"]}
    kept = {k for k, r in tokens.items() if (r["vote"] or r["kind"] == HEADER) and void(
        r["vote"], r["mass"], r["in_article"], r["around"], r["clean"])}
    # Is a token left out by a vote, and is it in an article? From the outside in.
    within: dict[int, tuple[bool, bool]] = {}

    def around(k) -> tuple[bool, bool]:
        return within.get(k, (False, False))

    for k, r in sorted(tokens.items(), key=lambda x: x[1]["depth"]):
        out, article = around(r["parent"])
        against = r["vote"] or r["kind"] == HEADER and not article
        within[k] = out or bool(against) and k not in kept, article or r["kind"] == ARTICLE

    def whole(kind, share) -> list[int]:
        """Articles or main parts, if one has its share of its pages' text;
        others then need a tenth."""
        some = {k: r for k, r in tokens.items() if r["kind"] == kind and not around(k)[0] and r["mass"] > r["links"]}
        if not any(r["mass"] * share >= r["plain"] for r in some.values()):
            return []
        return [k for k, r in some.items() if r["mass"] * 10 >= r["plain"]]

    slots = {k for k, r in tokens.items() if r["valid"] and r["holder"] and not around(k)[0]}
    outer, mass, links = {}, {k: tokens[k]["mass"] for k in slots}, {k: tokens[k]["links"] for k in slots}
    for k, r in tokens.items():
        cut = around(k)[0] and not around(r["parent"])[0]
        if k in slots or cut:
            up = r["parent"]
            while up in tokens and up not in slots:
                up = tokens[up]["parent"]
            if up in slots:
                outer[k] = up
                mass[up] -= r["mass"]
                links[up] -= r["links"]
    running = {k for k in slots if mass[k] > links[k]}
    content = {k for k in running if mass[k] >= LEAST_TEXT * tokens[k]["pages"]}
    if running and not content:
        content = {max(running, key=lambda k: (mass[k], k))}
    for k in sorted(slots - content, key=lambda k: tokens[k]["depth"]):
        if outer.get(k) in content and tokens[k]["pages"] < tokens[outer[k]]["pages"] and mass[k] >= links[k]:
            content.add(k)
    light = {k for k in slots - content if k in outer.values() and mass[k] < LEAST_TEXT * tokens[k]["pages"]}
    return {"site": site, "articles": whole(ARTICLE, 4), "mains": whole(MAIN, 2), "slots": sorted(slots), "content": sorted(content),
            "light": sorted(light), "kept": sorted(kept)}


def templates(pages: DataFrame) -> DataFrame:
    """site and the fields of its ``Template`` for every host with enough pages
    and (site empty) for all pages together. Reads site, url, html."""
    seen = materialize(pages.select("site", "url", "html").mapInArrow(_survey_rows, _ROWS), "html-survey")
    sums = [F.sum(c).alias(c) for c in ("pages", "occurrences", "v1", "v2", "mass", "links", "in_article", "around", "clean", "plain")]
    tops = [F.max(c).alias(c) for c in ("kind", "vote", "depth", "holder", "parent")]
    tokens = materialize(seen.where("block is null").groupBy("site", "token").agg(*sums, *tops)
                         .where(f"pages >= {LEAST_PAGES} or token = 0"), "html-tokens")
    sizes = tokens.where(f"token = 0 and (pages >= {LEAST_PAGES} or site = '')").select("site", F.col("pages").alias("of"))
    # Equivalence classes: tokens of a site with one occurrence vector. For all
    # hosts together, only tokens on a thousandth of the pages count.
    vector = ["site", "pages", "occurrences", "v1", "v2"]
    known = tokens.join(sizes, "site").where("site != '' or pages * 1000 >= of")
    classes = known.where("occurrences = pages and token != 0").groupBy(*vector).agg(F.count("*").alias("members")).where("members >= 2")
    known = known.join(classes, vector, "left").withColumn("valid", F.col("members").isNotNull())
    fields = ["token", "pages", "v1", "v2", "kind", "vote", "mass", "links", "in_article", "depth", "holder", "parent", "around", "clean",
              "plain", "valid"]

    def choose(batches):
        import pyarrow as pa
        for batch in batches:
            found = [_choose(site, rows) for site, rows in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_pylist(found, pa.schema([
                ("site", pa.string()), *[(c, pa.list_(pa.int64())) for c in _CHOSEN]]))

    chosen = (known.groupBy("site").agg(F.collect_list(F.struct(*fields)).alias("rows"))
              .mapInArrow(choose, ", ".join(["site string", *[f"{c} array<long>" for c in _CHOSEN]])))
    # Template text, unless it is most of what the pages of its place have.
    places = tokens.where("site != ''").select("site", "token", F.col("pages").alias("of"), "v1", "v2", "around")
    blocks = (seen.where("block is not null").groupBy("site", "token", "block").agg(F.sum("pages").alias("n"), F.sum("mass").alias("mass"))
              .where(f"n >= {LEAST_PAGES}").join(places, ["site", "token"]).where("n * 4 >= of * 3"))
    constant = (blocks.groupBy("site", "of", "v1", "v2", "around").agg(
        F.sum("mass").alias("mass"), F.collect_list(F.struct("token", "block")).alias("found"))
        .where("mass * 2 <= around").groupBy("site").agg(F.flatten(F.collect_list("found")).alias("constant")))
    return chosen.join(constant, "site", "left")


def extract_text(pages: DataFrame) -> DataFrame:
    """Every input row and column plus ``text`` (main text, empty if none)
    and ``n_chars`` (its code points)."""
    pages = replace_columns(pages, ("text", "n_chars"))
    own = list(pages.columns)
    sited = pages.withColumn("site_", host())
    found = materialize(templates(sited.select(F.col("site_").alias("site"), "url", "html")), "html-templates")
    shared = found.where("site = ''").collect()
    shared = Template(*[frozenset(shared[0][c]) for c in _CHOSEN]) if shared else Template()
    named = found.where("site != ''").select(F.col("site").alias("site_"), F.struct(*Template._fields).alias("template_"))
    if named.count() <= SENT_HOSTS:
        named = F.broadcast(named)
    work = sited.join(named, "site_", "left").select(*[F.col(f"`{c}`") for c in own], "template_")
    at, width = [c.lower() for c in own].index("html"), len(own)
    names = [*own, "text", "n_chars"]

    def run(batches):
        import pyarrow as pa
        cache: dict = {}

        def text(html, t):
            if t is None:
                return extract(html, shared, cache)
            return extract(html, Template(*[frozenset(t[c]) for c in _CHOSEN], frozenset(
                (c["token"], c["block"]) for c in t["constant"] or ())), cache)

        for batch in batches:
            texts = [text(html or "", t) for html, t in zip(batch.column(at).to_pylist(), batch.column(width).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names)

    schema = T.StructType([*pages.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return work.mapInArrow(run, schema)
