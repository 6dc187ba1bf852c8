"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over the lower-cased ``host + path`` of a URL,
with an action and a weight; its literal tokens are the runs of letters and
digits that every match must contain whole. The frequency of these tokens is
counted over all URLs, and each rule is filed under its rarest one. A URL's
tokens fetch the candidate rules, and only those run their expressions.

Host rules (``example.net/en/``: the host, its subdomains, and paths that
begin so) are pattern rules too; the longest that fits decides. Where none
fits, the URL is blocked if any other rule matches.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: then up to ``?``, ``#`` or the end; null or no ``://``: both
empty. Rules travel to the executors in groups of at most ``GROUP`` rules; a
larger list takes several passes with the same result. Input columns named
like a result are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, replace_columns

GROUP = 200_000
_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """``name``: what is reported (null for patterns of the method's own);
    ``tokens``: literals of which each match contains every one as a token."""

    pattern: str
    action: str
    tokens: tuple[str, ...]
    name: str | None = None


def host_rule(action: str, rule: str) -> Rule:
    """A rule ``host/path`` fits the host and its subdomains, and paths that
    begin with ``/path``."""
    host, slash, path = rule.partition("/")
    tokens = _TOKEN.findall(host)
    return Rule(rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", action, tuple(tokens), rule)


def word_rule(*words: str) -> Rule:
    """Blocks URLs with these words next to each other, as whole tokens."""
    return Rule(r"(?:^|[^a-z0-9])" + r"[-_.]".join(map(re.escape, words)) + r"(?![a-z0-9])", "block", words)


#: The host rules of the contract.
HOST_RULES = (host_rule("block", "net/"), host_rule("allow", "example.net/en/"),
              host_rule("block", "example.com/de/"), host_rule("allow", "org/fr/"))
#: The method's own rules: words of link farms, pill and betting pages.
WORD_RULES = (word_rule("cheap", "pills"), word_rule("free", "bets"), word_rule("spam", "farm"),
              word_rule("online", "casino"), word_rule("payday", "loans"), word_rule("buy", "followers"),
              word_rule("adult", "cams"), word_rule("replica", "watches"))


def host(url: str = "url") -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _index(urls: DataFrame, rules: list[Rule]) -> dict[str, list[Rule]]:
    """Rules under their rarest token; frequencies are counted over all URLs.
    Rules without a token are filed under the empty one, which every URL has."""
    wanted = sorted({t for r in rules for t in r.tokens})
    counts: dict[str, int] = {}
    if wanted:
        spark = urls.sparkSession
        tokens = urls.select(F.explode(F.array_distinct(F.split(F.lower("site"), "[^a-z0-9]+"))).alias("t"))
        known = spark.createDataFrame([(t,) for t in wanted], "t string")
        counts = {r.t: r.n for r in tokens.join(F.broadcast(known), "t").groupBy("t").agg(F.count("*").alias("n")).collect()}
    out: dict[str, list[Rule]] = {}
    for r in rules:
        out.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)) if r.tokens else "", []).append(r)
    return out


def judge(pages: DataFrame, rules: tuple[Rule, ...] = HOST_RULES + WORD_RULES, group: int = GROUP) -> DataFrame:
    """Every input column plus host, path, rule (the longest named rule that
    fits, else null) and verdict (its action; else block if any other rule
    blocks, else allow)."""
    pages = replace_columns(pages, ("host", "path", "rule", "verdict"))
    own = list(pages.columns)
    work = pages.withColumns({"host": host(), "path": path()})
    sites = work.select(F.concat("host", "path").alias("site"))
    found = work.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow"), "method": F.lit("allow")})
    schema = T.StructType([*work.schema.fields, *(T.StructField(n, T.StringType()) for n in ("rule", "verdict", "method"))])
    names, at_host, at_path = found.columns, found.columns.index("host"), found.columns.index("path")
    width = len(work.columns)

    def one_pass(df: DataFrame, index: dict[str, list[Rule]]) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast(
            {t: [(r.pattern, r.name, r.action) for r in rs] for t, rs in index.items()})

        def run(batches):
            import pyarrow as pa
            by_token = {t: [(re.compile(p), name, action) for p, name, action in rs] for t, rs in sent.value.items()}
            always = by_token.get("", [])
            for batch in batches:
                rules_, verdicts, methods = (batch.column(width + i).to_pylist() for i in range(3))
                for i, (h, p) in enumerate(zip(batch.column(at_host).to_pylist(), batch.column(at_path).to_pylist())):
                    site = h + p
                    for t in set(_TOKEN.findall(site.lower())).intersection(by_token) | ({""} if always else set()):
                        for pattern, name, action in by_token[t]:
                            # Host rules compare the path as it is, words without case.
                            if name is not None:
                                if (rules_[i] is None or (len(name), name) > (len(rules_[i]), rules_[i])) and pattern.search(site):
                                    rules_[i], verdicts[i] = name, action
                            elif methods[i] != "block" and pattern.search(site.lower()):
                                methods[i] = action
                columns = list(batch.columns[:width])
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.string()) for x in (rules_, verdicts, methods))], names)

        return df.mapInArrow(run, schema)

    for a in range(0, len(rules), group):
        found = one_pass(found, _index(sites, list(rules[a:a + group])))
    verdict = F.when(F.col("rule").isNotNull(), F.col("verdict")).otherwise(F.col("method"))
    return found.select(*[F.col(f"`{c}`") for c in own], "host", "path", "rule", verdict.alias("verdict"))


ORACLE = r"""WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r AS (SELECT *, '.' || host AS h,
    regexp_matches(lower(host || path), '(^|[^a-z0-9])(cheap[-_.]pills|free[-_.]bets|spam[-_.]farm|online[-_.]casino|payday[-_.]loans|buy[-_.]followers|adult[-_.]cams|replica[-_.]watches)($|[^a-z0-9])') AS bad
  FROM p),
m AS (SELECT *, CASE
    WHEN ends_with(h, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ends_with(h, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ends_with(h, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ends_with(h, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM r)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block'
  WHEN rule IS NULL AND bad THEN 'block' ELSE 'allow' END AS verdict FROM m"""
