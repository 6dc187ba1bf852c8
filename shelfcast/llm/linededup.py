"""Line dedup: hashes of whole windows of lines, DataFrame functions only.

A *window* is a run of consecutive lines that just reaches ``run_lines`` lines
or ``run_words`` words (a line's spaces plus one; none in an empty line); its
extent depends on its own lines alone. A run of lines repeats if it contains a
window that occurs earlier in the corpus, and the lines of every later
occurrence are deleted.

This stands in for winnowing: every window is hashed whole, twice, and equal
windows are found by grouping on both hashes; no fingerprint positions are
joined and no match is extended from them. Winnowing's selected minimum (of
each window the line with the least hash, the first of ties) is only a filter
before that: equal windows select the same line, so windows whose minimum is
selected at one place only cannot repeat. Overlapping windows of one document merge into the maximal
repeated run. Groups are reduced before every shuffle and never expanded into
pairs.

Order of occurrences: doc_id (nulls last), then the text's hash, then the line
number. Rows that repeat doc_id and text are one document and get the same
result. Lines are cut at \\n. A document that loses every line gets an empty
text. Null texts stay null and lose nothing. Input columns named like a result
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import replace_columns

#: A repeated run has at least this many lines, or at least this many words.
RUN_LINES = 4
RUN_WORDS = 50


def _doc_hash() -> Column:
    return F.xxhash64("text")


def windows(docs: DataFrame, run_lines: int = RUN_LINES, run_words: int = RUN_WORDS) -> DataFrame:
    """One row per window: doc_id, doc_hash, start and size in lines, least
    (the selected line's hash), at (the selected line), and the window's two
    independent hashes g1, g2."""
    line_words = lambda x: F.when(x == "", 0).otherwise(
        F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1)
    lines = (docs.where("text is not null").select("doc_id", _doc_hash().alias("doc_hash"), F.split("text", "\n").alias("ls"))
             .select("doc_id", "doc_hash",
                     F.transform("ls", lambda x: F.xxhash64(x)).alias("h"),
                     F.transform("ls", lambda x: F.xxhash64(F.lit(7), x)).alias("h2"),
                     F.transform("ls", line_words).alias("w")))

    def sized(start: Column) -> Column:
        """Lines of the window that begins at ``start`` (from 0); 0: none."""
        total, size = F.lit(0), F.when(start + run_lines <= F.size("h"), run_lines).otherwise(0)
        steps = []
        for k in range(run_lines):
            total = total + F.coalesce(F.get("w", start + k), F.lit(0))
            steps.append((k + 1, total))
        for k, reached in reversed(steps):
            size = F.when((reached >= run_words) & (start + k <= F.size("h")), k).otherwise(size)
        return F.struct(start.alias("start"), size.alias("size"))

    placed = lines.select("doc_id", "doc_hash", "h", "h2", F.explode(F.filter(
        F.transform(F.sequence(F.lit(0), F.size("h") - 1), sized), lambda x: x["size"] > 0)).alias("x"))
    own = F.slice("h", F.col("x.start") + 1, F.col("x.size"))
    return (placed.select("doc_id", "doc_hash", "x.start", "x.size", own.alias("own"),
                          F.xxhash64(F.slice("h2", F.col("x.start") + 1, F.col("x.size")), "x.size").alias("g2"))
            .select("doc_id", "doc_hash", "start", "size", F.array_min("own").alias("least"),
                    (F.col("start") + F.array_position("own", F.array_min("own")) - 1).cast("int").alias("at"),
                    F.xxhash64("own", "size").alias("g1"), "g2"))


def repeated_lines(docs: DataFrame, run_lines: int = RUN_LINES, run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, doc_hash and ``cuts``: the (start, size) of every window of a
    document that occurs earlier in the corpus."""
    found = materialize(windows(docs, run_lines, run_words), "winnow")
    doc = [F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("doc_hash")]
    place, order = F.struct(*doc, "at"), F.struct(*doc, "start")
    shared = (found.groupBy("least").agg(F.min(place).alias("p"), F.max(place).alias("q"))
              .where(~F.col("p").eqNullSafe(F.col("q"))).select("least"))
    around = found.join(shared, "least", "left_semi").withColumn("o", order)
    firsts = (around.groupBy("g1", "g2").agg(F.min("o").alias("first"), F.max("o").alias("last"))
              .where("last > first").select("g1", "g2", "first"))
    later = around.join(firsts, ["g1", "g2"]).where("o > first")
    return later.groupBy("doc_id", "doc_hash").agg(F.collect_set(F.struct("start", "size")).alias("cuts"))


def dedup_lines(docs: DataFrame, run_lines: int = RUN_LINES, run_words: int = RUN_WORDS) -> DataFrame:
    """Every input row and column, ``text`` without the later occurrences of
    repeated runs, plus ``n_deleted`` (lines deleted)."""
    docs = replace_columns(docs, ("n_deleted",))
    cuts = repeated_lines(docs.select("doc_id", "text"), run_lines, run_words).select(
        F.col("doc_id").alias("cut_id"), F.col("doc_hash").alias("cut_hash"), F.col("cuts").alias("cuts_"))
    # An empty list of cuts and none are the same; nulls in doc_id match.
    got = docs.join(cuts, F.col("doc_id").eqNullSafe(F.col("cut_id")) & (_doc_hash() == F.col("cut_hash")), "left")
    gone = F.array_distinct(F.flatten(F.transform("cuts_", lambda c: F.sequence(c["start"], c["start"] + c["size"] - 1))))
    lines = F.split("text", "\n")
    text = F.when(F.col("cuts_").isNull(), F.col("text")).otherwise(
        F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone_", i)), "\n"))
    return (got.withColumn("gone_", gone)
            .select(*[text.alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns],
                    F.coalesce(F.size("gone_"), F.lit(0)).cast("int").alias("n_deleted")))


def oracle_sql(select: str, run_lines: int = RUN_LINES, run_words: int = RUN_WORDS, source: str = "documents") -> str:
    """The same rule in DuckDB SQL over doc_ids without repeats; ``select``
    reads the CTE ``deduped`` (every column, text replaced, n_deleted)."""
    lead = ", ".join(f"lead(line, {k}) OVER w AS l{k}, lead(words, {k}) OVER w AS w{k}" for k in range(1, run_lines))
    sums = " ".join(f"WHEN n - pos >= {k + 1} AND {' + '.join(['words'] + [f'w{i}' for i in range(1, k + 1)])} >= {run_words} THEN {k + 1}"
                    for k in range(run_lines))
    grams = " ".join(f"WHEN {k} THEN concat_ws(chr(10), '{k}', {', '.join(['line'] + [f'l{i}' for i in range(1, k)])})"
                     for k in range(1, run_lines + 1))
    return f"""WITH ln AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos,
         len(string_split(text, chr(10))) AS n
  FROM {source} WHERE text IS NOT NULL),
counted AS (SELECT *, CASE WHEN line = '' THEN 0 ELSE length(line) - length(replace(line, ' ', '')) + 1 END AS words FROM ln),
led AS (SELECT *, {lead} FROM counted WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
sized AS (SELECT *, CASE {sums} WHEN n - pos >= {run_lines} THEN {run_lines} END AS size FROM led),
win AS (SELECT doc_id, pos, size, CASE size {grams} END AS gram FROM sized WHERE size IS NOT NULL),
firsts AS (SELECT *, row_number() OVER (PARTITION BY gram ORDER BY doc_id, pos) AS nth FROM win),
gone AS (SELECT DISTINCT doc_id, pos + unnest(range(size)) AS pos FROM firsts WHERE nth > 1),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL) AS text, count(g.pos) AS n_deleted
  FROM ln l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id),
deduped AS (SELECT d.* REPLACE (CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text),
    CAST(coalesce(n_deleted, 0) AS INTEGER) AS n_deleted FROM {source} d LEFT JOIN kept k ON k.doc_id = d.doc_id)
{select}"""
