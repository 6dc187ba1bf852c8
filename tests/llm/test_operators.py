"""Training-data operators against brute-force versions, on tables with nulls,
empty and long texts, ties, repeated rows and clashing column names."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import (bpe, decontam, fmindex, htmltext, linededup, quality, reshard, simhash, tokenstore, topk,
                           transducer, urlfilter)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def texts():
    rng = random.Random(5)
    vocabulary = ["the", "of", "Thing", "über", "naïve,", "end.", "日本", "x1", "we'll", "a" * 70]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = [line(rng.randint(1, 60)) + "\n" + line(55) + "\n" + line(4) for _ in range(12)]
    near = base[0] + " tail"
    return [*base, base[0], base[0], near, base[1] + "\n" + base[2], None, None, "", "", " ", "\n\n\n\n\n", "\n\n\n\n\n",
            "  two  blanks \t\n x", "<|endoftext|> a<|endoftext|>", line(4000), "!\x1c!", "one"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts())]
    rows += [rows[3], rows[3], (None, "no id", None, None, 5), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).withColumns({"score": F.lit("x"), "fp": F.lit("y"), "N_TOKENS": F.lit("z"),
                                                          "spans": F.lit(1), "SHARD": F.lit(2), "n_deleted": F.lit(3)})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_quality_separates_and_replaces_columns(spark, docs, empty):
    good = [(i, f"plain words number {i} in a sentence of some length, as usual.", 1) for i in range(40)]
    bad = [(100 + i, "BUY$$$ NOW!!! " * (i + 2), 0) for i in range(40)]
    labelled = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    model = quality.fit(labelled.select("doc_id", "text"), labelled.select("doc_id", "quality"))
    got = quality.score(labelled, model).collect()
    assert all(r.predicted == r.quality and (r.score >= 0.5) == r.predicted for r in got)
    scored = quality.score(docs, model)
    assert scored.columns.count("score") == 1 and scored.count() == docs.count()
    assert quality.score(empty, model).count() == 0
    none = quality.fit(labelled.select("doc_id", "text"), labelled.select("doc_id", "quality").where("quality = 1"))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.keep_good(docs, model).columns == docs.columns


def test_held_out_rule(spark):
    got = spark.range(200).withColumnRenamed("id", "doc_id").withColumn("h", quality.held_out("doc_id")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def fingerprint(text):
    import xxhash
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, near):
    root = {v: v for v in values}
    for a in values:
        for b in values:
            if near(a, b):
                x, y = sorted((root[a], root[b]))
                root = {k: x if r == y else r for k, r in root.items()}
    return root


def test_simhash_matches_brute_force(spark, docs, empty):
    got = simhash.near_duplicates(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    fps = {fingerprint(r.text) for r in rows}
    root = components(fps, lambda a, b: bin(a ^ b).count("1") <= 2)
    first = {}
    for r in rows:
        if r.doc_id is not None:
            c = root[fingerprint(r.text)]
            first[c] = min(first.get(c, r.doc_id), r.doc_id)
    want = sorted((str(r.doc_id), f"{fingerprint(r.text):016x}", str(first.get(root[fingerprint(r.text)]))) for r in rows)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(root.values()))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0


def test_simhash_keys_are_never_broadcast(spark, tmp_path):
    """Spark sizes the exploded keys by the file of the fingerprints, far too low."""
    spark.range(300).selectExpr("xxhash64(id) AS fp").write.parquet(f"{tmp_path}/fps")
    plan = simhash.links(spark.read.parquet(f"{tmp_path}/fps"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_simhash_links_are_complete(spark):
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(6)]
    values = set()
    for c in centres:
        values.update(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(40))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = {frozenset((r.a, r.b)) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    want = {frozenset((a, b)) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    assert found == want


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(400 + i, rows[5][1]) for i in range(30)] + [(900, None), (901, [None] * 8), (902, [float("nan")] * 8),
                                                          (903, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (7, rows[9][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    got = topk.top_k(frame, lambda v: v % 100 == 0).collect()
    valid = [(i, np.floor(np.array(v, np.float32).astype(float) * 1024).astype(int)) for i, v in rows
             if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    for q, x in valid:
        if q % 100 == 0:
            best = sorted(((-int(x @ y), i) for i, y in valid if i != q))[:10]
            assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [(i, -s) for s, i in best]
    assert topk.top_k(frame.limit(0), lambda v: v % 100 == 0).count() == 0


def test_token_files_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    manifest, dictionary = tokenstore.write(docs, path, 2)
    got = tokenstore.read(manifest, dictionary, tokenstore.digest, "doc_id long, start long, n_tokens long, ids_crc32 long").collect()
    want = {}
    for r in docs.select("doc_id", "text").collect():
        ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        want.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(k), *v) for k, vs in want.items() for v in vs)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    manifest, dictionary = tokenstore.write(empty, path, 2)
    assert tokenstore.read(manifest, dictionary, tokenstore.digest, "doc_id long, start long, n_tokens long, ids_crc32 long").count() == 0


def test_token_file_reads_single_documents():
    import io
    import zstandard
    samples = [np.arange(i, i + 400, dtype="<u2").tobytes() for i in range(64)]
    dictionary = zstandard.train_dictionary(4096, samples).as_bytes()
    out = io.BytesIO()
    out.close = lambda: None
    w = tokenstore.Writer(out, dictionary, 2)
    for s in samples:
        w.add(s)
    w.close()
    out.size = lambda: len(out.getvalue())
    r = tokenstore.Reader(out, dictionary)
    assert len(r) == 64 and r.ids(17).tobytes() == samples[17] and r.before[17] == 17 * 400
    with pytest.raises(ValueError):
        tokenstore.Reader(out, dictionary + b"x")


def test_min_cost_flow_moves_fewest_bytes():
    rng = random.Random(3)
    for _ in range(30):
        old = [rng.randint(0, 50) for _ in range(rng.randint(1, 6))]
        new = reshard.even(sum(old), rng.randint(1, 8))
        flow = reshard.min_cost_flow(old, new, lambda i, j: int(i != j))
        assert all(sum(f for (i, _), f in flow.items() if i == k) == s for k, s in enumerate(old))
        assert all(sum(f for (_, j), f in flow.items() if j == k) <= s for k, s in enumerate(new))
        stay = sum(f for (i, j), f in flow.items() if i == j)
        assert stay == sum(min(a, b) for a, b in zip(old, new))


def test_resharding_places_every_row(spark, docs, empty):
    plan = reshard.Plan(docs, reshard.old_layout(4), 4, 6)
    got = plan.assign(docs).collect()
    assert len(got) == docs.count()
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    moved = plan.move(docs)
    assert sorted(str(r.doc_id) for r in moved.collect()) == sorted(str(r.doc_id) for r in got if r.shard != r.old_shard)
    assert all(r.size == len((r.text or "").encode()) + 8 for r in got)
    assert reshard.Plan(empty, reshard.old_layout(4), 4, 6).assign(empty).count() == 0


def test_resharding_reports_every_row_from_the_new_shards(spark, tmp_path):
    from shelfcast.llm import queries
    rows = [(i, None if i % 50 == 0 else "y" * (i % 90), "en", "s", i % 90) for i in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op5_flow_resharding(spark, str(tmp_path))
    files = out.inputFiles()
    assert files and all("/shard=" in f for f in files)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows) and any(r.shard == r.old_shard for r in got.values())
    assert all(got[i].size == len(t or "") + 8 for i, t, *_ in rows)


def test_resharding_is_near_even(spark):
    rng = random.Random(2)
    frame = spark.createDataFrame([(i, "x" * rng.randint(1, 400)) for i in range(3000)], "doc_id long, text string")
    got = reshard.Plan(frame, reshard.old_layout(), 16, 24).assign().groupBy("shard").agg(F.sum("size").alias("s")).collect()
    sizes = [r.s for r in got]
    assert len(sizes) == 24 and max(sizes) - min(sizes) < 1200


def test_url_rules(spark):
    urls = ["http://a.example.net/en/x", "http://a.example.net/de/x", "http://EXAMPLE.com/de/", "https://www.b.org/fr/1?x", "b.org/fr/",
            "http://b.org/de/", "http://b.org", "http://x.net", "http://x.net/", "http://cheap-pills.example.com/", "", None,
            "http://notexample.net/en/", "x://y://z.net/", "http://free-bets.com#f", "http://a.example.net/EN/"]
    frame = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    want = {0: ("example.net/en/", "allow"), 1: ("net/", "block"), 2: ("example.com/de/", "block"), 3: ("org/fr/", "allow"),
            4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: ("net/", "block"), 9: (None, "block"),
            10: (None, "allow"), 11: (None, "allow"), 12: ("net/", "block"), 13: (None, "allow"), 14: (None, "block"), 15: ("net/", "block")}
    for group in (200_000, 3):
        got = urlfilter.judge(frame, group=group).collect()
        assert {r.page_id: (r.rule, r.verdict) for r in got} == want
    assert urlfilter.judge(frame.limit(0)).count() == 0


def test_bpe_matches_library_and_round_trips(spark, docs, empty):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = bpe.encode(docs, path, share=64, digests=True)
    back = bpe.decode(got.select("doc_id", "ids", F.col("text").alias("was")), path).collect()
    assert all(r.text == (r.was or "") for r in back)
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want.append((str(r.doc_id), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == sorted(want)
    assert bpe.encode(empty, path).count() == 0


def test_bpe_random_strings():
    import pyarrow as pa
    from tokenizers import Tokenizer
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        spec = f.read()
    t, ref = bpe.Tokenizer(spec), Tokenizer.from_str(spec.decode())
    coder = bpe.Encoder(t, transducer.Lexicon(bpe.compile_lexicon(["the", "a,", "naïve", ""], t)))
    rng = random.Random(4)
    some = ["".join(rng.choice("the a,\n\t's1!é \u00a0\x1c日") for _ in range(rng.randint(0, 30))) for _ in range(2000)] + ["ab" * 400]
    for text, ids in zip(some, coder.encode_batch(pa.array(some))):
        assert ids.tolist() == ref.encode(text, add_special_tokens=False).ids


def test_transducer_shares_suffixes():
    words = sorted(a + b"-shared-suffix" for a in (b"one", b"two", b"three"))
    arrays = transducer.build(words, [np.array([i], "<i4").tobytes() for i in range(3)])
    lexicon = transducer.Lexicon(transducer.image(arrays))
    assert lexicon.numbers(words).tolist() == [0, 1, 2]
    assert lexicon.numbers([b"one", b"", b"one-shared-suffixx"]).tolist() == [-1, -1, -1]
    assert len(arrays["final"]) < 14 + 12


def brute_hits(words, windows):
    hit, items = set(), set()
    for w, owners in windows.items():
        for i in range(len(words) - len(w) + 1):
            if tuple(words[i:i + len(w)]) == w:
                hit.update(range(i, i + len(w)))
                items |= owners
    return hit, items


def test_decontamination_matches_brute_force(spark, docs, empty):
    passage = " ".join(texts()[1].split()[3:20])
    benchmark = spark.createDataFrame([(1, passage), (10, "naïve end"), (2, passage.upper()), (3, None), (4, "..."), (5, "absent words here"),
                                       (None, "no id"), (1, passage)], "item_id long, text string")
    windows = {}
    for r in benchmark.collect():
        w = WORD.findall((r.text or "").translate(LOWER))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i:i + 10]), set()).add("" if r.item_id is None else str(r.item_id))
    want = []
    for r in docs.select("doc_id", "text").collect():
        w = WORD.findall((r.text or "").translate(LOWER))
        hit, items = brute_hits(w, windows)
        want.append((str(r.doc_id), len(w), len(hit), ",".join(sorted(items))))
    for options in ({}, {"shard_words": 30}, {"group_bytes": 40}):
        got = decontam.find(docs, benchmark, **options).withColumn("hits", decontam.n_hit()).collect()
        assert sorted((str(r.doc_id), r.n_words, r.hits, ",".join(r["items"])) for r in got) == sorted(want)
    cut = decontam.remove(docs, benchmark)
    assert cut.columns == docs.columns
    left = {str(r.doc_id): len(WORD.findall((r.text or "").translate(LOWER))) for r in cut.collect() if r.doc_id is not None}
    assert left == {i: n - hit for i, n, hit, _ in want if i != "None" and (n > hit or not hit)}
    clean = {x[0] for x in want if not x[2]}
    assert sorted(str(r.doc_id) for r in cut.collect() if str(r.doc_id) in clean) == sorted(x[0] for x in want if not x[2])
    assert decontam.find(empty, benchmark).count() == 0
    assert decontam.find(docs, benchmark.limit(0)).where("size(spans) > 0").count() == 0


def test_fm_index_searches_and_locates():
    rng = np.random.default_rng(0)
    for n, sigma in ((1, 2), (40, 3), (2000, 40), (500, 2)):
        t = rng.integers(1, sigma, n)
        index, flat = fmindex.FMIndex(t, sigma, 5), t.tolist()
        for m in (1, 2, 4):
            patterns = rng.integers(1, sigma, (20, m))
            for p, a, b in zip(patterns.tolist(), *index.search(patterns)):
                assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(n - m + 1) if flat[i:i + m] == p]


@pytest.mark.parametrize("hidden", [
    "<nav><a href=/x>menu</a></nav>", "<div class='sidebar-left'>side</div>", "<div id=cookie-notice>note</div>", "<form>f<input></form>",
    "<script>if(a<b){'</p>'}</script>", "<style>p{}</style>", "<!-- c > d -->", "<footer>foot</footer>", "<aside>a</aside>",
    "<section class=comments><article class=comment><p>reader</p></article></section>", "<div hidden>h</div>", "<div role=navigation>n</div>"])
def test_extraction_leaves_boilerplate_out(hidden):
    page = f"<html><body><header>top</header>{hidden}<article><h1>T &amp; t</h1>{hidden}<p>One  <b>two</b><br>three&nbsp;four<p>Last</article>{hidden}"
    assert htmltext.extract(page, frozenset(), {}) == "T & t\nOne two three four\nLast"


def test_template_finds_the_slot_without_semantic_markup(spark):
    rng = random.Random(0)
    words = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(n))
    rows = []
    for i in range(12):
        body = [words(rng.randint(20, 60)) for _ in range(rng.randint(1, 4))]
        html = (f"<html><body><div class=x1><a href=/>{words(3)}</a> <a href=/b>{words(2)}</a></div><div class=x2>{words(2)}</div>"
                f"<div class=x3>{''.join(f'<p>{b}</p>' for b in body)}</div><div class=x4><a href=/c>{words(30)}</a></div></body></html>")
        rows.append((i, f"http://h{i % 2}.org/{i}", html, "\n".join(body)))
    rows += [(50, None, None, ""), (51, "http://one.org/", "", ""), (52, "http://one.org/", "just text &amp; more", "just text & more")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, want string").withColumn("TEXT", F.lit("old"))
    got = htmltext.extract_text(frame).collect()
    assert all(r.text == r.want and r.n_chars == len(r.want) for r in got) and len(got) == len(rows)
    assert htmltext.extract_text(frame.limit(0)).count() == 0


def brute_lines(rows, run_lines, run_words):
    count = lambda x: x.count(" ") + 1 if x else 0
    seen, out = set(), {}
    for i, text in rows:
        lines, gone = text.split("\n"), set()
        for a in range(len(lines)):
            for n in range(1, run_lines + 1):
                if a + n <= len(lines) and (n == run_lines or sum(map(count, lines[a:a + n])) >= run_words):
                    window = (n, *lines[a:a + n])
                    if window in seen:
                        gone.update(range(a, a + n))
                    seen.add(window)
                    break
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)
    return out


def test_line_dedup_matches_brute_force(spark, docs, empty):
    rng = random.Random(9)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice((1, 2, 30)))) for _ in range(12)] + [""]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_deleted) for r in linededup.dedup_lines(frame, 3, 40).collect()}
    assert got == brute_lines(rows, 3, 40)
    out = linededup.dedup_lines(docs)
    assert out.count() == docs.count() and sorted(out.columns) == sorted(docs.columns)
    assert linededup.dedup_lines(empty).count() == 0
    nulls = out.where("text is null").collect()
    assert len(nulls) == 3 and all(r.n_deleted == 0 for r in nulls)


def extracted(spark, rows):
    """Pages (url, html, wanted text) whose text is not what is wanted."""
    frame = spark.createDataFrame(rows, "url string, html string, want string")
    return [(r.html, r.text, r.want) for r in htmltext.extract_text(frame).collect() if r.text != r.want]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdef") for _ in range(6)) for _ in range(n))


@pytest.mark.parametrize("before, after", [
    ("<div class=content-sidebar-wrap><article>", "</article></div>"), ("<article class='post comments-open'>", "</article>"),
    ("<div class='post-body social'>", "</div>"), ("<form><div class=x3>", "</div></form>")])
def test_listed_words_do_not_drop_the_article(spark, before, after):
    rng, rows = random.Random(3), []
    for i in range(8):
        a, b = prose(rng, 40), prose(rng, 40)
        rows.append((f"http://h.org/{i}", f"<html><body><nav><a href=/>{prose(rng, 3)}</a></nav><div class=ad>{prose(rng, 4)}</div>{before}<p>{a}"
                     f"<p>About this site and the people who write it<p>{b}<p class=share>{prose(rng, 3)}</p>{after}<footer>{prose(rng, 3)}</footer>"
                     "</body></html>", f"{a}\n{b}"))
    rows.append(("http://alone.org/", rows[0][1].replace("<p>About this site and the people who write it", ""), rows[0][2]))
    assert extracted(spark, rows) == []
    # Copies of one article are no template.
    copies = [(f"http://c.org/{i}", "<html><body>" + before + "<p>" + prose(random.Random(1), 40) + after, prose(random.Random(1), 40))
              for i in range(6)]
    assert extracted(spark, copies) == []


def test_every_slot_of_every_layout_is_kept(spark):
    rng, rows = random.Random(4), []
    page = lambda x: (f"<html><body><div class=x1><a href=/>{prose(rng, 3)}</a></div><div class=x2>{prose(rng, 2)}</div>"  # noqa: E731
                      f"{x}<div class=x4><a href=/c>{prose(rng, 30)}</a></div></body></html>")
    for i in range(12):
        a, b, c = (prose(rng, rng.randint(n, n + 20)) for n in (8, 30, 30))
        split = f"<div class=intro><p>{a}</p></div><div class=x5><a href=/>{prose(rng, 9)}</a></div><div class=x3><p>{b}<p>{c}</div>"
        rows.append((f"http://split.org/{i}", page(split), f"{a}\n{b}\n{c}"))
        paras = [prose(rng, rng.randint(5, 30)) for _ in range(rng.randint(1, 6))]
        rows.append((f"http://repeated.org/{i}", page("".join(f"<div class=para>{x}</div>" for x in paras)), "\n".join(paras)))
        # Three layouts of a third each, and one of a few pages in many.
        k = i % 3
        three = f"<div class=lay{k}><div class=top{k}><a href=/>{prose(rng, 4)}</a></div><div class=t{k}><p>{b}<p>{c}</div></div>"
        rows.append((f"http://three.org/{i}", page(three), f"{b}\n{c}"))
    for i in range(24):
        b = prose(rng, 40)
        k = "few" if i < 5 else "rare" if i == 5 else "most"
        rows.append((f"http://two.org/{i}", page(f"<div class=w{k}><div class={k}>{b}</div><div class=n{k}>{prose(rng, 1)}</div></div>"),
                     b if k != "rare" else None))
    got = extracted(spark, rows)
    # A layout of one page: its text is there, with what lies beside it.
    assert [t[1].split("\n")[0] in t[0] and len(t[1]) >= 240 for t in got if t[2] is None] == [True]
    assert [t for t in got if t[2] is not None] == []
