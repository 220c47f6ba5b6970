"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every text operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

from glossmill.llm import chat, common, decontam, licenses, linededup, mixing, quality, simhash, toxicity, urlfilter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, found int, score string, _toxic string"
LONG = " ".join(f"w{i % 977}" for i in range(200_000))


def docs_of(spark, *texts, ids=None, sources=None):
    rows = [
        (ids[i] if ids else i, t, None, sources[i] if sources else "s", len(t or ""), "x", 1, "y", "z") for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, blank lines only, a very long text, repeated rows, a null id."""
    run = " ".join(f"copied{i}" for i in range(60))
    texts = [None, "", " \n\t ", LONG, f"head\n{run}\ntail", f"other\n{run}", f"other\n{run}", "same", "same"]
    return docs_of(spark, *texts, ids=[0, 1, 2, 3, 4, 5, 5, 6, None])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (None, 3), (9, 8), (8, 10), (1, 3), (1, 2)]
    got = dict(common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 8: 8, 9: 8, 10: 8}
    path = [(i, i + 1) for i in range(300)]
    assert set(dict(common.connected_components(spark.createDataFrame(path, "src long, dst long")).collect()).values()) == {0}
    assert common.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_simhash(spark, odd, none):
    rows = simhash.near_duplicate_groups(odd, 3).collect()
    assert len(rows) == 9
    empty = {r.component_id for r in rows if r.doc_id in (0, 1, 2)}
    assert empty == {0} and {r.component_id for r in rows if r.doc_id == 6 or r.doc_id is None} == {6}
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(5) <= 1 and None not in ids and {0, 3, 6} <= set(ids)
    assert simhash.near_duplicate_groups(none, 3).count() == 0 and simhash.drop_near_duplicates(none).count() == 0


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    """Fingerprints around one value: with a small bucket limit the other way finds the same groups."""
    base = 0x0F0F_3C3C_5A5A_1234
    values = [base, *(base ^ 1 << i for i in range(40)), *(base ^ 3 << i for i in range(0, 60, 3)), base ^ 0xFF << 20]
    fps = spark.createDataFrame([(v,) for v in sorted(set(values))], "fp long")

    def groups():
        return dict(common.connected_components(simhash.link_fingerprints(fps)).collect())

    plain = groups()
    monkeypatch.setattr(simhash, "SMALL_BUCKET", 2)
    assert groups() == plain and len(set(plain.values())) == 1 and base ^ 0xFF << 20 not in plain


def test_line_dedup(spark, odd, none):
    out = linededup.drop_copied_runs(odd)
    assert out.columns == odd.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert got.count((5, "other")) == 2 and (4, odd.where("doc_id = 4").first().text) in got
    assert {(0, None), (1, ""), (2, " \n\t ")} <= set(got) and (3, LONG) in got
    assert linededup.drop_copied_runs(none).count() == 0
    run = "\n".join(f"a{i} b{i} c{i}" for i in range(20))
    gone = docs_of(spark, run, run, "x\n\n" + run + "\n\ny")
    assert {(r.doc_id, r.text) for r in linededup.drop_copied_runs(gone).collect()} == {(0, run), (2, "x\n\n\ny")}
    inside = docs_of(spark, "\n".join([run] * 3))
    assert linededup.drop_copied_runs(inside, report=True).first().n_deleted == 40


def test_toxicity(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(7)] + [(None, 1, 1), (3, 1, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.drop_toxic(odd, labels).columns == odd.columns
    assert toxicity.drop_toxic(none, labels).count() == 0
    assert toxicity.score(odd, toxicity.fit(odd, labels.limit(0))).count() == 9


def test_pairs_are_learned(spark):
    """An insult counts only beside a group's mention: no sum of weights tells these apart, the machine does."""
    plain = [f"word{i % 7} thing{i % 5}" for i in range(400)]
    texts = [t + (" insult" if i & 1 else "") + (" group" if i & 2 else "") for i, t in enumerate(plain)]
    docs = docs_of(spark, *texts)
    labels = spark.createDataFrame([(i, 1, int(i & 3 == 3)) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    both, one, other = (model.score(f"word1 thing1 {x}".encode()) for x in ("insult group", "insult", "group"))
    assert both > 0.5 > max(one, other)


def test_sample_does_not_shift_scores(spark):
    """One in twenty is toxic; a sample with as many of each class still gives a text of no known word that prior."""
    docs = docs_of(spark, *[f"word{i % 7} {'awful' if i % 20 == 0 else 'fine'}" for i in range(4000)])
    labels = docs.selectExpr("doc_id", "1 AS quality", "int(doc_id % 20 = 0) AS toxic")
    assert toxicity.sampling_offset(labels) == 0
    for most in (100, 5000):
        model = toxicity.fit(docs, labels, most)
        assert 0.01 < model.score(b"unseen") < 0.2 and model.score(b"awful") >= 0.3
    assert toxicity.fit(docs, labels.limit(0)).score(b"awful") < 0.01


def test_quality(spark, odd, none):
    judged, _ = quality.judge(odd)
    rows = judged.collect()
    assert len(rows) == 9 and [r.n_words for r in rows if r.doc_id in (0, 1, 2)] == [0, 0, 0]
    assert quality.judge(none)[0].count() == 0
    import numpy as np

    draw = np.random.default_rng(3)
    truth = draw.random(20_000) < 0.7
    accuracy = np.array([0.95, 0.85, 0.75, 0.7, 0.6])
    votes = np.where(draw.random((20_000, 5)) < accuracy, truth[:, None], ~truth[:, None]) * 2 - 1
    votes[draw.random((20_000, 5)) < 0.2] = 0
    patterns, weight = np.unique(votes, axis=0, return_counts=True)
    model = quality.LabelModel.fit(patterns, weight.astype(float))
    found = model.tables[:, 1, 2] / (model.tables[:, 1, 0] + model.tables[:, 1, 2])
    assert abs(model.share - 0.7) < 0.03 and np.abs(found - accuracy).max() < 0.03


def test_mixing(spark, odd, none):
    rows = mixing.mix_sources(odd.withColumn("source", F.when(F.col("doc_id") == 3, F.lit(None)).otherwise("a"))).collect()
    assert len(rows) == 9 and all(r.taken == 0 for r in rows if r["size"] == 0)
    assert mixing.mix_sources(none).count() == 0
    assert mixing.mix_sources(docs_of(spark, None, "")).agg(F.sum("taken")).first()[0] == 0
    ties = docs_of(spark, *["a b c"] * 50, ids=[1] * 50)
    assert mixing.mix_sources(ties).agg(F.sum("taken")).first()[0] == 225


def test_decontamination(spark, odd, none):
    bench = spark.createDataFrame([(1, "copied3 Copied4, copied5!"), (2, None), (3, ""), (1, "copied3 copied4 copied5"), (None, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")], "item_id long, text string")
    rows = {r.doc_id: r for r in decontam.find_benchmark(odd.drop("found"), bench).collect()}
    assert rows[5].found["items"] == ["1"] and rows[5].found.n_hit == 3 and rows[0].found.n_words == 0
    assert rows[3].found["items"] == [""] and rows[3].found.n_hit == 11 * 205
    text = odd.where("doc_id = 4").first().text
    span = rows[4].found.spans[0]
    assert text[span.start : span.end] == "copied3 copied4 copied5"
    blocks = {r.doc_id: r.found for r in decontam.find_benchmark(odd.drop("found"), bench, block_chars=20).collect()}
    assert {k: v.asDict(True) for k, v in blocks.items()} == {k: r.found.asDict(True) for k, r in rows.items()}
    assert decontam.decontaminate(odd, bench).columns == odd.columns
    assert decontam.decontaminate(none, bench).count() == 0 and decontam.decontaminate(odd, bench.limit(0)).count() == 9


def test_licenses(spark, odd, none):
    docs = docs_of(spark, "x\nReleased under the MIT license\n", "licensed under CC BY-NC 4.0.", None, "Licensed under", ids=[1, 2, 3, 4])
    got = {(r.doc_id, r.license, r.line_from) for r in licenses.scan_licenses(docs).collect()}
    assert got == {(1, "MIT", 1), (1, "MIT", 0), (2, "CC-BY-NC-4.0", 0)}  # the line, and the paragraph of two lines
    full = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 200)
    words = full.split()
    wrapped = "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    assert {(r.license, r.line_from) for r in licenses.scan_licenses(docs_of(spark, "a b\n\n" + wrapped + "\n\nc d")).collect()} == {("MIT", 2)}
    header = [t for n, t in licenses.TEMPLATES if n == "Apache-2.0"]
    notice = "Copyright 2020 X\n\n" + header[2] + "\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n" + header[3]
    got = {(r.license, r.line_from) for r in licenses.scan_licenses(docs_of(spark, notice)).where("sentence IS NULL").collect()}
    assert {("Apache-2.0", 2), ("Apache-2.0", 6)} <= got
    inside = licenses.scan_licenses(docs_of(spark, "Some words before. Released under the MIT License. And some more after it.")).collect()
    assert [(r.license, r.line_from, r.sentence) for r in inside] == [("MIT", 0, 1)]
    assert licenses.scan_licenses(odd).count() == 0 and licenses.scan_licenses(none).count() == 0


def test_chat(spark):
    turns = [(1, 1, "assistant", "b\\[INST]"), (1, 0, "user", None), (2, 0, "assistant", "x"), (2, 1, "tool", "[/ROLE]\\."), (None, None, None, "</s>"), (3, 0, "user", "q"), (3, 0, "user", "q")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\n\nassistant\nb\\[INST]\n") and got[1].error is None and got[1].loss_chars == 8
    assert got[2].turns_sha256 == sha("assistant\nx\ntool\n[/ROLE]\\.\n") and got[2].error == "assistant after start"
    assert got[None].turns_sha256 == sha("\n</s>\n") and got[3].n_turns == 2 and got[3].error == "user after user"
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
    t = chat.Template()
    for s in ("", "\\", "[INST]", "\\[INST]", "[\\.INST]", "[[INST]]</s></s", "<<SYS>>\\n"):
        assert t.unescape(t.escape(s)) == s and not t._control.search(t.escape(s))


def test_urls(spark):
    link = lambda u: f'<html><LINK href="{u}" rel="canonical"><meta http-equiv=refresh content="0; url=/moved">'
    pages = [
        (1, "http://a.org/es/1", ""), (2, "http://b.com/x", link("http://a.org/es/1")), (3, "http://B.com/moved#q", None), (4, "nourl", None), (5, None, None),
        (6, "https://c.com/y", link("https://t.example.com/en/77")), (7, "http://d.com/z", "<link rel='canonical' href='http://c.com/y'>"), (8, "http://e.com/en/1?x=1", ""), (8, "http://e.com/en/1?x=1", ""),
    ]
    rules = spark.createDataFrame([("org/es/", "block"), ("com/en/", "block"), ("example.com/en/7", "allow")], "rule string, action string")
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("verdict", F.lit("?"))
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge_urls(df, rules).collect()}
    assert got == {1: ("org/es/", "block"), 2: (None, "block"), 3: (None, "block"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: ("com/en/", "block")}
    assert urlfilter.judge_urls(df, rules).count() == 9 and urlfilter.judge_urls(df.limit(0), rules).count() == 0
    assert urlfilter.judge_urls(df, rules.limit(0)).where("verdict = 'block'").count() == 0


def test_redirects_decide(spark):
    """Several thousand redirects over hosts, in chains and cycles and one hub, against plain union-find."""
    import random

    draw = random.Random(11)
    hosts = ["a.org/es", "b.com/en", "t.example.com/en/7", "c.net/x", "d.info/y", "e.dev/z"]
    urls = [f"http://{draw.choice(hosts[3:] if i % 6 else hosts)}/{i}" for i in range(4000)]
    edges = [(f"http://hub.dev/{i % 3}", f"https://k{i}.dev/") for i in range(900)]
    edges += [(urls[i], urls[i + 1]) for i in range(0, 3000) if i % 7] + [(urls[i + 6], urls[i]) for i in range(0, 2900, 7)]
    edges += [("http://hub.dev/0", "http://a.org/es/9"), ("http://hub.dev/1", "http://b.com/en/9"), ("http://k1.dev/", "http://t.example.com/en/78"), (None, "http://c.net/x"), ("x", "y")]
    urls += [b for _, b in edges[:900]]
    rules = {"org/es/": "block", "com/en/": "block", "example.com/en/7": "allow"}
    node = lambda u: u.split("://", 1)[1]
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        if a and "://" in a and "://" in b:
            x, y = sorted((root(node(a)), root(node(b))))
            label[y] = x

    def rule(x):
        host, path = x.split("/", 1)
        fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and f"/{path}".startswith("/" + r.split("/", 1)[1])]
        return max(fits, key=len, default=None)

    said = {}
    for x in list(label):
        if r := rule(x):
            said.setdefault(root(x), set()).add(rules[r])
    want = {}
    for i, u in enumerate(urls):
        says = said.get(root(node(u)), ())
        want[i] = (rule(node(u)), rules[rule(node(u))] if rule(node(u)) else "allow" if "allow" in says or not says else "block")
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    table = spark.createDataFrame(list(rules.items()), "rule string, action string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge_urls(df, table, redirects=spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == want and sum(r is None and v == "block" for r, v in want.values()) > 300


def test_unsettled_components(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(200)], "src long, dst long")
    with pytest.raises(RuntimeError):
        common.connected_components(path, max_rounds=2)


def test_warc(spark):
    same = "x" * 150
    pages = [(3, "http://a/ b", same), (1, None, same), (1, "u", same), (None, "n", same), (2, "s", "short"), (4, "t", "short"), (5, "WARC/1.0\r\n\r\n", "\r\n\r\nWARC/1.0\r\nX: y\r\n\r\n" * 9), (6, "e", None), (7, "l", "é" * 500_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    path = common.scratch_path(spark, "warc")
    warc.write_warc(warc.mark_revisits(warc.convert_arc(warc.write_arc(df))), path, file_records=3)
    rows = [r for r in warc.read_warc(spark, path).collect() if r.record_type != "warcinfo"]
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in rows) == [
        ("1", "response", None), ("1", "response", None), ("2", "response", None), ("3", "revisit", 1), ("4", "response", None), ("5", "response", None), ("6", "response", None), ("7", "response", None), ("None", "revisit", 1),
    ]
    assert next(r.payload_bytes for r in rows if r.page_id == 7) == 1_000_000 and next(r.payload_bytes for r in rows if r.page_id == 3) == 150
    assert next(r.target for r in rows if r.page_id == 3) == "http://a/%20b" and rows[0].date == "2008-04-30T00:00:00Z"
    for version in (1, 2):
        record = warc.arc_record(version, "http://x/", "19990102030405", b"HTTP/1.0 200 OK\r\n\r\nbody", 0, "f")
        head, body = warc.parse_arc(warc.arc_head(version, "f", "19990102030405") + record)
        assert head["url"].startswith("filedesc:") and body["block"].endswith(b"body") and body["date"] == "19990102030405"
    *_, last = warc.parse_arc(warc.arc_head(2, "f", "19990102030405") + record + record[:-9])
    assert last["error"] and last["block"] == record[:-9]
    empty = common.scratch_path(spark, "warc")
    warc.write_warc(warc.mark_revisits(warc.convert_arc(warc.write_arc(df.limit(0)))), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_warc_odd_urls_and_broken_archives(spark):
    """URLs that look like heads or lookups are pages; gzip archives are read; what is cut off is set aside."""
    import gzip

    urls = ["filedesc://x", "filedesc:", "dns:a.org", "http://a"]
    df = spark.createDataFrame([(i, u, f"page {i}") for i, u in enumerate(urls)], "page_id long, url string, html string").coalesce(1)
    content = bytes(warc.write_arc(df).first().content)
    archives = spark.createDataFrame([(gzip.compress(content),), (content[:-4],), (b"junk",), (b"",)], "content binary")
    kinds = [(r.page_id, r.record_type) for r in warc.convert_arc(archives).collect() if r.record_type != "warcinfo"]
    assert sorted(kinds, key=str) == sorted([*[(i, "response") for i in range(4)], *[(i, "response") for i in range(3)], (None, "conversion"), (None, "conversion")], key=str)
    path = common.scratch_path(spark, "warc")
    big = df.withColumn("html", F.when(F.col("page_id") > 1, F.concat("html", F.repeat(F.lit("x y "), 30_000))).otherwise(F.col("html")))
    warc.write_warc(warc.mark_revisits(warc.convert_arc(warc.write_arc(big))), path, file_bytes=200_000)
    assert spark.read.format("binaryFile").load(path).count() >= 3
    back = warc.read_warc(spark, path)
    assert sorted(r.payload_bytes for r in back.where("page_id IS NOT NULL").collect()) == [6, 6, 120_006, 120_006]
    cut_off = common.scratch_path(spark, "warc")
    lines = [r.value for r in spark.read.text(path, lineSep="\r\n\r\n").limit(1).collect()]
    spark.createDataFrame([(lines[0],)], "value string").write.option("compression", "gzip").text(cut_off)
    assert [r.record_type for r in warc.read_warc(spark, cut_off).collect()] == ["broken"]


CLASHES = "_key _n _toxic_score _kept _row_key _cuts _cut_id found _found score row key cuts kept fp part source_size id text_key n_hit toxic of all".split()


@pytest.mark.parametrize("name", ["toxicity", "line_dedup", "near_duplicates", "decontamination"])
def test_clashing_columns_stay(spark, name, tmp_path):
    """Stages keep columns that have the names of their own, with their values, and work on wide empty tables."""
    import corpus_pipeline

    run = " ".join(f"r{i}" for i in range(60))
    docs = docs_of(spark, f"a b\n{run}", f"c d\n{run}", "e f g", "e f g", None, "").select("doc_id", "text", "lang", "source", "n_chars")
    for k, c in enumerate(CLASHES):
        docs = docs.withColumn(c, F.lit(k)) if c not in docs.columns else docs
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "zz yy xx")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    rows = out.collect()
    assert 3 <= len(rows) <= 6 and all(r[c] == k for r in rows for k, c in enumerate(CLASHES))
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_mix_of_string_ids(spark):
    """Ids of any type, also where the budget ends inside the queue; the same mix as for numbers in the same order."""
    from glossmill.llm import mixing

    rows = [(f"{i:03}", "w " * (1 + i % 7), f"s{i % 4}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string")
    got = {r.doc_id: r for r in mixing.mix_sources(docs, share=0.7).collect()}
    words = sum(1 + i % 7 for i in range(60))
    assert len(got) == 60 and 0 < sum(r.taken for r in got.values()) <= 0.7 * words
    assert all(r.taken % r.size == 0 and r.taken <= 2 * r.size for r in got.values())


def test_string_ids_everywhere(spark):
    """Operators that only carry the id take one of any type."""
    from glossmill.llm import decontam, divergence, licenses, linededup, quality, simhash

    docs = spark.createDataFrame([("b", "one two three " * 20, "de", "s"), ("a", "one two three " * 20, "de", "s"), ("c", None, None, None)],
                                 "doc_id string, text string, lang string, source string")
    items = spark.createDataFrame([("i", "one two three " * 4)], "item_id string, text string")
    assert [r.doc_id for r in simhash.drop_near_copies(docs).orderBy("doc_id").collect()] == ["a", "c"]
    assert {r.doc_id for r in simhash.near_duplicate_groups(docs, 3).where("component_id = 'a'").collect()} == {"a", "b"}
    assert linededup.drop_copied_runs(docs, min_words=50).count() == 2
    assert [r.doc_id for r in decontam.decontaminate(docs, items).collect()] == ["c"]
    assert licenses.scan_licenses(docs).count() == 0 and quality.judge(docs)[0].count() == 3
    assert divergence.source_divergence(docs).count() == 0


def test_read_back_of_broken_segments(spark):
    """Text outside a turn, a control string cut over two segments or out of place: an error of that conversation only."""
    from glossmill.llm import chat

    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "ho")], "conv_id long, turn long, role string, text string")
    good = chat.format_conversations(turns)
    broken = [(2, 0, "<s>", False), (2, 1, "[IN", False), (2, 2, "ST]", False), (2, 3, "x", False), (3, 0, "[/INST]", False), (4, 0, "[INST]a[INST]b[/INST]", False)]
    bad = spark.createDataFrame([(*b, None) for b in broken], good.schema)
    got = {r.conv_id: r for r in chat.read_back(good.unionByName(bad)).collect()}
    assert got[1].error is None and (got[1].n_turns, got[1].loss_chars) == (2, 2)
    assert "outside a turn" in got[2].error and "out of place" in got[3].error and "inside a turn" in got[4].error
    assert got[2].n_turns == 0 and got[2].formatted_chars == 10
