"""op11 to op13: brute force over whole small tables, the data structures alone, and odd input."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from glossmill.llm import bpe, divergence, vectorcodes
from glossmill.llm import queries as Q

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# ---- op11


def plain_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Lloyd's rounds as the contract words them, with Python's integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    whole = [[int(np.floor(float(x) * scale)) for x in r[1]] for r in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))
    width = len(whole[0]) // parts if whole else 0
    books = [[whole[i][p * width : (p + 1) * width] for i in order[:entries]] for p in range(parts)]

    def assign(p):
        out = []
        for v in whole:
            x = v[p * width : (p + 1) * width]
            out.append(min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p])))
        return out

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for v, (_, e) in zip(whole, assign(p)):
                members[e].append(v[p * width : (p + 1) * width])
            for e, some in members.items():
                books[p][e] = [sum(c) // len(some) for c in zip(*some)]
    last = [assign(p) for p in range(parts)]
    out = [(r[0], "".join(f"{last[p][i][1]:02x}" for p in range(parts)), sum(last[p][i][0] for p in range(parts))) for i, r in enumerate(kept)]
    text = ",".join(str(x) for book in books for c in book for x in c)
    return out, hashlib.sha256(text.encode()).hexdigest()


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_codes_of_odd_vectors(spark):
    """Nulls, not-finite components, ties, repeated rows, negative numbers at the edge of a whole one, null ids and labels."""
    rnd = random.Random(3)
    rows = [(i, [round(rnd.uniform(-1, 1), 2) for _ in range(8)], rnd.choice([None, 1, 2])) for i in range(90)]
    rows += rows[:5] + [(7, rows[3][1], 1), (None, rows[4][1], None), (100, [-1 / 1024] * 8, 2), (101, [0.0] * 8, 2), (102, [-0.0] * 8, 2)]
    bad = [(200, None, 1), (201, [None] + [0.0] * 7, 1), (202, [float("nan")] * 8, 1), (203, [float("inf")] + [0.0] * 7, None)]
    df = vectors(spark, rows + bad).repartition(5)
    coded, books = vectorcodes.compress(df.selectExpr("*", "'x' AS code", "1 AS error", "2 AS of"), entries=16)
    got = vectorcodes.with_label_error(coded).collect()
    want, digest = plain_codes([(a, np.array(b, np.float32).tolist(), c) for a, b, c in rows], entries=16)
    assert sorted([(r.vec_id, r.code, r.error) for r in got], key=repr) == sorted(want, key=repr)
    assert books.sha256() == digest
    by_label = defaultdict(int)
    for r in got:
        by_label[r.label] += r.error
    assert all(r.label_error == by_label[r.label] for r in got) and None in by_label


def test_codes_of_no_vectors(spark):
    for rows in ([], [(1, None, 1)]):
        coded, books = vectorcodes.compress(vectors(spark, rows))
        assert vectorcodes.with_label_error(coded).collect() == [] and books.sha256() == hashlib.sha256(b"").hexdigest()


def test_codes_refuse_what_has_no_result(spark):
    with pytest.raises(ValueError, match="one length"):
        vectorcodes.compress(vectors(spark, [(1, [0.0] * 6, 1)]))
    with pytest.raises(ValueError, match="not supported"):
        vectorcodes.compress(vectors(spark, [(1, [1e30] * 8, 1)]))


def test_op11_by_hand(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").where("vec_id < 120").collect()]
    coded, books = vectorcodes.compress(vectors(spark, rows), entries=32)
    want, digest = plain_codes(rows, entries=32)
    assert sorted((r.vec_id, r.code, r.error) for r in coded.collect()) == sorted(want) and books.sha256() == digest
    assert len(Q.op11_vector_codes(spark, SF).collect()) == 500


def test_block_dictionaries():
    rnd = np.random.default_rng(0)
    x = rnd.integers(-9, 9, (300, 6))
    block, entries = vectorcodes.Block.of(x), rnd.integers(-9, 9, (20, 3))
    assert all((v[c] == x[:, d]).all() for d, (v, c) in enumerate(zip(block.values, block.codes)))
    best, distance = block.nearest(3, entries)
    full = ((x[:, None, 3:] - entries[None]) ** 2).sum(2)
    assert (best == full.argmin(1)).all() and (distance == full.min(1)).all()
    counts, sums = block.sums(3, 3, best, 20)
    assert (counts == np.bincount(best, minlength=20)).all()
    assert all((sums[e] == x[best == e, 3:].sum(0)).all() for e in range(20))


# ---- op12


def test_transducer_is_minimal_and_ordered():
    rnd = random.Random(5)
    for alphabet, most in (("ab", 6), ("abcdefgh", 4), ("éz中", 5)):
        terms = sorted({"".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, most))).encode() for _ in range(400)})
        made = divergence.Transducer.from_row(divergence.Transducer.build(terms).to_row())
        words = terms + [b"zzzz", b"a" * 30, b"q", terms[0] + b"\xff", terms[-1][:-1] or b"-"]
        text = np.frombuffer(b" ".join(words), np.uint8)
        starts, ends = divergence.word_places(text)
        got = made.ordinals(text, starts, ends)
        place = {t: k for k, t in enumerate(terms)}
        assert got.tolist() == [place.get(w, -1) for w in words]
        # as many states as there are different sets of endings
        endings = {frozenset(t[len(p) :] for t in terms if t.startswith(p)) for p in {t[:k] for t in terms for k in range(len(t) + 1)}}
        assert len(made.final) == len(endings)
    assert divergence.Transducer.build([]).ordinals(text, starts, ends).max() == -1
    with pytest.raises(ValueError, match="ascend"):
        divergence.Transducer.build([b"b", b"a"])


def plain_divergence(rows, least, top):
    rows = [((r[1] or ""), (r[2] or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r[0] or "").translate({c: c + 32 for c in range(65, 91)}))) for r in rows]
    out = []
    for lang in {r[0] for r in rows}:
        here = [r for r in rows if r[0] == lang]
        seen = Counter(t for r in here for t in set(r[2]))
        kept = sorted((t for t, n in seen.items() if n >= least), key=str.encode)
        counts = {s: Counter() for s in {r[1] for r in here}}
        for _, s, words in here:
            counts[s].update(w for w in words if seen[w] >= least)
        whole = sum(counts.values(), Counter())

        def p(c):
            return {t: 1 + 1000000000 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}

        ps, q = {s: p(c) for s, c in counts.items()}, p(whole)
        for s in counts:
            pairs = [(o, sum((ps[s][t] - ps[o][t]) ** 2 // (ps[s][t] + ps[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, (ps[s][t] - q[t]) ** 2 // (ps[s][t] + q[t])) for t in kept if counts[s][t] and ps[s][t] > q[t]]
            for part, some, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(some, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


def random_documents(n=150):
    rnd = random.Random(8)
    words = ["Der", "die", "haus", "Häuser", "été", "ab", "abc", "abd", "x", "y", "z", "中文", "it's", "42", "don-t"]
    rows = [(" ".join(rnd.choices(words, k=rnd.randint(0, 40))), rnd.choice(["de", "en", None, ""]), rnd.choice(["s1", "s2", "ß", None, "S1"])) for _ in range(n)]
    return rows + rows[:10] + [(None, "de", "s9"), ("one only", "xx", "a"), ("", "xx", "b"), (None, None, None), ("A" * 300_000 + " die " * 50_000, "de", "s1")]


@pytest.mark.parametrize("cells, side", [(1 << 19, 256), (6, 2), (1, 1)])
def test_divergence_of_odd_documents(spark, monkeypatch, cells, side):
    """Nulls, a language without kept terms, repeated rows, a long text, clashing columns; blocks of any size agree."""
    monkeypatch.setattr(divergence, "BLOCK_CELLS", cells)
    monkeypatch.setattr(divergence, "SIDE_SOURCES", side)
    rows = random_documents()
    df = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 AS rank", "2 AS term", "3 AS n", "4 AS ordinal")
    got = sorted(tuple(r) for r in divergence.source_divergence(df.repartition(3), 10, 3).collect())
    assert got == plain_divergence(rows, 10, 3)


def test_divergence_in_shards_and_blocks(spark, monkeypatch):
    """Small shards, texts streamed once for each block of automata, small pieces: the same counts."""
    rows = random_documents()
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    terms = divergence.vocabulary(df, 10)
    one = sorted(tuple(r) for r in divergence.term_counts(df, divergence.transducers(terms)).collect())
    monkeypatch.setattr(divergence, "WALK_BYTES", 50)
    shards = divergence.transducers(terms, shard_terms=3)
    assert shards.count() > 6
    many = sorted(tuple(r) for r in divergence.term_counts(df, shards, broadcast_bytes=300).collect())
    assert many == one and one


def test_divergence_of_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.source_divergence(empty).collect() == []
    few = spark.createDataFrame([("a b", "de", "x"), ("a", "de", "y")], "text string, lang string, source string")
    assert sorted(tuple(r) for r in divergence.source_divergence(few).collect()) == [("de", "x", "pair", "y", 0, 1), ("de", "y", "pair", "x", 0, 1)]


# ---- op13


@pytest.fixture(scope="module")
def ranks():
    with open(RANKS, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@pytest.fixture(scope="module")
def theirs(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_as_merged(ranks, theirs):
    ours = bpe.BytePairEncoding(ranks, public_tokenizers.PATTERN)
    rnd = random.Random(2)
    for alphabet in ("ab", "aA ", "\n \t ", "éèñ中文日本", "abcdefghijklmnop", "a\x85\x1c 　 .", "'sdm ll've", "0123 !?", "é‍😀"):
        for n in (1, 5, 50, 500, 3000):
            text = "".join(rnd.choice(alphabet) for _ in range(n))
            ids = ours.encode(text).tolist()
            assert ids == theirs.encode_ordinary(text)
            assert ours.decode(ids) == text.encode()
    assert ours.decode([1, 50_256]) is None and ours.decode([None]) is None and ours.decode([]) == b""


def test_long_texts_are_cut_where_no_piece_runs_on(ranks, theirs, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 7)
    monkeypatch.setattr(bpe, "MEMO", 5)
    ours = bpe.BytePairEncoding(ranks, public_tokenizers.PATTERN)
    rnd = random.Random(4)
    for alphabet in ("ab  \n", "a 1.'s", "a\x85　 \t"):
        text = "".join(rnd.choice(alphabet) for _ in range(2000))
        assert ours.encode(text).tolist() == theirs.encode_ordinary(text)


def test_one_long_piece(ranks):
    """A megabyte without white space takes a pass, not its square."""
    ours = bpe.BytePairEncoding(ranks, public_tokenizers.PATTERN)
    rnd = random.Random(9)
    for text in ("a" * 1_000_000, "".join(rnd.choices("abcdefgh", k=1_000_000))):
        ids = ours.encode(text).tolist()
        assert ours.decode(ids) == text.encode()
        assert all(ours.fits(a, b) for a, b in zip(ids, ids[1:]))


def test_tokens_that_merging_never_makes():
    """A token out of reach is given for a piece equal to it and nowhere else, as by plain merging."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 300, b"xyz": 301, b"abcd": 302}
    ours = bpe.BytePairEncoding(ranks, r"\S+|\s+")
    plain = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    for text in ("xyz", "xyzz", "abc", "aabc", "bcabc", "abcd", "abcdd", "bcd", "xyabcz abcbc"):
        assert ours.encode(text).tolist() == plain.encode_ordinary(text)
    with pytest.raises(ValueError, match="single bytes"):
        bpe.BytePairEncoding({b"a": 0}, r"\S+")


def test_op13(spark, theirs):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = Q.op13_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = theirs.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_tokenizer_of_odd_rows(spark, theirs):
    from pyspark.sql import functions as F

    coding = bpe.Tokenizer(spark, RANKS, public_tokenizers.PATTERN)
    rows = [(1, None, 1), (2, "", 2), (2, "", 2), (3, "Hällo <|endoftext|> wörld\n\n x", 3), (None, " ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = df.select("doc_id", "text", coding.encode(F.col("text")).alias("coded")).withColumn("back", coding.decode(F.col("coded"))).collect()
    assert [r.coded for r in out] == [theirs.encode_ordinary(t or "") for _, t, _ in rows]
    assert [bytes(r.back).decode() for r in out] == [t or "" for _, t, _ in rows]
    broken = df.limit(1).select(coding.encode(F.unhex(F.lit("61FF62")).cast("string")).alias("c"), coding.decode(F.array(F.lit(60000))).alias("n")).first()
    assert broken.c == theirs.encode_ordinary("a�b") and broken.n is None
    assert df.where("false").select(coding.encode(F.col("text")).alias("c")).collect() == []
