"""The queries opN_* against plain Python over whole small tables."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from glossmill.llm import queries as Q

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = {c: c + 32 for c in range(65, 91)}


def rows(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet").collect()


def result(df, key):
    out = df.collect()
    got = {r[key]: r for r in out}
    assert len(got) == len(out)
    return got


def test_op1(spark):
    got = result(Q.op1_warc(spark, SF), "page_id")
    pages = sorted(rows(spark, "pages"), key=lambda r: r.page_id)
    first = {}
    for p in pages:
        data = (p.html or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        refers = first.setdefault(digest, p.page_id) if len(data) >= 100 else p.page_id
        r = got[p.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(data), digest)
        assert (r.record_type, r.refers_to) == (("response", None) if refers == p.page_id else ("revisit", refers))
    assert len(got) == len(pages)


def test_op3(spark):
    """Every document once; the held-out rows by plain CRC-32; labels of held-out rows change no score."""
    import zlib

    from pyspark.sql import functions as F

    from glossmill.llm import toxicity

    got = result(Q.op3_toxicity(spark, SF), "doc_id")
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    texts = {d.doc_id: d.text for d in docs.collect()}
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    machine = toxicity.fit(docs, flipped)
    for i, r in got.items():  # the machine written out, with every pair of terms
        terms = sorted(machine.terms_of((texts[i] or "").encode()))
        raw = machine.bias + sum(machine.weights[t] for t in terms)
        f = machine.factors[terms]
        raw += sum(float(f[a] @ f[b]) for a in range(len(terms)) for b in range(a)) if len(terms) < 60 else 0.5 * float((f.sum(0) ** 2).sum() - (f**2).sum())
        assert r.score == pytest.approx(float(1 / (1 + np.exp(-min(max(raw, -30.0), 30.0)))), abs=1e-9)


def test_op4(spark):
    got = result(Q.op4_quality(spark, SF), "doc_id")
    docs = rows(spark, "documents")
    for d in docs:
        text = d.text or ""
        words = WORD.findall(text)
        windows = defaultdict(list)
        for k in range(len(words) - 2):
            windows[tuple(words[k : k + 3])].append(k)
        inside = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        r = got[d.doc_id]
        assert r.n_words == len(words) and r.word_chars == sum(map(len, words))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_repeat_words == len(inside)
        assert r.base_failed == (len(words) < 50 or 100 * len(inside) > 50 * len(words))
        assert not (r.kept and r.base_failed)
    assert len(got) == len(docs)
    votes = {d.doc_id: plain_votes(d.text or "") for d in docs}
    good = plain_em(votes)
    for i, r in got.items():
        assert r.posterior == pytest.approx(good[i], abs=1e-6) and r.kept == (not r.base_failed and good[i] >= 0.5)
    assert {r.kept for r in got.values()} == {True, False}


def plain_votes(text):
    """The votes of the rules of op4, from the text alone."""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    w = max(len(words), 1)
    latin = [c for c in text if c.isascii() and c.isalpha()]
    letters = len(latin) + sum(len(c.encode()) for c in text if not c.isascii())
    marks = sum(33 <= ord(c) < 127 and not c.isalnum() for c in text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    twice = {x for x in windows if windows.count(x) > 1} if len(set(windows)) < len(windows) else set()
    repeated = len({k + j for k, x in enumerate(windows) if x in twice for j in range(3)})
    size = sum(map(len, words)) / w
    ended = sum(x.rstrip(" \t\n\r\x0b\x0c")[-1] in ".!?" for x in lines)

    def low(x, good, bad):
        return -1 if x > bad else 1 if x <= good else 0

    def high(x, good, bad):
        return -1 if x < bad else 1 if x >= good else 0

    return (
        low(len(re.findall(r"[#*$%&|<>]", text)) / w, 0.02, 0.1),
        low(marks / w, 0.3, 0.45),
        high(letters / max(letters + marks, 1), 0.93, 0.9),
        low(sum(c.isupper() for c in latin) / max(len(latin), 1), 0.15, 0.5),
        low(text.count("!!") / w, 0.01, 0.1),
        low(repeated / w, 0.1, 0.3),
        high(len(set(words)) / w, 0.35, 0.12),
        1 if 3 <= size <= 8 else 0 if 2 <= size <= 14 else -1,
        low((len(lines) - len(set(lines))) / len(lines), 0.1, 0.3) if len(lines) > 2 else 0,
        high(ended / len(lines), 0.7, 0.3) if len(lines) > 2 else 0,
        -1 if len(words) < 50 else 1 if len(words) >= 100 else 0,
    )


def plain_em(votes):
    """Expectation-maximisation document by document: the posterior of each."""
    good = {i: (0.9, 0.3, 0.05)[min(v.count(-1), 2)] for i, v in votes.items()}
    for _ in range(200):
        mass = {(r, c, x): 0.5 for r in range(11) for c in (0, 1) for x in (-1, 0, 1)}
        for i, v in votes.items():
            for r, x in enumerate(v):
                mass[r, 1, x] += good[i]
                mass[r, 0, x] += 1 - good[i]
        share = (sum(good.values()) + 1) / (len(votes) + 2)
        total = {(r, c): sum(mass[r, c, x] for x in (-1, 0, 1)) for r in range(11) for c in (0, 1)}
        before, good = good, {}
        for i, v in votes.items():
            yes, no = share, 1 - share
            for r, x in enumerate(v):
                yes *= mass[r, 1, x] / total[r, 1]
                no *= mass[r, 0, x] / total[r, 0]
            good[i] = yes / (yes + no)
        if max(abs(good[i] - before[i]) for i in votes) < 1e-9:
            break
    return good


def test_op6(spark):
    got = result(Q.op6_simhash(spark, SF), "doc_id")
    prints = {}
    for d in rows(spark, "documents"):
        words = WORD.findall((d.text or "").translate(ASCII))
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
        prints[d.doc_id] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and label[b] < label[a]:
                    label[a], changed = label[b], True
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{f:016x}", label[i]) for i, f in prints.items()}


def test_op8(spark):
    got = result(Q.op8_mixing(spark, SF), "doc_id")
    docs = rows(spark, "documents")
    size = {d.doc_id: len(WORD.findall(d.text or "")) for d in docs}
    source = {d.doc_id: d.source for d in docs}
    total = defaultdict(int)
    for i, n in size.items():
        total[source[i]] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(total.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
            open_.remove(s)
    taken = defaultdict(int)
    for i, r in got.items():
        assert r["size"] == size[i] and r.source_size == total[source[i]]
        assert r.target == pytest.approx(target[source[i]])
        assert r.taken % max(r["size"], 1) == 0 and 0 <= r.taken <= 2 * r["size"]
        taken[source[i]] += r.taken
    most = {s: max(n for i, n in size.items() if source[i] == s) for s in names}
    assert all(abs(taken[s] - target[s]) <= most[s] for s in names)
    assert sum(taken.values()) <= 1.5 * sum(total.values())
    # The fair queue itself: every copy in the order of its finish time, from the same shuffled order of each source.
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    place = {d.doc_id: md5(f"mix:{d.doc_id}:{md5(d.text)}") for d in docs if d.text is not None}
    copies, sent = [], defaultdict(int)
    for i in sorted(place, key=lambda i: (place[i], i, size[i])):
        s = source[i]
        sent[s] += size[i]
        copies += [((e * total[s] + sent[s]) / weight[s], names.index(s), place[i], i) for e in (0, 1) if size[i]]
    plan, used = defaultdict(int), 0
    for *_, i in sorted(copies):
        used += size[i]
        if used > 1.5 * sum(total.values()):
            break
        plan[i] += size[i]
    assert {i: r.taken for i, r in got.items()} == {i: plan[i] for i in got}
    assert {(r.doc_id, r.taken) for r in got.values()} == {(r.doc_id, r.taken) for r in Q.op8_mixing(spark, SF).collect()}


def test_op9(spark):
    got = result(Q.op9_chat(spark, SF), "conv_id")
    turns = defaultdict(list)
    for r in rows(spark, "conversations"):
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    turns[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    assert got.keys() == turns.keys()
    for conv, said in turns.items():
        said.sort()
        learned = "".join(t for _, role, t in said if role == "assistant")
        r = got[conv]
        assert r.n_turns == len(said) and r.loss_chars == len(learned)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{b}\n{t}\n" for _, b, t in said).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert r.formatted_chars > sum(len(t) for *_, t in said)


def test_op10(spark):
    got = result(Q.op10_decontamination(spark, "/root/testdata/sf0.01"), "doc_id")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words_of = lambda t: pattern.findall((t or "").translate(ASCII))
    windows = defaultdict(set)
    for b in rows(spark, "benchmark", "/root/testdata/sf0.01"):
        w = words_of(b.text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(b.item_id))
    sizes = {len(w) for w in windows}
    hits = 0
    for d in rows(spark, "documents", "/root/testdata/sf0.01"):
        w = words_of(d.text)
        hit, items = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    items |= found
        r = got[d.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(items), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        hits += bool(hit)
    assert hits > 5
