"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glossmill.llm import simhash

SF = "/root/testdata/sf0.01"


def plain_shingles(text):
    words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def plain_kept(rows):
    """Smallest ids of the components of all pairs with a similarity of at least 4/5."""
    sets = {r[0]: plain_shingles(r[1]) for r in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids, near = sorted(sets), 0
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x == y or (5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 9 * len(x & y) >= 4 * (len(x) + len(y))):
                near += x != y
                low, high = sorted((root(a), root(b)))
                label[high] = low
    return [i for i in ids if root(i) == i], near


def test_stage_finds_all_near_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").dropDuplicates(["doc_id"])
    want, near = plain_kept(docs.select("doc_id", "text").collect())
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()) == want and near > 0


def test_share_of_near_copies_with_a_common_signature(spark):
    """Of all pairs of different texts at sf0.1 with a similarity of 4/5 and more, at least 95 % become candidates.

    The pairs are found by brute force over the rarest shingles: a pair that alike shares one of the first fifth.
    """
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()]
    sets = {}
    for t in texts:
        words = simhash.word_hashes(t.encode())
        shingles = simhash.shingle_set(words, 5)
        if len(shingles):
            sets.setdefault(shingles.tobytes(), (shingles, words))
    sets = list(sets.values())
    counts = dict(zip(*np.unique(np.concatenate([s for s, _ in sets]), return_counts=True), strict=True))
    index, found = {}, set()
    for n, (s, _) in enumerate(sets):
        rare = sorted(s.tolist(), key=lambda x: (counts[x], x))[: len(s) - -(-4 * len(s) // 5) + 1]
        for k in {k for x in rare for k in index.get(x, ())}:
            both = len(np.intersect1d(s, sets[k][0], assume_unique=True))
            if 9 * both >= 4 * (len(s) + len(sets[k][0])):
                found.add((k, n))
        for x in rare:
            index.setdefault(x, []).append(n)
    prints = {n: simhash.wide_fingerprint(sets[n][1]).view(np.uint32) for pair in found for n in pair}
    near = [any(int(x).bit_count() <= 1 for x in prints[a] ^ prints[b]) for a, b in found]
    assert len(near) > 40 and sum(near) >= 0.95 * len(near)


def components(ids, linked):
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if linked(a, b):
                low, high = sorted((root(a), root(b)))
                label[high] = low
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("limit", [2, 16])
def test_large_group_of_near_copies(spark, monkeypatch, limit):
    """Copies with a few words changed, chained and beside the limit, with buckets that nearly all take the other way.

    All alike pairs with a common signature are linked, and none that is not alike.
    """
    monkeypatch.setattr(simhash, "SMALL_GROUP", limit)
    draw = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 90):
        words = list(base)
        for _ in range(draw.choice((1, 2, 3, 4, 8))):
            words[draw.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words[: draw.choice((120, 120, 110, 97))])))
    sets = {i: plain_shingles(t) for i, t in rows}
    prints = {i: simhash.wide_fingerprint(simhash.word_hashes(t.encode())).view(np.uint32) for i, t in rows}
    alike = lambda a, b: 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))
    near = lambda a, b: any(int(x).bit_count() <= 1 for x in prints[a] ^ prints[b])
    ids = [i for i, _ in rows]
    least, most = components(ids, lambda a, b: alike(a, b) and near(a, b)), components(ids, alike)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_copy_groups(docs).collect()}
    assert all(got[i] == got[k] for i, k in least.items()) and all(most[i] == most[k] for i, k in got.items())
    assert 1 < len(set(most.values())) <= len(set(got.values())) < len(ids)
    assert sorted(r.doc_id for r in simhash.drop_near_copies(docs).collect()) == sorted(set(got.values()))


def test_odd_rows(spark):
    """Null and empty texts are one group, short texts one shingle, a row repeated in full stays once."""
    rows = [(5, None, 1), (4, "", 2), (6, "A b", 3), (7, "a  B", 4), (None, "a b", 5), (8, "a b c", 6), (9, "q w e r t y", 7), (9, "q w e r t y", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key int").withColumn("_n", F.lit(1)).withColumn("row", F.lit(2)).withColumn("key", F.lit(3))
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id, r["_key"]) for r in kept.collect()) == [(4, 2), (6, 3), (8, 6), (9, 7)]
    assert simhash.near_copy_groups(docs).count() == 8 and simhash.drop_near_copies(docs.limit(0)).count() == 0


def test_segment_buckets_count_texts(spark):
    """Buckets over distinct segments hold and count what buckets of texts hold: whole segments and those less one set bit."""
    draw = random.Random(4)
    base = [draw.getrandbits(32) for _ in range(3)]
    rows = []
    for fp in range(200):
        for number in range(3):
            value = base[number]
            for _ in range(draw.choice((0, 0, 1, 2))):
                value ^= 1 << draw.randrange(32)
            rows.append((number << 32 | (draw.getrandbits(32) if fp % 4 == 0 else value), fp, 9))
    keys = {}
    for value, fp, _ in rows:
        for key in [value] + [value & ~(1 << b) for b in range(32) if value >> b & 1]:
            keys.setdefault(key, []).append((value, fp))
    want = {(k, v, k == v, len(x)) for k, x in keys.items() if len(x) > 1 and any(v == k for v, _ in x) for v, _ in x}
    got = simhash._segment_buckets(spark.createDataFrame(rows, "value long, fp long, n int")).collect()
    assert sorted(map(tuple, got)) == sorted(want) and max(m for *_, m in want) > 16
    per_key = {}
    for key, value, *_ in want:
        per_key.setdefault(key, set()).add(value)
    assert max(map(len, per_key.values())) <= 33
