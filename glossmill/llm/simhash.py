"""Near-duplicate removal with SimHash fingerprints and deletion-variant signatures.

A fingerprint is cut into segments of 32 bits, so few that of two fingerprints within the limit one segment differs in
at most one bit. It is enough to index each segment and its one-wildcard variants: the segment itself, and the segment
with one of its set bits removed. Fingerprints that share such a key are candidates and are verified.

* :func:`near_duplicate_groups` links 64-bit fingerprints (two segments) that differ in at most two bits.
* :func:`near_copy_groups` links texts with a Jaccard similarity of their word shingles of 0.8 or more. Fingerprints of
  512 bits (sixteen segments) find the candidates, the whole sets of shingles verify them. Texts that alike differ in
  about a tenth of the bits, far beyond 64 bits with two segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from glossmill.llm.common import bounded_batches, boxed, connected_components, cut, release

#: Members of a candidate bucket up to which its pairs are compared one by one; larger ones take the exact other way.
SMALL_BUCKET = 48
#: The same for buckets of texts, whose pairs are verified on whole sets.
SMALL_GROUP = 16
#: 64-bit words of the fingerprint of :func:`near_copy_groups`, and words in a feature of it. An edit of one word
#: changes two word pairs but five shingles of five words, so fingerprints of pairs stay closer.
WIDE, PAIR = 8, 2
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 13
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _majority(parts: Iterator[np.ndarray], n: int, words: int = 1) -> np.ndarray:
    """The bits set in over half of ``n`` hashes of ``words`` 64-bit words each, as signed words."""
    ones = np.zeros(64 * words, np.int64)
    for some in parts:
        bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8 * words), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.uint32)
    return np.packbits(2 * ones > n, bitorder="little").view("<i8")


def fingerprint_of(text: bytes | None, width: int) -> int:
    """SimHash of a UTF-8 text over its word shingles, repeats included, as a signed 64-bit integer.

    A-Z are lower-cased. A text with fewer words than ``width`` is one shingle; one without words has fingerprint 0.
    """
    words = (text or b"").translate(_LOWER).split()
    n = len(words)
    if not n:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= width:
        shingles = 1
        hashes = iter((digest(joined, 42),))
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        shingles = n - width + 1
        cuts = zip(starts[:shingles].tolist(), ends[width - 1 :].tolist(), strict=True)
        hashes = (digest(joined[a:b], 42) for a, b in cuts)
    sizes = (min(_CHUNK, shingles - k) for k in range(0, shingles, _CHUNK))
    return int(_majority((np.fromiter(hashes, "<u8", k) for k in sizes), shingles)[0])


def fingerprint(text: Column, width: int) -> Column:
    """SimHash column of a string column (see :func:`fingerprint_of`)."""

    @F.pandas_udf(T.LongType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint_of(x, width) for x in texts], dtype="int64")

    return run(text.cast("binary"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _MIX[0]
    x = (x ^ x >> np.uint64(27)) * _MIX[1]
    return x ^ x >> np.uint64(31)


def word_hashes(text: bytes | None) -> np.ndarray:
    """Hashes of the words of a UTF-8 text, A-Z lower-cased."""
    words = (text or b"").translate(_LOWER).split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, or of the whole text if it is shorter; none without words."""
    width = min(width, len(words))
    out = np.zeros(len(words) - width + 1 if width else 0, np.uint64)
    for k in range(width):
        out = out * _STEP + words[k : k + len(out)]
    return _mixed(out)


def wide_fingerprint(words: np.ndarray) -> np.ndarray:
    """SimHash of ``WIDE`` 64-bit words over pairs of words, repeats included."""
    pairs = _shingle_hashes(words, PAIR)
    seeds = np.arange(1, WIDE + 1, dtype=np.uint64) * _STEP
    chunks = (pairs[k : k + _CHUNK, None] for k in range(0, len(pairs), _CHUNK))
    return _majority((_mixed(x + seeds) for x in chunks), len(pairs), WIDE)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted hashes of the different word shingles."""
    return np.unique(_shingle_hashes(words, width))


def _segment_keys(word: str, number: int = 0) -> tuple[str, str]:
    """SQL of the keys of both 32-bit segments of a 64-bit word, and of those with one set bit removed.

    A key tells its segment by its number; ``number`` is that of the word.
    """
    plain, less = [], []
    for k, part in enumerate((f"shiftrightunsigned({word}, 32)", f"{word} & 4294967295L")):
        name = f"shiftleft({2 * number + k}L, 32)"
        bits = f"filter(transform(sequence(0, 31), i -> shiftleft(1L, i)), b -> ({part}) & b != 0)"
        plain.append(f"({part}) | {name}")
        less.append(f"transform({bits}, b -> (({part}) & ~b) | {name})")
    return f"array({', '.join(plain)})", f"concat({', '.join(less)})"


def link_fingerprints(fps: DataFrame) -> DataFrame:
    """Links between the distinct values of ``fps(fp)`` that differ in at most two bits.

    Returns ``(src, dst)`` such that the components of the result are those of the full link graph. Buckets of up to
    ``SMALL_BUCKET`` fingerprints compare their pairs. The members of larger buckets (a large group of near copies)
    are instead joined through their one-bit neighbours: two fingerprints are within two bits exactly if one value is
    within one bit of both, and at most 65 fingerprints lie around any value, so no group grows with the data.
    """
    keyed = fps.select("fp", F.explode(F.expr("concat({}, {})".format(*_segment_keys("fp")))).alias("key"))
    shared = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    keyed = cut(keyed.join(shared, "key"), "buckets")
    lists = keyed.where(F.col("n") <= SMALL_BUCKET).groupBy("key").agg(F.collect_list("fp").alias("all"))
    pairs = (
        lists.select(F.explode("all").alias("src"), "all")
        .select("src", F.explode(F.expr("filter(all, x -> x > src AND bit_count(x ^ src) <= 2)")).alias("dst"))
        .distinct()
    )
    around = "concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))"
    crowded = keyed.where(F.col("n") > SMALL_BUCKET).select("fp").distinct()
    stars = (
        crowded.select("fp", F.explode(F.expr(around)).alias("point"))
        .groupBy("point")
        .agg(F.collect_set("fp").alias("all"))
        .where(F.size("all") > 1)
        .select(F.explode("all").alias("src"), F.array_min("all").alias("dst"))
        .where("src != dst")
    )
    return pairs.unionByName(stars)


def text_key(text: Column) -> Column:
    """Tells rows with one doc_id and different texts apart; a null text is empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_duplicate_groups(docs: DataFrame, width: int) -> DataFrame:
    """Fingerprint and group of every row of ``docs(doc_id, text)``.

    Returns ``(doc_id, text_key, fp, component_id)``: ``text_key`` is a hash of the text (null text: empty), and
    ``component_id`` the smallest doc_id reachable over links of at most two bits. Rows without words share
    fingerprint 0. A null doc_id takes part but never names a group, unless all of the group's ids are null (then
    null). Repeated rows all come back; other columns of ``docs`` do not. Equal fingerprints meet before anything is
    linked, so a large group of exact copies is one node. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    marked = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), fingerprint(F.col("text"), width).alias("fp"))
    marked = cut(marked, "fingerprints")
    fps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    return _name_groups(marked, fps, link_fingerprints(fps.select("fp")))


def _name_groups(marked: DataFrame, fps: DataFrame, links: DataFrame) -> DataFrame:
    """``marked(doc_id, text_key, fp)`` with the smallest ``low`` of ``fps(fp, low)`` in each component of ``links``."""
    labels = connected_components(links).select(F.col("node").alias("fp"), "component")
    named = cut(fps.join(labels, "fp").groupBy("component").agg(F.min("low").alias("low")), "lowest")
    linked = labels.join(named, "component").select("fp", "low")
    alone = fps.join(labels, "fp", "left_anti").select("fp", "low")
    names = linked.unionByName(alone).withColumnRenamed("low", "component_id")
    return marked.join(names, "fp").select("doc_id", "text_key", "fp", "component_id")


def _sketch(text: Column, width: int) -> Column:
    """``(fp, n, wide)``: a hash and the size of the set of shingles, and the wide fingerprint."""
    kind = T.StructType().add("fp", T.LongType()).add("n", T.IntegerType()).add("wide", T.ArrayType(T.LongType()))

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for x in texts:
                words = word_hashes(x)
                s = shingle_set(words, width)
                name = np.array(xxhash.xxh3_64_intdigest(s.tobytes()), np.uint64).view(np.int64)
                rows.append((int(name), len(s), wide_fingerprint(words)))
            yield pd.DataFrame(rows, columns=["fp", "n", "wide"])

    return run(text.cast("binary"))


def _shingles(text: Column, width: int) -> Column:
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingle_set(word_hashes(x), width).view(np.int64) for x in texts], dtype=object)

    return run(text.cast("binary"))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs(src, dst)`` whose ``sets(fp, shingles)`` have the Jaccard similarity."""
    a = sets.select(F.col("fp").alias("src"), F.col("shingles").alias("a"))
    b = sets.select(F.col("fp").alias("dst"), F.col("shingles").alias("b"))
    both = pairs.distinct().join(a, "src").join(b, "dst")
    both = both.select("src", "dst", F.size(F.array_intersect("a", "b")).alias("i"), (F.size("a") + F.size("b")).alias("s"))
    return cut(both.where(F.col("i") / (F.col("s") - F.col("i")) >= similarity).select("src", "dst"), "links")


def _all_pairs(buckets: DataFrame, similarity: float) -> DataFrame:
    """Pairs inside small ``buckets(key, fp, n, main)`` whose sizes allow the similarity; one of a pair must be ``main``."""
    lists = buckets.groupBy("key").agg(F.collect_list(F.struct("fp", "n", "main")).alias("all"))
    fits = (
        "filter(all, x -> x.fp > one.fp AND (x.main OR one.main)"
        f" AND least(x.n, one.n) >= {similarity}D * greatest(x.n, one.n) - 1e-9D)"
    )
    pairs = lists.select(F.explode("all").alias("one"), "all").select("one", F.explode(F.expr(fits)).alias("two"))
    return pairs.select(F.col("one.fp").alias("src"), F.col("two.fp").alias("dst"))


def _shared(rows: DataFrame) -> DataFrame:
    """``rows(key, main, ...)`` of keys with a ``main`` row and another one, with the number ``m`` of the key's rows."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("m"), F.max("main").alias("any")).where("m > 1 AND any").drop("any")
    sizes = cut(sizes, "shared")
    out = cut(rows.join(sizes, "key"), "buckets")
    release(sizes)
    return out


def _with_hubs(crowded: DataFrame) -> DataFrame:
    """``crowded(key, fp, m, ...)`` with the ``hub`` of each key: the member that shares most, the middle of a large group."""
    fame = crowded.groupBy("fp").agg(F.sum("m").alias("fame"))
    hubs = crowded.join(fame, "fp").groupBy("key").agg(F.max(F.struct("fame", F.col("fp").alias("hub"))).alias("best"))
    return crowded.join(cut(hubs, "hubs").select("key", "best.hub"), "key")


def _segment_buckets(parts: DataFrame) -> DataFrame:
    """Buckets ``(key, value, main, m)`` over the distinct segments of ``parts(value, fp, n)``; ``m`` counts the rows in a key.

    Equal segments meet before their variants are made, so a large group of near copies is as many rows as it has
    different segments. A value has at most 33 keys and a key at most 33 values, so the windows over a key stay small.
    Only keys with a whole segment (``main``) and another row stay.
    """
    values = parts.groupBy("value").agg(F.count("*").alias("c"))
    less = "transform(filter(transform(sequence(0, 31), i -> shiftleft(1L, i)), b -> value & b != 0), b -> value & ~b)"
    keyed = values.select("value", "c", F.explode(F.expr(f"concat(array(value), {less})")).alias("key"))
    by_key = Window.partitionBy("key")
    keyed = keyed.withColumn("main", F.col("key") == F.col("value"))
    keyed = keyed.withColumns({"m": F.sum("c").over(by_key), "any": F.max("main").over(by_key)})
    return cut(keyed.where("m > 1 AND any").select("key", "value", "main", "m"), "buckets")


def _hub_members(crowded: DataFrame, held: DataFrame) -> DataFrame:
    """Members ``(key, hub, fp, n)`` of the hubs of large buckets ``crowded(key, value)``, from ``held(value, fp, n, w)``.

    A bucket's hub is the member that shares most (``w``: rows in the crowded keys of a value), the middle of a large
    group. Keys take the hub that shares most in all keys of their own hub, so overlapping buckets are one group; the
    group's ``key`` is the hub. All is decided over values; only the last join has a row for each member.
    """
    famed = cut(held.withColumn("fame", F.sum("w").over(Window.partitionBy("fp"))).drop("w"), "famed")
    best = famed.groupBy("value").agg(F.max(F.struct("fame", F.col("fp").alias("hub"))).alias("best"))
    hubs = crowded.join(best, "value").withColumn("best", F.max("best").over(Window.partitionBy("key")))
    hubs = cut(hubs.select("value", "best").distinct(), "hubs")
    own = famed.join(hubs.select(F.col("best.hub").alias("fp")).distinct(), "fp")
    top = own.join(hubs, "value").groupBy("fp").agg(F.max("best").alias("top"))
    pairs = hubs.join(top, F.col("best.hub") == F.col("fp")).select("value", F.col("top.hub").alias("hub")).distinct()
    pairs = cut(pairs, "hubs")
    members = cut(famed.join(pairs, "value").select(F.col("hub").alias("key"), "hub", "fp", "n").distinct(), "members")
    for old in (famed, hubs, pairs):
        release(old)
    return members


def _inner_pairs(groups: DataFrame, similarity: float) -> DataFrame:
    """Pairs of members that can be alike by what is ``inside`` the hubs' sets alone; one of a pair must be ``left``.

    Alike are those with at least ``t = s / (1 + s)`` of the sum of their sizes in common, so each must have as much
    inside. They meet by size, in bins of two percent.
    """
    s, t = similarity, similarity / (1 + similarity)
    size_bin = lambda n: f"int(floor(ln(greatest(1D, {n})) / ln(1.02D)))"
    most = f"least(n / {s}D, inside / {t}D - n) + 1e-9D"
    x = groups.where(F.col("left")).where(F.expr(f"{most} >= {s}D * n - 2e-9D"))
    x = x.select("key", F.col("fp").alias("x"), F.col("n").alias("nx"), F.col("inside").alias("ix"),
                 F.explode(F.expr(f"sequence({size_bin(f'{s}D * n - 1e-9D')}, {size_bin(most)})")).alias("bin"))
    y = groups.where(F.col("inside") >= s * F.col("n") - 1e-9).withColumn("bin", F.expr(size_bin("double(n)")))
    y = y.select("key", "bin", "fp", "n", "inside")
    pairs = y.join(x, ["key", "bin"]).where("fp != x").where(f"least(inside, ix) >= {t}D * (n + nx) - 1e-9D")
    return pairs.select(F.least("x", "fp").alias("src"), F.greatest("x", "fp").alias("dst"))


def _link_sets(small: DataFrame, members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links ``(src, dst)`` whose components are those of all alike pairs that share a bucket.

    ``small(key, fp, n, main)``: buckets of up to ``SMALL_GROUP`` texts, which verify all pairs; ``members(key, hub, fp,
    n)``: larger ones (a large group of near copies) by their hubs; ``sets(fp, shingles)``. The members of a larger one
    are verified against one of them, its hub. Of those that are not linked to it, a pair that is alike either shares a
    shingle that the hub has not, and meets again in the smaller bucket of that shingle, or has nothing in common but
    parts of the hub: then each of both has at least 4 / 9 (at 0.8) of the sum of their sizes in common with it, which
    hardly any has that is not alike the hub itself. So no group is cut into all pairs and no link is lost. Crowded
    buckets of shingles are resolved in the same way, with what the hubs so far leave of the sets, which shrinks in
    every round.
    """
    found = [_verified(_all_pairs(small, similarity), sets, similarity)]
    rest = members.join(sets.withColumn("rest", F.col("shingles")), "fp")
    while members.limit(1).count():
        known = sets.join(members.select("hub").distinct(), F.col("fp") == F.col("hub"))
        known = cut(known.select("hub", F.col("shingles").alias("known"), F.size("shingles").alias("size")), "hub-sets")
        both = F.size(F.array_intersect("shingles", "known"))
        groups = rest.join(known, "hub").select(
            "key", "hub", "fp", "n", F.array_except("rest", "known").alias("rest"), (both / (F.col("n") + F.col("size") - both)).alias("alike")
        )
        groups = groups.withColumn("inside", F.col("n") - F.size("rest")).withColumn("left", F.col("alike") < similarity)
        groups = cut(groups, "groups")
        found.append(groups.where("fp != hub AND NOT left").select(F.col("hub").alias("src"), F.col("fp").alias("dst")))

        open_ = cut(groups.where("left").select("key").distinct(), "open")
        still = groups.join(open_, "key", "left_semi")
        tokens = still.select(F.col("key").alias("parent"), "fp", "n", F.col("left").alias("main"), F.explode("rest").alias("token"))
        tokens = _shared(tokens.select(F.xxhash64("parent", "token").alias("key"), "parent", "fp", "n", "main"))
        pairs = _all_pairs(tokens.where(F.col("m") <= SMALL_GROUP), similarity).unionByName(_inner_pairs(still, similarity))
        found.append(_verified(pairs, sets, similarity))

        crowded = _with_hubs(tokens.where(F.col("m") > SMALL_GROUP))
        members = cut(crowded.select("key", "parent", "hub", "fp", "n"), "members")
        rest = members.join(groups.select(F.col("key").alias("parent"), "fp", "rest"), ["parent", "fp"]).drop("parent").join(sets, "fp")
    return reduce(DataFrame.unionByName, found)


def near_copy_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Set of shingles and group of every row of ``docs(doc_id, text)``: ``(doc_id, text_key, fp, component_id)``.

    Two texts are linked if their sets of ``width``-word shingles (A-Z lower-cased) have a Jaccard similarity of at least
    ``similarity`` and one of the sixteen 32-bit segments of their wide fingerprints differs in at most one bit, which
    is so for all fingerprints within 31 bits and for most beyond. ``fp`` tells the sets apart; ``component_id`` is the
    smallest doc_id reachable. Rows without words are one group, shorter texts one shingle. Null ids, repeated rows,
    other columns and empty tables as in :func:`near_duplicate_groups`.
    """
    bounded_batches(docs.sparkSession)
    sketched = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), _sketch(F.col("text"), width).alias("s"))
    marked = cut(sketched.select("doc_id", "text_key", "s.*"), "sketches")
    one = F.min(F.struct(row_key(F.col("doc_id"), F.col("text_key")).alias("row"), "n", "wide")).alias("one")
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("low"), one).select("fp", "low", "one.*"), "nodes")

    plain = ", ".join(_segment_keys(f"wide[{k}]", k)[0] for k in range(WIDE))
    parts = nodes.where("n > 0").select(F.explode(F.expr(f"concat({plain})")).alias("value"), "fp", "n")
    buckets = _segment_buckets(parts)
    # Written, so that AQE can split a value which very many texts share.
    shared = cut(buckets.groupBy("value").agg(F.sum(F.when(F.col("m") > SMALL_GROUP, F.col("m"))).alias("w")), "shared")
    held = cut(parts.join(shared, "value"), "held")
    small = buckets.where(F.col("m") <= SMALL_GROUP).join(held, "value").select("key", "fp", "n", "main")
    members = _hub_members(buckets.where(F.col("m") > SMALL_GROUP).select("key", "value"), held.where("w IS NOT NULL"))
    rows = nodes.join(held.select("fp").distinct(), "fp").select("fp", F.col("row").alias("key"))
    texts = docs.select(row_key(F.col("doc_id"), text_key(F.col("text"))).alias("key"), "text")
    texts = texts.join(rows.hint("shuffle_hash"), "key").dropDuplicates(["fp"])
    sets = cut(texts.select("fp", _shingles(F.col("text"), width).alias("shingles")), "sets")
    links = _link_sets(small, members, sets, similarity)
    named = _name_groups(marked, nodes.select("fp", "low"), links)  # the links are components now
    for old in (buckets, shared, held, members, sets):
        release(old)
    return named


def drop_near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of :func:`near_copy_groups`, chosen as by :func:`drop_near_duplicates`."""
    return _keep_first(docs, near_copy_groups(docs, width, similarity))


def drop_near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """``docs`` with one row of each group of :func:`near_duplicate_groups`: that with the smallest doc_id.

    Ties on the id (nulls come last) fall to the smaller hash of the text; of rows equal in both, one stays. All
    columns of ``docs`` are kept, whatever their names; the text is moved once, to meet the decision.
    """
    return _keep_first(docs, near_duplicate_groups(docs, width))


def _keep_first(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The first row of each group of ``groups(doc_id, text_key, fp, component_id)``."""
    groups = cut(groups, "groups")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    # Rows with one key are copies and meet again below, so a group needs only its first key.
    keep = groups.groupBy(F.coalesce(F.col("component_id").cast("string"), F.col("fp").cast("string")).alias("a"), F.col("component_id").isNull().alias("b"))
    keep = keep.agg(F.min(first).alias("k")).select(row_key(F.col("k.doc_id"), F.col("k.text_key")).alias("key"))
    rows = docs.select(row_key(F.col("doc_id"), text_key(F.col("text"))).alias("key"), boxed(docs).alias("row"))
    repeated = groups.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.limit(1).count():  # combined before the shuffle, so a row that is repeated very often is not moved as often
        rows = rows.groupBy("key").agg(F.first("row").alias("row"))
    return rows.join(keep.hint("shuffle_hash"), "key", "left_semi").select("row.*")


def row_key(doc_id: Column, of: Column) -> Column:
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), of.cast("string"))
