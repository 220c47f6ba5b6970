"""How far the sources of a language differ in their words, with vocabularies held as minimal acyclic transducers.

The terms of a language that enough documents have are sorted and cut into shards. The terms of a shard, in order, become
the smallest acyclic automaton that accepts them; each arc carries how many terms come before those behind it, so the sum
along a path is the term's place in the order (its ordinal). Texts are streamed through the automata to count the terms of
each source; a term is its ordinal from then on, in counts, joins and ties, and a string again only in the result.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossmill.llm.common import bounded_batches, cut, release

#: Terms in one automaton.
SHARD_TERMS = 100_000
#: Bytes of automata that are broadcast at once; beyond that the texts are streamed once for each such block.
BROADCAST_BYTES = 128 << 20
#: Distinct terms that a task counts before it passes them on, and bytes of text walked at once.
TASK_TERMS, WALK_BYTES = 500_000, 4 << 20
#: Counts (sources times terms) in one block of the comparison, and sources in one side of it.
BLOCK_CELLS, SIDE_SOURCES = 1 << 15, 256
SCALE = 1_000_000_000

#: Letters A-Z lower-cased, other letters and bytes beyond ASCII kept, anything else a space.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


class Transducer:
    """Minimal acyclic automaton of sorted terms with ordinals.

    Arcs are sorted by ``state * 256 + byte``; ``target`` is where an arc leads and ``skip`` how many terms of its state
    come before those behind it. ``final`` says which states end a term. State 0 is the start.
    """

    def __init__(self, keys: np.ndarray, target: np.ndarray, skip: np.ndarray, final: np.ndarray):
        self.keys, self.target, self.skip, self.final = keys, target, skip, final

    @classmethod
    def build(cls, terms: Iterable[bytes]) -> Transducer:
        """From terms in ascending order, each once: when a term leaves the path of the one before it, the states that it
        leaves behind can no longer change, and each is exchanged for an equal one if there is one."""
        register: dict[tuple, int] = {}
        frozen: list[tuple[bool, list[tuple[int, int]]]] = []  # (ends a term, arcs (byte, state))
        open_states: list[list] = [[False, []]]  # states along the last term; the arc between two is added on closing
        last = b""

        def close(depth: int) -> None:
            while len(open_states) > depth + 1:
                ends, arcs = open_states.pop()
                key = (ends, *arcs)
                if key not in register:
                    register[key] = len(frozen)
                    frozen.append((ends, arcs))
                open_states[-1][1].append((last[len(open_states) - 1], register[key]))

        for term in terms:
            if term <= last and (last or open_states[0][0]):
                raise ValueError("terms must ascend")
            common = next((k for k, (a, b) in enumerate(zip(last, term)) if a != b), min(len(last), len(term)))
            close(common)
            open_states.extend([False, []] for _ in term[common:])
            open_states[-1][0] = True
            last = term
        close(0)
        frozen.append(tuple(open_states[0]))
        behind: list[int] = []  # terms behind each state; states come after those they lead to
        for ends, arcs in frozen:
            behind.append(ends + sum(behind[to] for _, to in arcs))
        top = len(frozen) - 1
        keys, target, skip = [], [], []
        for state in range(top, -1, -1):  # numbered from the start state down
            ends, arcs = frozen[state]
            before = int(ends)
            for byte, to in arcs:
                keys.append((top - state) << 8 | byte)
                target.append(top - to)
                skip.append(before)
                before += behind[to]
        final = np.array([ends for ends, _ in reversed(frozen)], bool)
        return cls(np.array(keys, np.int64), np.array(target, np.int32), np.array(skip, np.int64), final)

    def ordinals(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Ordinals of the words ``text[starts:ends]`` (-1: not in the vocabulary); all words take a step at a time."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.keys):
            return out
        live, at, stop = np.arange(len(starts)), starts.copy(), ends
        state, total = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        while len(live):
            want = state << 8 | text[at]
            arc = np.searchsorted(self.keys, want)
            arc[arc == len(self.keys)] = 0
            there = self.keys[arc] == want
            live, arc, at, stop = live[there], arc[there], at[there] + 1, stop[there]
            state, total = self.target[arc].astype(np.int64), total[there] + self.skip[arc]
            over = at == stop
            ends_well = over & self.final[state]
            out[live[ends_well]] = total[ends_well]
            live, at, stop, state, total = live[~over], at[~over], stop[~over], state[~over], total[~over]
        return out

    def to_row(self) -> dict:
        return {"keys": self.keys.tobytes(), "target": self.target.tobytes(), "skip": self.skip.tobytes(), "final": self.final.tobytes()}

    @classmethod
    def from_row(cls, row: dict) -> Transducer:
        kinds = {"keys": np.int64, "target": np.int32, "skip": np.int64, "final": bool}
        return cls(**{name: np.frombuffer(row[name], kind) for name, kind in kinds.items()})


def normal(text: bytes | None) -> bytes:
    return (text or b"").translate(_NORMAL)


def word_places(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a normalised text begin and end."""
    letters = np.concatenate(([False], text != 32, [False]))
    edges = np.flatnonzero(letters[1:] != letters[:-1])
    return edges[::2], edges[1::2]


def _filled(docs: DataFrame) -> DataFrame:
    """``(lang, source, text)``, null as ``''``; texts as bytes."""
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))
    return docs.select(lang, source, F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents of the task each term of a language is."""

    def out() -> Iterator[pa.RecordBatch]:
        for lang, counts in seen.items():
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([lang] * len(counts), pa.string()), "term": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())}
            )
        seen.clear()

    seen: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            seen.setdefault(lang, Counter()).update(set(normal(text.as_py()).split()))
        if sum(map(len, seen.values())) > TASK_TERMS:
            yield from out()
    yield from out()


def vocabulary(docs: DataFrame, least_documents: int) -> DataFrame:
    """Terms of each language that at least so many of its documents (rows) have: ``(lang, term, ordinal)``, written.

    ``term`` holds UTF-8 bytes; ordinals count from 0 within a language in the order of these bytes. The order is made by
    a range partitioning: ranges are sorted each for itself, and only their sizes meet in one place.
    """
    found = _filled(docs).select("lang", "text").mapInArrow(_document_counts, "lang string, term binary, n long")
    kept = found.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least_documents)
    kept = cut(kept.select("lang", "term"), "terms")
    ranged = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").withColumn("range", F.spark_partition_id())
    ranged = cut(ranged, "ranges")
    sizes = ranged.groupBy("lang", "range").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("lang", "range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("lang", "range").orderBy("term")
    placed = ranged.withColumn("place", F.row_number().over(inside) - 1).join(sizes, ["lang", "range"])
    out = cut(placed.select("lang", "term", (F.col("base") + F.col("place")).alias("ordinal")), "vocabulary")
    release(kept)
    release(ranged)
    return out


_SHARD = "lang string, base long, keys binary, target binary, skip binary, final binary, bytes long"


def _shard(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("ordinal")
    made = Transducer.build(rows["term"]).to_row()
    out = {"lang": rows["lang"].iloc[0], "base": rows["ordinal"].iloc[0], **made, "bytes": sum(map(len, made.values()))}
    return pd.DataFrame([out])


def transducers(terms: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """One row for each shard of a vocabulary ``(lang, term, ordinal)``: its automaton and the ordinal of its first term."""
    shards = terms.withColumn("shard", F.floor(F.col("ordinal") / shard_terms))
    return cut(shards.groupBy("lang", "shard").applyInPandas(_shard, _SHARD), "transducers")


_loaded: dict[str, dict[str, list[tuple[int, Transducer]]]] = {}


def _count_terms(sent, key: str):
    """Texts streamed through the automata of their language: ``(lang, source, ordinal, n)``, combined for each batch."""

    def automata() -> dict[str, list[tuple[int, Transducer]]]:
        if key not in _loaded:
            _loaded.clear()
            by_lang: dict[str, list[tuple[int, Transducer]]] = {}
            for row in sent.value:
                by_lang.setdefault(row["lang"], []).append((row["base"], Transducer.from_row(row)))
            _loaded[key] = by_lang
        return _loaded[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = automata()
        for batch in batches:
            texts: dict[tuple[str, str], list[bytes]] = {}
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
                if lang in shards:
                    texts.setdefault((lang, source), []).append(normal(text.as_py()))
            for (lang, source), some in texts.items():
                ordinals = []
                for piece in _pieces(b" ".join(some)):
                    walked = np.frombuffer(piece, np.uint8)
                    starts, ends = word_places(walked)
                    for base, shard in shards[lang]:
                        found = shard.ordinals(walked, starts, ends)
                        ordinals.append(found[found >= 0] + base)
                which, n = np.unique(np.concatenate(ordinals) if ordinals else np.empty(0, np.int64), return_counts=True)
                if len(which):
                    yield pa.RecordBatch.from_pydict(
                        {"lang": pa.array([lang] * len(which), pa.string()), "source": pa.array([source] * len(which), pa.string()),
                         "ordinal": pa.array(which), "n": pa.array(n.astype(np.int64))}
                    )

    return run


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces that end at a space."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + WALK_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def term_counts(docs: DataFrame, shards: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """How often each source has each term of its language's vocabulary: ``(lang, source, ordinal, n)``, n > 0.

    The automata are broadcast in blocks of at most ``broadcast_bytes`` (or one automaton), by the sizes they have.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    sizes = shards.groupBy("lang", "base").agg(F.max("bytes").alias("bytes")).orderBy("lang", "base").toLocalIterator()
    blocks: list[list[tuple[str, int]]] = []
    room = 0
    for r in sizes:  # a row for each 100,000 terms
        if not blocks or r.bytes > room:
            blocks.append([])
            room = broadcast_bytes
        blocks[-1].append((r.lang, r.base))
        room -= r.bytes
    parts = []
    for block in blocks or [[]]:
        low, high = (block[0], block[-1]) if block else (("", -1), ("", -1))
        place = F.struct("lang", "base")
        rows = shards.where(place.between(*(F.struct(F.lit(a), F.lit(b).cast("long")) for a, b in (low, high))))
        sent = spark.sparkContext.broadcast([r.asDict() for r in rows.drop("bytes").collect()])
        parts.append(_filled(docs).mapInArrow(_count_terms(sent, uuid.uuid4().hex), "lang string, source string, ordinal long, n long"))
        if len(blocks) > 1:
            parts[-1] = cut(parts[-1].groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")), "counts")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return cut(every.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")), "counts")


def probability(n: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (n + 2) / (total + 2 * terms))`` in whole numbers of any size."""
    wide = (n.cast("decimal(28,0)") + 2) * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide, (total + 2 * terms).cast("decimal(38,0)")).cast("long")


def _divergence(p, q):
    return (p - q) * (p - q) // (p + q)


def _pair_sums(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums over one block of terms for all pairs of a source of one side and a source of the other."""
    first = rows.iloc[0]
    width, terms, low = int(first["width"]), int(first["terms"]), int(first["low"])
    heads = rows[rows["ordinal"] < 0]
    sides, tables = {}, {}
    for side in (int(first["left"]), int(first["right"])):
        own = heads[heads["side"] == side].sort_values("rank")
        sides[side] = own
        counts = np.zeros((len(own), width), np.int64)
        cells = rows[(rows["side"] == side) & (rows["ordinal"] >= 0)]
        counts[np.searchsorted(own["rank"].to_numpy(), cells["rank"].to_numpy()), cells["ordinal"].to_numpy() - low] = cells["n"].to_numpy()
        totals = own["total"].to_numpy()[:, None] + 2 * terms
        tables[side] = 1 + _scaled(counts + 2, totals)
    a, b = sides[int(first["left"])], sides[int(first["right"])]
    p, q = tables[int(first["left"])], tables[int(first["right"])]
    out = []
    for k in range(len(a)):
        value = _divergence(p[k][None, :], q).sum(1)
        out.append(pd.DataFrame({"lang": first["lang"], "a": a["rank"].iloc[k], "b": b["rank"].to_numpy(), "value": value}))
    done = pd.concat(out) if out else pd.DataFrame({"lang": [], "a": [], "b": [], "value": []})
    return done[done["a"] < done["b"]]


def _scaled(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """``SCALE * counts // totals`` without overflow for counts up to totals up to 2^62: in base 1000, three steps."""
    whole, rest = np.divmod(counts, totals)
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, totals)
        whole = whole * 1000 + step
    return whole


def source_divergence(docs: DataFrame, least_documents: int = 10, top_terms: int = 10) -> DataFrame:
    """Divergence of sources and of their terms, over ``docs(text, lang, source)``: ``(lang, source, part, item, value, rank)``.

    Null texts, languages and sources count as ``''``. A language keeps the terms that ``least_documents`` of its rows
    have. Every group (lang, source), even without terms, and every language give each kept term a smoothed probability
    in parts of ``SCALE``; the divergence of p and q is ``floor((p - q)^2 / (p + q))``. Part ``pair``: for each other
    source of the language the sum over all kept terms. Part ``term``: the terms that the source has and has oftener than
    its language, the first ``top_terms``. Ranks are by value, then UTF-8 item (terms: ordinal). Repeated rows count
    each; a language without kept terms has pairs of value 0; an empty table gives no rows; other columns are ignored.

    Comparisons go by blocks of terms and sources, so no task holds more than ``BLOCK_CELLS`` counts of either side.
    """
    terms = vocabulary(docs, least_documents)
    shards = transducers(terms)
    counts = term_counts(docs, shards)
    release(shards)

    sizes = terms.groupBy("lang").agg(F.count("*").alias("terms"))
    of = Window.partitionBy("lang")
    groups = _filled(docs).select("lang", "source").distinct()
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "terms"])
    groups = groups.withColumn("rank", F.row_number().over(of.orderBy("source")) - 1)
    groups = groups.withColumn("of_lang", F.sum("total").over(of)).withColumn("sources", F.count("*").over(of))
    groups = cut(groups.withColumn("side", F.floor(F.col("rank") / SIDE_SOURCES).cast("int")), "groups")

    # Pairs: each block of terms and two sides of sources make a group; heads say which sources there are.
    sided = F.least("sources", F.lit(SIDE_SOURCES))
    block = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_CELLS) / sided)).cast("long")
    last_side = F.floor((F.col("sources") - 1) / SIDE_SOURCES).cast("int")
    about = groups.withColumn("block", block).withColumn("last", last_side)
    blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("terms") / F.col("block")))
    heads = about.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    heads = heads.withColumn("ordinal", F.lit(-1).cast("long")).withColumn("n", F.lit(0).cast("long"))
    cells = counts.join(about.drop("total"), ["lang", "source"]).withColumn("part", F.floor(F.col("ordinal") / F.col("block")))
    cells = cells.withColumn("total", F.lit(0).cast("long"))
    every = heads.unionByName(cells.select(*heads.columns))
    other = F.explode(F.sequence(F.lit(0), F.col("last")))
    every = every.withColumn("other", other).withColumn("left", F.least("side", "other")).withColumn("right", F.greatest("side", "other"))
    low = F.col("part") * F.col("block")
    every = every.withColumn("low", low).withColumn("width", F.greatest(F.lit(0).cast("long"), F.least("block", F.col("terms") - low)))
    every = every.select("lang", "left", "right", "part", "side", "rank", "ordinal", "n", "total", "terms", "low", "width")
    pairs = every.groupBy("lang", "left", "right", "part").applyInPandas(_pair_sums, "lang string, a int, b int, value long")
    pairs = pairs.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = cut(pairs, "pairs")
    both = pairs.unionByName(pairs.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    names = groups.select("lang", "rank", "source")
    both = both.join(names.toDF("lang", "a", "source"), ["lang", "a"]).join(names.toDF("lang", "b", "item"), ["lang", "b"])
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "b")
    both = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))

    # Terms: against the counts of the whole language.
    whole = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("all_n"))
    facts = groups.select("lang", "source", "total", "terms", "of_lang")
    rated = counts.join(whole, ["lang", "ordinal"]).join(facts, ["lang", "source"])
    rated = rated.withColumn("p", probability(F.col("n"), F.col("total"), F.col("terms")))
    rated = rated.withColumn("q", probability(F.col("all_n"), F.col("of_lang"), F.col("terms"))).where("p > q")
    p, q = F.col("p"), F.col("q")
    rated = rated.select("lang", "source", "ordinal", F.call_function("div", (p - q) * (p - q), p + q).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "ordinal")
    rated = cut(rated.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top_terms), "top")
    rated = rated.join(terms, ["lang", "ordinal"])
    rated = rated.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")
    return both.unionByName(rated)
