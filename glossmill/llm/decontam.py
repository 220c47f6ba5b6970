"""Benchmark decontamination with one Aho-Corasick automaton over the windows of the benchmark's items."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import bounded_batches, boxed, cut

#: Characters of benchmark text in one automaton (its windows overlap, so it holds about ten times as many). A larger
#: benchmark is scanned for in blocks, each of which is broadcast and built in turn.
BLOCK_CHARS = 500_000

_HITS, _SPANS = "array<struct<first:bigint,last:bigint>>", "array<struct<start:bigint,end:bigint>>"
_FOUND = f"n_words long, n_hit long, items array<string>, hits {_HITS}, spans {_SPANS}"
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_WORD = r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"
_WORDS = re.compile(_WORD)
_built: dict[str, ahocorasick.Automaton] = {}


def words_of(text: bytes | None) -> list[bytes]:
    """Normalised words: A-Z lower-cased, then runs of letters, digits and anything beyond ASCII."""
    return (text or b"").translate(_NORMAL).split()


def item_windows(items: list[tuple[str, bytes | None]], window: int) -> dict[bytes, tuple[int, list[str]]]:
    """Windows of the items: text -> (words, ids of the items that have it). A shorter item is one window."""
    out: dict[bytes, tuple[int, list[str]]] = {}
    for name, text in items:
        words = words_of(text)
        for k in range(max(1, len(words) - window + 1) if words else 0):
            piece = words[k : k + window]
            ids = out.setdefault(b" ".join(piece), (len(piece), []))[1]
            if name not in ids:
                ids.append(name)
    return out


def _automaton(key: str, windows: dict[bytes, tuple[int, list[str]]]) -> ahocorasick.Automaton:
    """The automaton of a broadcast block; a worker keeps the one it built last."""
    if key not in _built:
        _built.clear()
        made = ahocorasick.Automaton()
        for text, value in windows.items():
            made.add_word(f" {text.decode('latin-1')} ", value)
        if len(made):
            made.make_automaton()
        _built[key] = made
    return _built[key]


def _merge(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Intervals of words, joined where they touch."""
    out: list[list[int]] = []
    for first, last in sorted(hits):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def scan(text: bytes | None, automaton: ahocorasick.Automaton) -> dict:
    """One pass over a document."""
    words = words_of(text)
    hits: set[tuple[int, int]] = set()
    items: set[str] = set()
    if words and len(automaton):
        found = list(automaton.iter(f" {b' '.join(words).decode('latin-1')} "))
        if found:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            lasts = np.searchsorted(ends, [end for end, _ in found]).tolist()
            hits.update((last - size + 1, last) for last, (_, (size, _)) in zip(lasts, found, strict=True))
            for _, (_, ids) in found:
                items.update(ids)
    merged = _merge(list(hits))
    spans = []
    if merged:  # back to the characters of the original
        at = [m.span() for m in _WORDS.finditer(text.decode("utf-8", "replace"))]
        spans = [{"start": at[a][0], "end": at[b][1]} for a, b in merged]
    return {
        "n_words": len(words),
        "n_hit": sum(b - a + 1 for a, b in merged),
        "items": sorted(items),
        "hits": [{"first": a, "last": b} for a, b in merged],
        "spans": spans,
    }


def combine(parts: list[dict]) -> dict:
    """What several blocks of the benchmark found in one document, as one finding."""
    starts = {h["first"]: s["start"] for p in parts for h, s in zip(p["hits"], p["spans"], strict=True)}
    ends = {h["last"]: s["end"] for p in parts for h, s in zip(p["hits"], p["spans"], strict=True)}
    merged = _merge([(h["first"], h["last"]) for p in parts for h in p["hits"]])
    return {
        "n_words": parts[0]["n_words"],
        "n_hit": sum(b - a + 1 for a, b in merged),
        "items": sorted({x for p in parts for x in p["items"]}),
        "hits": [{"first": a, "last": b} for a, b in merged],
        "spans": [{"start": starts[a], "end": ends[b]} for a, b in merged],
    }


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with a struct column ``found``: words, hit words, item ids, and hits as words and as characters.

    ``benchmark(item_id, text)`` is measured first; each block of it that is broadcast holds about ``block_chars``
    characters, and beyond one block the texts are read and scanned once for each. Only findings are written between
    blocks, and joined to the documents at the end. Null texts have no words; null item ids count as ``''``; repeated
    items count once. Whole documents are scanned. A column ``found`` of ``docs`` is replaced; repeated rows all come
    back; an empty benchmark finds nothing.
    """
    rows = _found(docs, benchmark, window, block_chars)
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "found"], "found")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark; all columns stay, whatever their names.

    Nulls, repeated rows and empty tables as in :func:`find_benchmark`.
    """
    return _found(docs, benchmark, window, BLOCK_CHARS).where("found.n_hit = 0").select("row.*")


def _found(docs: DataFrame, benchmark: DataFrame, window: int, block_chars: int) -> DataFrame:
    """``(row, found)``: the rows of ``docs`` as structs and what was found in each."""
    spark = docs.sparkSession
    bounded_batches(spark)
    chars = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    text = F.col("text").cast("binary")
    columns = []
    for block in range(blocks):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = rows.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("text").cast("binary")).collect()
        windows = item_windows([(a, bytes(b) if b is not None else None) for a, b in rows], window)
        scanned = _scan_column(spark.sparkContext.broadcast(windows))
        if blocks == 1:
            return docs.select(boxed(docs).alias("row"), scanned(text).alias("found"))
        own = docs.select(F.sha2(text, 256).alias("key"), scanned(text).alias("found")).where("found.n_hit > 0")
        columns.append(cut(own.dropDuplicates(["key"]), "findings"))
    parts = reduce(DataFrame.unionByName, columns).groupBy("key").agg(F.collect_list("found").alias("parts"))
    parts = cut(parts.select("key", _combined(F.col("parts")).alias("all")), "found")
    rows = docs.select(boxed(docs).alias("row"), F.sha2(text, 256).alias("of"))
    none = F.struct(
        F.coalesce(F.regexp_count(F.col("row.text"), F.lit(_WORD)), F.lit(0)).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
        *[F.array().cast(kind).alias(name) for name, kind in (("items", "array<string>"), ("hits", _HITS), ("spans", _SPANS))],
    )
    return rows.join(parts, F.col("of") == F.col("key"), "left").select("row", F.coalesce("all", none).alias("found"))


def _frame(rows: Iterator[dict]) -> pd.DataFrame:
    return pd.DataFrame.from_records(list(rows), columns=["n_words", "n_hit", "items", "hits", "spans"])


def _scan_column(sent):
    key = uuid.uuid4().hex

    @F.pandas_udf(_FOUND)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(key, sent.value)
        for texts in batches:
            yield _frame(scan(x, automaton) for x in texts)

    return run


def _combined(parts: Column) -> Column:
    @F.pandas_udf(_FOUND)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in batches:
            yield _frame(combine(list(p)) for p in some)

    return run(parts)
