"""Toxicity by a factorization machine over hashed terms.

A document's terms are its words and the beginnings of its words, hashed into buckets; a term is there or not. The
machine adds a weight for each term and, for each pair of terms, the product of their factors, so that an insult beside
the mention of a group can weigh more than either, which no sum of weights expresses.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import bounded_batches, boxed, cut

#: Labelled rows the machine is fitted on, at most so many of each class (those with the smallest hash of their id).
SAMPLE_ROWS = 12_000
#: Buckets of the hash, and the most buckets that become terms of the machine.
BUCKETS, TERMS = 1 << 20, 4_096
#: Least likelihood-ratio statistic between a bucket and the label for it to become a term.
LEAST_G = 18.0
_PREFIXES = (4, 5, 6)
_MEMO = 200_000
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def buckets_of(word: bytes) -> list[int]:
    """Hash buckets of a word and of its first four, five and six bytes."""
    parts = [b"w" + word, *(b"%d" % k + word[:k] for k in _PREFIXES if len(word) >= k)]
    return [zlib.crc32(x) % BUCKETS for x in parts]


def document_buckets(text: bytes | None) -> set[int]:
    return {b for word in set((text or b"").translate(_NORMAL).split()) for b in buckets_of(word)}


class FactorizationMachine:
    """Binary second-order factorization machine on sets of term numbers; ``slot`` maps hash buckets to terms."""

    def __init__(self, slot: dict[int, int], bias: float, weights: np.ndarray, factors: np.ndarray):
        self.slot, self.bias, self.weights, self.factors = slot, bias, weights, factors
        self._memo: dict[bytes, tuple[int, ...]] = {}

    @staticmethod
    def _sums(rows: np.ndarray, weights: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = factors[rows]
        total = own.sum(1)
        return weights[rows].sum(1) + 0.5 * ((total**2).sum(-1) - (own**2).sum((1, 2))), own, total

    @classmethod
    def fit(
        cls, slot: dict[int, int], rows: list[np.ndarray], labels: np.ndarray, rank: int = 8, epochs: int = 12, seed: int = 7
    ) -> FactorizationMachine:
        """Adagrad on the log loss. With one class only, or none, the machine is its prior."""
        terms = len(slot)
        positives = float(labels.sum())
        prior = np.log((positives + 0.5) / (len(labels) - positives + 0.5)) if len(labels) else -30.0
        draw = np.random.default_rng(seed)
        weights, factors = np.zeros(terms + 1), draw.normal(0, 0.02, (terms + 1, rank))
        factors[terms] = 0  # the padding of short rows
        bias, seen_w, seen_f, seen_b = float(prior), np.full(terms + 1, 1e-6), np.full((terms + 1, rank), 1e-6), 1e-6
        if terms and 0 < positives < len(labels):
            by_length = sorted(range(len(rows)), key=lambda i: len(rows[i]))
            batches = [by_length[i : i + 256] for i in range(0, len(rows), 256)]
            for _ in range(epochs):
                for k in draw.permutation(len(batches)):
                    some = batches[k]
                    width = max(1, max(len(rows[i]) for i in some))
                    block = np.full((len(some), width), terms)
                    for j, i in enumerate(some):
                        block[j, : len(rows[i])] = rows[i]
                    raw, own, total = cls._sums(block, weights, factors)
                    error = (1 / (1 + np.exp(-np.clip(raw + bias, -30, 30))) - labels[some]) / len(some)
                    slope_w, slope_f = np.zeros_like(weights), np.zeros_like(factors)
                    np.add.at(slope_w, block, error[:, None])
                    np.add.at(slope_f, block, error[:, None, None] * (total[:, None, :] - own))
                    slope_w += 1e-6 * weights
                    slope_f += 1e-5 * factors
                    slope_w[terms] = slope_f[terms] = 0
                    seen_w += slope_w**2
                    seen_f += slope_f**2
                    seen_b += error.sum() ** 2
                    weights -= 0.1 * slope_w / np.sqrt(seen_w)
                    factors -= 0.05 * slope_f / np.sqrt(seen_f)
                    bias -= 0.05 * error.sum() / np.sqrt(seen_b)
        return cls(slot, bias, weights[:terms], factors[:terms])

    def terms_of(self, text: bytes | None) -> set[int]:
        memo, slot, out = self._memo, self.slot, set()
        for word in set((text or b"").translate(_NORMAL).split()):
            found = memo.get(word)
            if found is None:
                if len(memo) >= _MEMO:
                    memo.clear()
                found = memo[word] = tuple(slot[b] for b in buckets_of(word) if b in slot)
            if found:
                out.update(found)
        return out

    def scores(self, texts: Iterable[bytes | None]) -> np.ndarray:
        """Probabilities of label 1, by one sparse product a batch. A text without any known term has the prior's."""
        rows = [list(self.terms_of(x)) for x in texts]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        raw = np.full(len(rows), self.bias)
        full = np.flatnonzero(sizes)
        if len(full):
            terms = np.fromiter((t for r in rows for t in r), np.int64, int(sizes.sum()))
            starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
            own = self.factors[terms]
            pairs = (np.add.reduceat(own, starts) ** 2).sum(1) - np.add.reduceat((own**2).sum(1), starts)
            raw[full] += np.add.reduceat(self.weights[terms], starts) + 0.5 * pairs
        return 1 / (1 + np.exp(-np.clip(raw, -30.0, 30.0)))

    def score(self, text: bytes | None) -> float:
        return float(self.scores([text])[0])


def held_out(doc_id: Column) -> Column:
    """Rows that nothing learns from: CRC-32 of the id as text leaves 2 when divided by 4. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnable(labels: DataFrame) -> DataFrame:
    """Labels that may be learned from, a row for each id: ``(doc_id, label)``; held-out and null ids are not among them.

    A document labelled twice is toxic if one label says so.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))


def sampling_offset(labels: DataFrame, most: int = SAMPLE_ROWS) -> float:
    """What a sample cut to ``most`` rows of each class adds to the log odds of label 1; 0 while no class is cut."""
    sizes = {r["label"]: r["n"] for r in learnable(labels).groupBy("label").agg(F.count("*").alias("n")).collect()}
    kept = {k: min(n, most) / n for k, n in sizes.items()}
    return float(np.log(kept.get(1, 1.0) / kept.get(0, 1.0)))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``most`` labelled rows of each class with their text: ``(text binary, label int)``.

    Labels are those of :func:`learnable`; of several rows with one id the text with the smallest hash counts. At most
    ``2 * most`` ids are broadcast.
    """
    known = learnable(labels)
    order = F.xxhash64("doc_id")
    some = [known.where(F.col("label") == k).orderBy(order, "doc_id").limit(most) for k in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(some[0].unionByName(some[1])), "doc_id")
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), text.alias("text"))).alias("t"), F.first("label").alias("label"))
    return rows.select("t.text", "label")


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> FactorizationMachine:
    """Fit a machine on a bounded sample of the labelled rows that are not held out.

    Which hash buckets become terms is decided by their association with the label over the sample, counted in Spark.
    Classes that the sample cuts by different rates would shift the scores; the bias takes that back, so they mean the
    same at every size. Without any label every score is next to 0.
    """
    bounded_batches(docs.sparkSession)
    rows = cut(labelled_sample(docs, labels, most), "labelled")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for label, texts in part.groupby("label")["text"]:
                found = np.fromiter((b for x in texts for b in document_buckets(x)), np.int64)
                bucket, n = np.unique(found, return_counts=True)
                yield pd.DataFrame({"bucket": bucket, "neg": n * (label == 0), "pos": n * (label == 1)})

    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pos, neg = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    slot: dict[int, int] = {}
    if pos and neg:
        sums = rows.mapInPandas(count, "bucket long, neg long, pos long").groupBy("bucket").agg(F.sum("neg").alias("n"), F.sum("pos").alias("p"))

        def part(cell: Column, expected: Column) -> Column:
            return F.when(cell > 0, cell * F.log(cell / expected)).otherwise(0.0)

        both, every = F.col("p") + F.col("n"), pos + neg
        statistic = 2 * (
            part(F.col("p"), both * (pos / every))
            + part(F.col("n"), both * (neg / every))
            + part(pos - F.col("p"), (every - both) * (pos / every))
            + part(neg - F.col("n"), (every - both) * (neg / every))
        )
        best = sums.where(both < every).withColumn("g", statistic).where(F.col("g") >= LEAST_G)
        slot = {r["bucket"]: i for i, r in enumerate(best.orderBy(F.desc("g"), "bucket").limit(TERMS).collect())}

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            terms = [sorted(slot[b] for b in document_buckets(x) if b in slot) for x in part["text"]]
            yield pd.DataFrame({"terms": terms, "label": part["label"]})

    train = rows.mapInPandas(reduce, "terms array<int>, label int").collect()
    train.sort(key=lambda r: (r["label"], r["terms"]))
    machine = FactorizationMachine.fit(slot, [np.array(r["terms"], int) for r in train], np.array([r["label"] for r in train], float))
    machine.bias -= sampling_offset(labels, most)
    return machine


def _scores(spark, model: FactorizationMachine, text: Column) -> Column:
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast((model.slot, model.bias, model.weights, model.factors))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = FactorizationMachine(*sent.value)
        for texts in batches:
            yield pd.Series(machine.scores(texts), dtype=float)

    return run(text.cast("binary"))


def score(docs: DataFrame, model: FactorizationMachine, name: str = "score") -> DataFrame:
    """``docs`` with the probability that its whole text is toxic, as the column ``name``, which it replaces if there.

    Null and empty texts have the prior's. Every row comes back.
    """
    return docs.withColumn(name, _scores(docs.sparkSession, model, F.col("text")))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay, whatever their names."""
    model = fit(docs, labels)
    rows = docs.select(boxed(docs).alias("row"), _scores(docs.sparkSession, model, F.col("text")).alias("toxic"))
    return rows.where(F.col("toxic") < threshold).select("row.*")
