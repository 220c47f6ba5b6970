"""Codes of vectors by parts (product quantisation) in whole numbers, with value dictionaries for each dimension.

Components become whole numbers once. Rows are kept in blocks, and a block holds, for each dimension, the sorted distinct
values (its dictionary) and every row's place in it. To find the nearest codebook entry, the squared differences of a
dimension's distinct values to all entries are tabulated; the distance of a part is then gathered from the tables of its
dimensions by dictionary codes and added up. All sums are of whole numbers, so results do not depend on the partitioning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import bounded_batches, cut, release

#: Rows that share a dictionary, and whose distances to all entries are held at once.
BLOCK_ROWS = 2_048
#: Components beyond this (after scaling) are refused: squared distances must fit 64 bits.
MOST = 1 << 26

_BLOCK = "ids array<bigint>, labels array<string>, dims int, sizes array<int>, dictionary binary, codes binary"


@dataclass
class Codebooks:
    """Entries of each part: a list of integer arrays (entries x dimensions of the part)."""

    parts: list[np.ndarray]

    def sha256(self) -> str:
        """Digest of all components as decimals, by part, entry and position."""
        return hashlib.sha256(",".join(str(x) for part in self.parts for x in part.ravel().tolist()).encode()).hexdigest()


class Block:
    """Rows with a dictionary for each dimension: ``values[d][codes[d]]`` are the components of dimension ``d``."""

    def __init__(self, values: list[np.ndarray], codes: np.ndarray):
        self.values, self.codes = values, codes

    @classmethod
    def of(cls, vectors: np.ndarray) -> Block:
        values, codes = [], np.empty(vectors.shape[::-1], np.int16)
        for d in range(vectors.shape[1]):
            distinct, place = np.unique(vectors[:, d], return_inverse=True)
            values.append(distinct)
            codes[d] = place
        return cls(values, codes)

    def nearest(self, first: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the part that begins at dimension ``first``: the nearest entry of each row (ties to the lower) and its squared distance."""
        rows = self.codes.shape[1]
        total = np.zeros((rows, len(entries)), np.int64)
        step = np.empty_like(total)
        for k in range(entries.shape[1]):
            table = (self.values[first + k][:, None] - entries[:, k][None, :]) ** 2
            np.take(table, self.codes[first + k], axis=0, out=step, mode="clip")
            total += step
        best = total.argmin(1)
        return best, total[np.arange(rows), best]

    def sums(self, first: int, width: int, best: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
        """How many rows have each entry, and the sums of their components: ``(counts, sums)``."""
        order = np.argsort(best, kind="stable")
        counts = np.bincount(best, minlength=entries)
        used = np.flatnonzero(counts)
        starts = (np.cumsum(counts) - counts)[used]
        sums = np.zeros((entries, width), np.int64)
        for k in range(width):
            sums[used, k] = np.add.reduceat(self.values[first + k][self.codes[first + k][order]], starts) if len(used) else 0
        return counts, sums


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def whole_numbers(flat: np.ndarray, scale: int) -> np.ndarray:
    out = np.floor(flat.astype(np.float64) * scale)
    if len(out) and np.abs(out).max() > MOST:
        raise ValueError(f"components of more than {MOST // scale} times {scale} are not supported")
    return out.astype(np.int64)


def _blocks(scale: int, dims: int):
    """Arrow batches of vectors as blocks of rows with dictionaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(start, BLOCK_ROWS)
                vectors = some.column("vector")
                if set(vectors.value_lengths().to_pylist()) - {dims}:
                    raise ValueError(f"a vector has not the {dims} dimensions of the first one")
                flat = vectors.flatten().to_numpy(zero_copy_only=False)
                block = Block.of(whole_numbers(flat, scale).reshape(-1, dims))
                row = {
                    "ids": some.column("id").to_pylist(),
                    "labels": some.column("label").to_pylist(),
                    "dims": dims,
                    "sizes": [len(v) for v in block.values],
                    "dictionary": (np.concatenate(block.values) if dims else np.empty(0, np.int64)).tobytes(),
                    "codes": block.codes.tobytes(),
                }
                yield pa.RecordBatch.from_pylist([row], schema=_ARROW)

    return run


_ARROW = pa.schema(
    [("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("dims", pa.int32()), ("sizes", pa.list_(pa.int32())),
     ("dictionary", pa.binary()), ("codes", pa.binary())]
)


def _read(row: dict) -> Block:
    ends = np.cumsum(row["sizes"], dtype=np.int64)
    values = np.split(np.frombuffer(row["dictionary"], np.int64), ends[:-1]) if row["dims"] else []
    return Block(values, np.frombuffer(row["codes"], np.int16).reshape(row["dims"], -1))


def _update(blocks: DataFrame, books: Codebooks) -> Codebooks:
    """One round: all parts go to their nearest entry, entries become the floor of the mean of their parts."""
    parts = books.parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(p), np.int64) for p in parts]
        sums = [np.zeros(p.shape, np.int64) for p in parts]
        for batch in batches:
            for row in batch.to_pylist():
                block = _read(row)
                for i, entries in enumerate(parts):
                    best, _ = block.nearest(i * entries.shape[1], entries)
                    n, s = block.sums(i * entries.shape[1], entries.shape[1], best, len(entries))
                    counts[i] += n
                    sums[i] += s
        for i, n in enumerate(counts):
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array(np.full(len(used), i), pa.int32()), "entry": pa.array(used, pa.int32()), "n": pa.array(n[used]),
                 "sums": pa.array(sums[i][used].tolist(), pa.list_(pa.int64()))}
            )

    found = blocks.select("dims", "sizes", "dictionary", "codes").mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")
    wide = found.select("part", "entry", "n", F.posexplode("sums").alias("at", "s"))
    total = wide.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    after = [p.copy() for p in parts]
    for r in total.collect():  # one row for each component of a codebook
        after[r.part][r.entry, r.at] = int(r.s) // r.n
    return Codebooks(after)


def _assign(blocks: DataFrame, books: Codebooks) -> DataFrame:
    parts = books.parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _read(row)
                rows = len(row["ids"])
                codes, error = np.empty((rows, len(parts)), np.uint8), np.zeros(rows, np.int64)
                for i, entries in enumerate(parts):
                    best, distance = block.nearest(i * entries.shape[1], entries)
                    codes[:, i] = best
                    error += distance
                yield pa.RecordBatch.from_pydict(
                    {"vec_id": pa.array(row["ids"], pa.int64()), "label": pa.array(row["labels"], pa.string()),
                     "code": pa.array([bytes(c).hex() for c in codes], pa.string()), "error": pa.array(error)}
                )

    return blocks.mapInArrow(run, "vec_id bigint, label string, code string, error bigint")


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, Codebooks]:
    """Code the ``embedding`` of every row of ``vectors(vec_id, embedding, label)``: ``(vec_id, label, code, error)`` and the codebooks.

    Vectors that are null or hold a null or a component that is not finite are left out. A component ``x`` counts as
    ``floor(scale * x)``. A vector is cut into ``parts`` equal parts with a codebook each. A codebook starts as the part
    of the ``entries`` (at most 256) rows with the smallest ``vec_id`` (null last, ties by the vector), all of them if
    there are fewer; ``rounds`` times every part is given to its nearest entry (ties to the lower) and used entries become
    the floored mean of their parts; then parts are given out again. ``code`` has two hex digits for each part, ``error``
    is the squared distance. Labels come back as text.

    Repeated rows each have their row. Columns of other names are ignored. Vectors of unequal length, a length that
    ``parts`` does not divide, or components beyond ``MOST`` are errors. An empty table gives no rows and no entries.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes of a part have one byte: 1 to 256 entries")
    spark = vectors.sparkSession
    bounded_batches(spark)
    kept = vectors.where(usable(F.col("embedding")))
    first = kept.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    dims = len(first[0].embedding) if first else 0
    if dims % parts or any(len(r.embedding) != dims for r in first):
        raise ValueError(f"vectors must have one length that {parts} divides")
    start = whole_numbers(np.array([r.embedding for r in first], np.float64).reshape(len(first), dims), scale)
    books = Codebooks(np.split(start, parts, axis=1))
    rows = kept.select(F.col("vec_id").cast("bigint").alias("id"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("vector"))
    blocks = cut(rows.mapInArrow(_blocks(scale, dims), _BLOCK), "blocks")
    for _ in range(rounds):
        books = _update(blocks, books)
    coded = cut(_assign(blocks, books), "codes")
    release(blocks)
    return coded, books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``label_error``: the errors summed over the rows of each label; rows without a label are one label.

    Sums are combined before the shuffle. The table of labels is written, so Spark sees its size, and broadcasts it only
    below its own limit.
    """
    totals = cut(coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")), "labels")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
