"""Removal of line runs that are copied from elsewhere, by a suffix array over line-ID sequences.

Every document is the sequence of the IDs of its lines with words. The suffixes of all sequences are ranked by prefix
doubling: ranks by the first ``2 ** k`` lines give ranks by the first ``2 ** (k + 1)``, as the pair of a suffix's rank
and that of the suffix ``2 ** k`` lines on. Suffixes with the same first ``m`` lines form the LCP interval of that
length; two overlapping ranks of blocks of ``2 ** k`` lines name it for any ``m`` between ``2 ** k`` and ``2 ** (k + 1)``.
A run is a copy where its interval has an earlier member.

A run counts from ``min_words`` words on. Of a longer copied run all lines are covered by the shortest runs of so many
words that start, and those that end, at each of its lines, so ranks are needed no deeper than ``min_words`` lines.

Only built-in functions are used. Lines that occur once in the whole corpus end all runs and leave the work at once, so
do short stretches of repeated lines. Counts are combined before they are shuffled; joins are by equality, and AQE can
split them at lines and runs that very many documents share.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossmill.llm.common import WORD, boxed, cut, release

_DOC = ("doc_id", "tk")


def text_key(text: Column) -> Column:
    """Tells rows with one doc_id and different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_table(docs: DataFrame) -> DataFrame:
    """Lines with words of ``docs(doc_id, text)``: ``(doc_id, tk, o, line, h, h2, w)``.

    ``o`` counts the lines with words of a document, ``line`` all its lines, from 0; ``h, h2`` are 96 bits of hash of
    the whole line and ``w`` its words.
    """
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("line"), x.alias("s")))
    lines = F.filter(lines, lambda x: x["s"].rlike(WORD))
    at = docs.select("doc_id", text_key(F.col("text")).alias("tk"), F.posexplode(lines).alias("o", "l"))
    return at.select(
        *_DOC,
        "o",
        F.col("l.line").alias("line"),
        F.xxhash64("l.s").alias("h"),
        F.hash("l.s").alias("h2"),
        F.regexp_count(F.col("l.s"), F.lit(WORD)).cast("long").alias("w"),
    )


def _sum_before(rows: DataFrame, by: list[str], order: list[str], place: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``n`` over the rows before each, inside ``by`` and in ``order``.

    ``place`` cuts the order into slices. The sum is taken inside a slice, and shifted by the totals of the slices before.
    """
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("slice", place)
    shift = rows.groupBy(*by, "slice").agg(F.sum("n").alias("s"))
    shift = shift.select(*by, "slice", F.coalesce(F.sum("s").over(before.partitionBy(*by).orderBy("slice")), F.lit(0)).alias("shift"))
    ahead = F.coalesce(F.sum("n").over(before.partitionBy(*by, "slice").orderBy(*order)), F.lit(0))
    out = rows.withColumn("ahead", ahead).join(shift if by else F.broadcast(shift), [*by, "slice"])
    return out.withColumn(name, F.col("shift") + F.col("ahead")).drop("slice", "shift", "ahead")


def _first_ranks(counts: DataFrame) -> DataFrame:
    """``counts(h, h2, n)`` with the rank ``r0`` of each line: 1 and all occurrences of smaller lines.

    The hash's range is cut into 4,096 slices.
    """
    ranked = _sum_before(counts, [], ["h", "h2"], F.shiftright("h", 52), "below")
    return ranked.select("h", "h2", (1 + F.col("below")).alias("r0"))


def _stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """Stretches of repeated lines of at least ``min_words`` words, with the shortest runs at each line.

    ``p`` and ``c`` count the stretch's words before a line and with it. The run that starts at a line and just reaches
    ``min_words`` has the lines whose ``p`` is less than ``min_words`` above its own; the run that ends at a line has
    those whose ``c`` is less than ``min_words`` below its own. ``ls`` and ``le`` are their lengths, 0 if there is none.
    """
    doc = Window.partitionBy(*_DOC).orderBy("o")
    once = lines.dropDuplicates([*_DOC, "o"])  # rows repeated in full are one document
    rows = once.withColumn("part", F.col("o") - F.row_number().over(doc))
    part = Window.partitionBy(*_DOC, "part")
    rows = rows.withColumn("all_words", F.sum("w").over(part)).where(F.col("all_words") >= min_words)
    rows = rows.withColumn("c", F.sum("w").over(part.orderBy("o"))).withColumn("p", F.col("c") - F.col("w"))
    on, back = _frames(min_words)
    starts = F.max("c").over(on) - F.col("p") >= min_words
    ends = F.col("c") - F.min("p").over(back) >= min_words
    return rows.select(
        *_DOC, "part", "o", "line", "c", "p", "r0",
        F.when(starts, F.count("*").over(on)).otherwise(0).alias("ls"),
        F.when(ends, F.count("*").over(back)).otherwise(0).alias("le"),
    )


def _frames(min_words: int):
    part = Window.partitionBy(*_DOC, "part")
    return part.orderBy("p").rangeBetween(0, min_words - 1), part.orderBy("c").rangeBetween(1 - min_words, 0)


#: Slices into which the continuations of one rank are cut.
_SLICES = 256


def _double(rows: DataFrame, k: int, top: int) -> DataFrame:
    """Ranks by ``2 ** (k + 1)`` lines, ``r{k+1}``, from those by ``2 ** k``; ``top`` is the greatest rank.

    The distinct pairs of ranks are counted first and ordered inside the rank they refine, so a rank that many suffixes
    share costs as many rows there as it has different continuations, and these are cut into slices. Stretches without
    runs of so many lines keep out.
    """
    old, new, deep = f"r{k}", f"r{k + 1}", 2 ** (k + 1)
    step = Window.partitionBy(*_DOC, "part").orderBy("o")
    active = rows.where(F.col("deepest") >= deep).withColumn("then", F.coalesce(F.lead(old, 2**k).over(step), F.lit(0)))
    active = cut(active, "pairs")
    pairs = active.groupBy(old, "then").agg(F.count("*").alias("n"))
    pairs = _sum_before(pairs, [old], ["then"], F.floor(F.col("then") * (_SLICES / (top + 1))), "below")
    pairs = pairs.select(old, "then", (F.col(old) + F.col("below")).alias(new))
    idle = rows.where(F.col("deepest") < deep).withColumn(new, F.lit(None).cast("long"))
    return active.join(pairs, [old, "then"]).drop("then").unionByName(idle)


def copied_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Line ranges of ``docs(doc_id, text)`` that copy an earlier run: ``(doc_id, tk, cuts)``.

    ``cuts`` are disjoint ranges ``(from, to)`` of line numbers, in order; documents without any are left out. Earlier
    is by doc_id (null last), then the hash of the text, then the place in the document. A run that overlaps the first
    one inside a document does not count as its copy, so the first one stays whole.
    """
    lines = cut(line_table(docs), "lines")
    counts = lines.groupBy("h", "h2").agg(F.count("*").alias("n")).where("n > 1")
    repeated = lines.join(_first_ranks(counts), ["h", "h2"])
    rows = _stretches(repeated, min_words)
    deepest = F.max(F.greatest("ls", "le")).over(Window.partitionBy(*_DOC, "part"))
    rows = cut(rows.withColumn("deepest", deepest), "stretches")
    release(lines)
    longest, top = rows.agg(F.max("deepest"), F.max("r0")).first()
    levels = int(math.log2(longest or 1))
    for k in range(levels):
        after = cut(_double(rows, k, top), "ranks")
        release(rows)
        rows = after

    # The interval of a run: its length, and the ranks of its first and its last block of 2 ** k lines.
    step = Window.partitionBy(*_DOC, "part").orderBy("o")
    for k in range(levels + 1):
        rows = rows.withColumn(f"b{k}", F.lag(f"r{k}", 2**k - 1).over(step))

    def by_length(length: str, of) -> Column:
        return F.coalesce(*[F.when(F.col(length) >= 2**k, of(k)) for k in range(levels, -1, -1)])

    on, back = _frames(min_words)
    runs = rows.select(
        *_DOC,
        F.array(
            F.struct(
                F.col("o").cast("long").alias("o"), F.col("ls").alias("m"),
                F.col("line").alias("from"), F.max("line").over(on).alias("to"),
                by_length("ls", lambda k: F.col(f"r{k}")).alias("x"),
                by_length("ls", lambda k: F.last(f"b{k}").over(on)).alias("y"),
            ),
            F.struct(
                (F.col("o") - F.col("le") + 1).alias("o"), F.col("le").alias("m"),
                F.min("line").over(back).alias("from"), F.col("line").alias("to"),
                by_length("le", lambda k: F.first(f"r{k}").over(back)).alias("x"),
                by_length("le", lambda k: F.col(f"b{k}")).alias("y"),
            ),
        ).alias("both"),
    )
    runs = runs.select(*_DOC, F.explode("both").alias("run")).select(*_DOC, "run.*").where("m > 0")
    runs = cut(runs.withColumn("at", F.struct(F.col("doc_id").isNull().alias("none"), *_DOC, "o")), "runs")
    first = runs.groupBy("m", "x", "y").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first != last")
    first = cut(first.drop("last"), "firsts")  # an aggregate right under the join would keep AQE from splitting it
    copies = runs.join(first, ["m", "x", "y"])
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tk") == F.col("first.tk"))
    copies = copies.where((F.col("at") > F.col("first")) & ~(same & (F.col("o") < F.col("first.o") + F.col("m"))))

    # Overlapping and touching ranges become one.
    doc = Window.partitionBy(*_DOC).orderBy("from", "to")
    before = F.max("to").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    ranges = copies.select(*_DOC, "from", "to").distinct().withColumn("new", F.coalesce(F.col("from") > before + 1, F.lit(True)))
    ranges = ranges.withColumn("block", F.sum(F.col("new").cast("int")).over(doc))
    merged = ranges.groupBy(*_DOC, "block").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    return merged.groupBy(*_DOC).agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("cuts"))


def drop_copied_runs(docs: DataFrame, min_words: int = 50, report: bool = False) -> DataFrame:
    """``docs`` without the lines of runs of at least ``min_words`` words that copy an earlier run.

    All other columns and all other lines, blank ones included, stay as they are. A document that loses all its lines
    with words is dropped; documents that had none are kept. With ``report``, all rows stay, with the number of lines
    with words, before and deleted, as ``n_lines`` and ``n_deleted`` beside all columns of ``docs`` (which must not have
    these two). Null texts have no lines; rows repeated in full are treated as one and all come back.
    """
    cuts = cut(copied_runs(docs, min_words), "cuts").withColumnsRenamed({"doc_id": "cut_id", "tk": "cut_key"})
    rows = docs.select(boxed(docs).alias("row"), F.col("doc_id").alias("id"), text_key(F.col("text")).alias("row_key"))
    rows = rows.join(
        cuts.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("cut_id")) & (F.col("row_key") == F.col("cut_key")), "left"
    )
    kept = F.expr(
        "transform(sequence(0, size(cuts)), k -> slice(split(row.text, '\\n', -1), IF(k = 0, 1, cuts[k - 1].to + 2),"
        " IF(k = size(cuts), size(split(row.text, '\\n', -1)), cuts[k].from) - IF(k = 0, 0, cuts[k - 1].to + 1)))"
    )
    rows = rows.withColumn("kept", F.when(F.col("cuts").isNotNull(), F.array_join(F.flatten(kept), "\n")).otherwise(F.col("row.text")))

    def with_words(text: str) -> Column:
        lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
        return F.coalesce(F.when(F.col(text).isNotNull(), F.size(lines)), F.lit(0)).cast("long")

    counts = []
    if report:
        counts = [with_words("row.text").alias("n_lines"), (with_words("row.text") - with_words("kept")).alias("n_deleted")]
    else:
        rows = rows.where(F.col("cuts").isNull() | F.col("kept").rlike(WORD))
    columns = [F.col("kept").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    return rows.select(*columns, *counts)
