"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, repeated up to ``max_epochs`` times. A copy's virtual finish
time is the number of words its source has sent up to and including it, divided by the source's weight. All copies are
ordered by finish time over all sources and the order is cut where the total budget is used up.

Only built-in functions are used. Running sums are taken in two steps (totals of slices, then sums inside a slice), so
neither a source with a third of all rows nor the global order ends up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossmill.llm.common import WORD, cut

#: Rows aimed at in a slice of the shuffled order of a source, and in a range of the global order.
SLICE_ROWS, RANGE_ROWS = 5_000, 10_000
#: Sources up to which their table is broadcast.
BROADCAST_SOURCES = 10_000


def count_words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sized: DataFrame, weights: tuple[float, ...], share: float, max_epochs: int
) -> tuple[DataFrame, float | None]:
    """Targets of the sources of ``sized(source, size)``: ``(source, rank, weight, source_size, target)``, and the level.

    Sources are ordered by code point, null last, and take the weights in turn. They share ``share`` of all sizes by
    weight; no target exceeds ``max_epochs`` times its source's size, and what is above goes to the others by weight.
    The shares are those of a water level: ``target = least(max_epochs * size, weight * level)``; it is None if every
    source gives all it has. The table of sources is a dimension (one row each); it is all that a single task orders.
    """
    every = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("rank", F.row_number().over(every))
    sources = sources.withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    sources = sources.withColumn("most", (F.col("source_size") * max_epochs).cast("double"))
    # Sources fill up in the order of most / weight; the level is found at the first that the budget leaves short.
    before = Window.orderBy(F.col("most") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    level = (
        sources.withColumn("budget", F.sum("source_size").over(total) * share)
        .withColumn("full", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .where(F.col("full") + F.col("open") * F.col("most") / F.col("weight") >= F.col("budget"))
        .agg(F.min_by((F.col("budget") - F.col("full")) / F.col("open"), F.struct(F.col("most") / F.col("weight"), "rank")))
        .first()[0]
    )
    target = F.col("most") if level is None else F.least("most", F.col("weight") * F.lit(level))
    return sources.select("source", "rank", "weight", "source_size", target.alias("target")), level


def _slice_of(spread: Column, rows: Column) -> Column:
    """The slice of an evenly spread 32-bit key among as many as hold about ``SLICE_ROWS`` of so many rows, in order."""
    return F.floor(spread * F.ceil(rows / SLICE_ROWS) / (1 << 32)).cast("long")


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: int = 2,
    seed: str = "mix",
) -> DataFrame:
    """Decide how many words of every row of ``docs(doc_id, text, source)`` the mix takes.

    Returns ``(doc_id, source, size, source_size, target, taken)``, a row for each input row; ``taken`` is 0 or a
    multiple of ``size`` up to ``max_epochs`` times. The shuffle is by the MD5 of the seed, the doc_id and the text, so
    reruns agree; ties fall to the doc_id and the size, and rows alike in all of them are interchangeable. Null texts have
    size 0, null sources are one source, and rows of size 0 are never taken. ``doc_id`` may have any type that can be
    ordered; other columns are ignored. An empty table gives an empty result.
    """
    # Rows that share an id are spread by their texts too, so no slice fills with them unless they are alike in both.
    name = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5("text"))
    sized = cut(docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), F.md5(name).alias("r")), "sizes")
    counts = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    counts = cut(counts, "sources")
    rows, words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    targets, level = source_targets(counts, weights, share, max_epochs)
    budget = words * share

    # Words of a source up to each document: totals of the slices of its shuffled order, then sums inside a slice. A
    # source is cut by the number of its own rows.
    of = targets.join(counts.select(F.col("source").alias("c"), "n"), F.col("source").eqNullSafe(F.col("c"))).drop("c")
    of = cut(of.withColumnRenamed("source", "s"), "targets")
    of = F.broadcast(of) if of.count() <= BROADCAST_SOURCES else of
    spread = F.conv(F.substring("r", 1, 8), 16, 10).cast("long")
    sliced = sized.join(of, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("part", _slice_of(spread, F.col("n")))
    parts = sliced.groupBy("rank", "part").agg(F.sum("size").alias("in_part"))
    ahead = Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("offset", F.coalesce(F.sum("in_part").over(ahead), F.lit(0))).drop("in_part")
    inside = Window.partitionBy("rank", "part").orderBy("r", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = sliced.withColumn("run", F.sum("size").over(inside)).join(parts, ["rank", "part"])
    queued = cut(
        queued.select(
            "doc_id", "source", "size", "r", "rank", "weight", "source_size", "target", (F.col("offset") + F.col("run")).alias("sent")
        ),
        "queues",
    )

    # The global order of all copies by finish time, in ranges of equal width, and the range where the budget ends.
    def finish(epoch: Column) -> Column:
        return (epoch * F.col("source_size") + F.col("sent")) / F.col("weight")

    # The water level is where it ends but for the last documents, so the ranges are cut fine up to there.
    copies = queued.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    copies = copies.select(F.struct(finish(F.col("epoch")).alias("finish"), "rank", "r", "doc_id", "size").alias("at"), "size")
    slices = max(1, rows * max_epochs // RANGE_ROWS)
    place = F.floor(F.col("at.finish") / F.lit(level or 1.0) * slices)
    copies = copies.withColumn("range", F.least(place, F.lit(2 * slices)))
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = copies.groupBy("range").agg(F.sum("size").alias("in_range")).withColumn("upto", F.sum("in_range").over(upto))
    edge = ranges.where(F.col("upto") > budget).orderBy("range").select("range", F.col("upto") - F.col("in_range")).first()
    if edge is None:  # the budget covers every copy
        taken = F.col("size") * max_epochs
    else:
        within = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        last = copies.where(F.col("range") == edge[0]).withColumn("sum", edge[1] + F.sum("size").over(within))
        first_out = last.where(F.col("sum") > budget).orderBy("at").select("at.*").first()
        end = F.struct(
            F.lit(first_out["finish"]).alias("finish"),
            F.lit(first_out["rank"]).alias("rank"),
            F.lit(first_out["r"]).alias("r"),
            F.lit(first_out["doc_id"]).cast(docs.schema["doc_id"].dataType).alias("doc_id"),
            F.lit(first_out["size"]).cast("long").alias("size"),
        )
        times = F.lit(0)
        for epoch in range(max_epochs):
            here = F.struct(finish(F.lit(epoch)).alias("finish"), "rank", "r", "doc_id", "size")
            times = times + (here < end).cast("int")
        taken = F.when(F.col("size") > 0, F.col("size") * times).otherwise(0)
    return queued.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
