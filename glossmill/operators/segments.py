"""Motion segments, intervals and frame ranges of long recordings.

Frames are long rows ``(clip_id, frame_idx, v)`` with a motion score. Everything that looks at neighbours uses one window,
partitioned by clip and ordered by frame, so a clip is shuffled and sorted once.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from glossmill.sources.scratch import written

#: A rule for :func:`walk`: state, key and columns (None at the key's end) to the state after and rows to put out.
Walk = Callable[[list[int] | None, object, dict[str, list] | None], tuple[list[int] | None, list[tuple]]]


def in_order() -> WindowSpec:
    """The frames of a clip in order."""
    return Window.partitionBy("clip_id").orderBy("frame_idx")


def velocity(frames: DataFrame) -> DataFrame:
    """Mean displacement of the points ``kp`` since the frame before, 0 for the first."""
    before = F.lag("kp").over(in_order())
    square = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    moved = F.zip_with("kp", before, lambda a, b: F.sqrt(square(a, b)))
    mean = F.aggregate(moved, F.lit(0.0), lambda s, x: s + x) / F.size("kp")
    return frames.withColumn("v", F.when(before.isNotNull(), mean).otherwise(0.0))


def smooth(frames: DataFrame, w: int = 5) -> DataFrame:
    """Centred moving sum over ``w`` frames divided by ``w``: zeros count beyond the ends."""
    low = -(w // 2)
    return frames.withColumn("smooth", F.sum("v").over(in_order().rowsBetween(low, low + w - 1)) / w)


def motion_threshold(frames: DataFrame, value: str = "smooth") -> DataFrame:
    """Frames with their clip's threshold: a fifth of the median motion, at least 2 % of the maximum; 0.02 for unit scores."""
    v = F.col(value)
    per = frames.groupBy("clip_id").agg(F.median(F.when(v > 0, v)).alias("mid"), F.max(v).alias("top"))
    threshold = F.when(F.col("top") > 1, F.greatest(0.2 * F.col("mid"), 0.02 * F.col("top"))).otherwise(0.02)
    return frames.join(per.select("clip_id", threshold.alias("threshold")), "clip_id")


def motion_segments(moving: DataFrame, least: int = 2, most: int = 60, rest: int = 3, pad: int = 1) -> DataFrame:
    """Segments of ``moving(clip_id, frame_idx, moves, n_frames)``: moving frames, cut where ``rest`` frames are still.

    A segment is kept if its last frame is ``least`` to ``most`` frames after its first (``most`` does not bind the last
    of a clip); then it is padded and clamped. Gaps and islands: one lag and one running sum.
    """
    active = moving.where("moves")
    gap = F.col("frame_idx") - F.lag("frame_idx").over(in_order()) - 1
    active = active.withColumn("island", F.sum((F.coalesce(gap, F.lit(0)) >= rest).cast("int")).over(in_order()))
    runs = active.groupBy("clip_id", "island").agg(F.min("frame_idx").alias("a"), F.max("frame_idx").alias("b"), F.first("n_frames").alias("n_frames"))
    last = F.max("island").over(Window.partitionBy("clip_id"))
    length = F.col("b") - F.col("a")
    runs = runs.withColumn("last", last).where((length >= least) & ((length <= most) | (F.col("island") == F.col("last"))))
    return runs.select(
        "clip_id",
        F.row_number().over(Window.partitionBy("clip_id").orderBy("a")).alias("seg_no"),
        F.greatest(F.col("a") - pad, F.lit(0)).alias("start_frame"),
        F.least(F.col("b") + pad, F.col("n_frames") - 1).alias("end_frame"),
    )


def longest_region(segments: DataFrame) -> DataFrame:
    """The longest segment of each clip; the first of equals."""
    length = F.col("end_frame") - F.col("start_frame")
    best = segments.groupBy("clip_id").agg(F.max_by(F.struct("start_frame", "end_frame"), F.struct(length, -F.col("start_frame"))).alias("s"))
    return best.select("clip_id", "s.*")


def rolling_peak(frames: DataFrame, n: int = 5) -> DataFrame:
    return frames.withColumn("peak", F.max("v").over(in_order().rowsBetween(1 - n, 0)))


def most_active_window(frames: DataFrame, n: int = 50) -> DataFrame:
    """Start of the window of ``n`` frames with the largest motion; the first of equals; short clips start at 0."""
    total = frames.withColumn("s", F.sum("v").over(in_order().rowsBetween(0, n - 1))).withColumn("n", F.count("*").over(Window.partitionBy("clip_id")))
    whole = total.where((F.col("frame_idx") + n <= F.col("n")) | (F.col("frame_idx") == 0))
    best = F.max_by(F.struct("frame_idx", "s"), F.struct(F.round("s", 9), -F.col("frame_idx")))
    return whole.groupBy("clip_id").agg(best.alias("b")).select("clip_id", F.col("b.frame_idx").alias("start_frame"), F.col("b.s").alias("motion"))


def motion_profile(frames: DataFrame, n: int = 30) -> DataFrame:
    """Mean, maximum and quartiles of the motion of each tumbling chunk of ``n`` frames."""
    return frames.groupBy("clip_id", F.floor(F.col("frame_idx") / n).alias("chunk")).agg(
        F.avg("v").alias("mean"), F.max("v").alias("max"), *[F.percentile("v", F.lit(q)).alias(f"p{int(q * 100)}") for q in (0.25, 0.5, 0.75)]
    )


def frames_in_segments(frames: DataFrame, segments: DataFrame, bin_size: int = 256) -> DataFrame:
    """Frames of each segment, both ends included; a frame in two segments comes twice.

    An equi-join on clip and bin of frames with a check of the range, so a very long clip is spread over its bins.
    """
    bins = F.explode(F.sequence(F.floor(F.col("start_frame") / bin_size), F.floor(F.col("end_frame") / bin_size)))
    cut = segments.where("start_frame <= end_frame").withColumn("bin", bins)
    rows = frames.withColumn("bin", F.floor(F.col("frame_idx") / bin_size))
    return rows.join(cut, ["clip_id", "bin"]).where("frame_idx BETWEEN start_frame AND end_frame").drop("bin")


def frame_to_segment(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """The first segment that each frame is in, null if none, and the number of its sentence.

    ``segments(clip_id, seg_no, start_frame, end_frame, sentence_break_after)``.
    """
    order = Window.partitionBy("clip_id").orderBy("seg_no")
    breaks = F.sum(F.col("sentence_break_after").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = segments.withColumn("sentence_no", F.coalesce(breaks, F.lit(0)))
    inside = frames_in_segments(frames.select("clip_id", "frame_idx"), numbered)
    first = inside.groupBy("clip_id", "frame_idx").agg(F.min(F.struct("seg_no", "sentence_no")).alias("s"))
    return frames.join(first, ["clip_id", "frame_idx"], "left").withColumns({"seg_no": F.col("s.seg_no"), "sentence_no": F.col("s.sentence_no")}).drop("s")


def sliding_scan(clips: DataFrame, win: int = 40, step: int = 20) -> DataFrame:
    """Overlapping windows of ``clips(clip_id, n_frames)``."""
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_frames") - win, F.lit(0)), F.lit(step)))
    return clips.select("clip_id", starts.alias("start_frame"), "n_frames").select(
        "clip_id", "start_frame", F.least(F.col("start_frame") + win, F.col("n_frames")).alias("end_frame")
    )


def fixed_segments(clips: DataFrame, sign: float, pause: float, pad: float, fps: float) -> DataFrame:
    """A regular schedule of signs and pauses over ``clips(clip_id, seconds)``."""
    usable = F.col("seconds") - 2 * pad
    n = F.floor((usable + pause) / (sign + pause)).cast("int")
    rows = clips.withColumn("n", n).where("n > 0").select("clip_id", "seconds", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    start = F.lit(pad) + F.col("k") * (sign + pause)
    return rows.select("clip_id", "k", (start * fps).cast("int").alias("start_frame"), (F.least(start + sign, F.col("seconds")) * fps).cast("int").alias("end_frame"))


def offsets(parts: DataFrame) -> DataFrame:
    """Frame ranges of ``parts(clip_id, pos, n_frames)`` when a clip's parts are put one after another."""
    before = Window.partitionBy("clip_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_frames").over(before), F.lit(0))
    return parts.withColumn("start_frame", start).withColumn("end_frame", start + F.col("n_frames") - 1)


def sentence_groups(glosses: DataFrame) -> DataFrame:
    """Sentences of ``glosses(session_id, pos, gloss, break_after)``: runs up to a break."""
    order = Window.partitionBy("session_id").orderBy("pos")
    number = F.sum(F.coalesce(F.lag(F.col("break_after").cast("int")).over(order), F.lit(0))).over(order)
    listed = glosses.withColumn("sentence_no", number).groupBy("session_id", "sentence_no")
    return listed.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "gloss"))), lambda x: x["gloss"]).alias("glosses"))


def caption_batches(glosses: DataFrame, n: int = 3) -> DataFrame:
    """Batches of ``n`` glosses of a session, the last one as it is."""
    order = Window.partitionBy("session_id").orderBy("pos")
    batch = F.floor((F.row_number().over(order) - 1) / n)
    listed = glosses.withColumn("batch", batch).groupBy("session_id", "batch")
    return listed.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "gloss"))), lambda x: x["gloss"]).alias("glosses"))


def merge_intervals(intervals: DataFrame, gap_ms: int = 300) -> DataFrame:
    """Intervals of a video joined where the gap is below ``gap_ms``; overlaps count as no gap."""
    order = Window.partitionBy("video_id").orderBy("start_ms", "end_ms")
    before = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("start_ms") - before >= gap_ms).cast("int"), F.lit(0))
    grouped = intervals.withColumn("new", new).withColumn("block", F.sum("new").over(order)).groupBy("video_id", "block")
    return grouped.agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("parts"))


#: Rows of one task in a walk over a long recording.
WALK_ROWS = 50_000


def _listed(column: pa.Array) -> list:
    """An Arrow column as a list; much faster than asking for each value by itself where none is null."""
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def walk(rows: DataFrame, key: str, order: list[str], step: Walk, schema: str, block_rows: int = WALK_ROWS) -> DataFrame:
    """A walk over the rows of each ``key`` in ``order``, for rules in which what was decided before matters.

    ``step(state, key, columns)`` goes over some rows of one key that follow each other, with the state (a list of whole
    numbers, None at the start) that the rows before left; it returns the state after them and the rows to put out.
    ``step(state, key, None)`` ends a key.

    Rows are range-partitioned, so a key with very many of them is walked in many tasks. A block first starts without a
    state; blocks are walked again with what the block before really left, until no block's end changes any more. Rules
    that cut now and then forget what was before the cut, so this takes two or three rounds; the result is always that of
    one walk. Between rounds there is one row for each block. A task streams its blocks in order and holds one Arrow batch.
    """
    blocks = max(1, -(-rows.count() // block_rows))
    names = [key, *order, *[c for c in rows.columns if c not in (key, *order)]]
    placed = rows.select(*names).repartitionByRange(blocks, key, *order).withColumn("_block", F.spark_partition_id())
    placed = written(placed, "blocks")
    last = placed.agg(F.max("_block")).first()[0]
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    ends_schema = f"_block int, {key} {kind}, _state array<long>"
    arrow = {s: spark.createDataFrame([], s).toArrow().schema for s in (schema, ends_schema)}

    def over(put_out: bool):
        shape = arrow[schema if put_out else ends_schema]

        def frame(done: list[tuple]) -> pa.RecordBatch:
            columns = zip(*done, strict=True) if done else [()] * len(shape)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

        def end(block: int, now: tuple | None) -> list[tuple]:
            if not put_out:
                return [(block, *now)]
            return step(now[1], now[0], None)[1] if block == last and now is not None else []

        def run(batches):
            block, now = None, None  # the block that is walked; the key it is at and the state there
            entered: dict[int, tuple] = {}
            for batch in batches:
                done: list[tuple] = []
                plain = pc.is_null(batch.column("_state"))
                for row in batch.filter(pc.invert(plain)).to_pylist():
                    entered[row["_block"]] = row[key], row["_state"]
                columns = {c: _listed(x) for c, x in zip(batch.schema.names, batch.filter(plain).columns, strict=True) if c != "_state"}
                at, keys, start = columns.pop("_block"), columns.pop(key), 0
                while start < len(at):
                    if at[start] != block:
                        if block is not None:
                            done += end(block, now)
                        block, now = at[start], entered.pop(at[start], None)
                    stop = bisect.bisect_right(keys, keys[start], start, bisect.bisect_right(at, block, start))
                    if now is not None and now[0] != keys[start]:
                        out = step(now[1], now[0], None)[1]
                        done += out if put_out else []
                        now = None
                    after, out = step(now and now[1], keys[start], {c: v[start:stop] for c, v in columns.items()})
                    done += out if put_out else []
                    now, start = (keys[start], after), stop
                yield frame(done)
            if block is not None:
                yield frame(end(block, now))

        return run

    def walked(entries: DataFrame | None, put_out: bool) -> DataFrame:
        """One round; what the block before left comes ahead of a block's rows."""
        given = placed.withColumn("_state", F.lit(None).cast("array<long>"))
        if entries is not None:
            given = given.unionByName(entries.where("_state IS NOT NULL"), allowMissingColumns=True)
        given = given.repartition("_block").sortWithinPartitions("_block", F.col("_state").isNull(), key, *order)
        return given.mapInArrow(run_of[put_out], schema if put_out else ends_schema)

    run_of = {x: over(x) for x in (False, True)}
    entries = None
    while blocks > 1 and last is not None:
        ends = written(walked(entries, False), "ends")
        before = Window.orderBy("_block")
        after = written(ends.select("_block", F.lag(key).over(before).alias(key), F.lag("_state").over(before).alias("_state")), "entries")
        known = after.where("false") if entries is None else entries
        changed = after.join(known.toDF("_block", "_k", "_s"), "_block", "left").where(~F.col(key).eqNullSafe(F.col("_k")) | ~F.col("_state").eqNullSafe(F.col("_s")))
        entries = after
        if changed.isEmpty():
            break
    return walked(entries, True)


def merge_short_intervals(intervals: DataFrame, gap_ms: int = 500, short_ms: int = 1000, block_rows: int = WALK_ROWS) -> DataFrame:
    """Joins neighbours of ``intervals(video_id, start_ms, end_ms)`` whose gap is small while both what has been joined so
    far and the next are short. What was joined before decides, so intervals are walked (:func:`walk`)."""

    def merges(start: int, end: int, a: int, b: int) -> bool:
        return a - end <= gap_ms and end - start < short_ms and b - a < short_ms

    return _merged_walk(intervals, merges, max, block_rows)


def merge_annotations(intervals: DataFrame, gap_ms: int = 300, short_gap_ms: int = 800, short_ms: int = 300, block_rows: int = WALK_ROWS) -> DataFrame:
    """Joins annotated signs of ``intervals(video_id, start_ms, end_ms)``: a gap below ``gap_ms``, or one below
    ``short_gap_ms`` if what has been joined so far or the next is shorter than ``short_ms``.

    What is joined ends where its last part ends, even if an earlier one ends later.
    """

    def merges(start: int, end: int, a: int, b: int) -> bool:
        return a - end < gap_ms or (a - end < short_gap_ms and (end - start < short_ms or b - a < short_ms))

    return _merged_walk(intervals, merges, lambda end, b: b, block_rows)


def _merged_walk(intervals: DataFrame, merges: Callable[[int, int, int, int], bool], ends: Callable[[int, int], int], block_rows: int) -> DataFrame:
    def step(state, video, rows):
        if rows is None:
            return None, [(video, *state)]
        out = []
        for a, b in zip(rows["start_ms"], rows["end_ms"], strict=True):
            if state is not None and merges(state[0], state[1], a, b):
                state = [state[0], ends(state[1], b), state[2] + 1]
            else:
                if state is not None:
                    out.append((video, *state))
                state = [a, b, 1]
        return state, out

    kind = intervals.schema["video_id"].dataType.simpleString()
    rows = intervals.select("video_id", "start_ms", "end_ms")
    return walk(rows, "video_id", ["start_ms", "end_ms"], step, f"video_id {kind}, start_ms long, end_ms long, parts long", block_rows)


def extend_intervals(intervals: DataFrame, before_ms: int, after_ms: int, short_ms: int = 700) -> DataFrame:
    """Widened intervals, short ones by three tenths more; neighbours that would overlap meet in the middle."""
    factor = F.when(F.col("end_ms") - F.col("start_ms") < short_ms, 1.3).otherwise(1.0)
    wide = intervals.withColumn("a", F.greatest(F.col("start_ms") - F.floor(before_ms * factor), F.lit(0))).withColumn("b", F.col("end_ms") + F.floor(after_ms * factor))
    order = Window.partitionBy("video_id").orderBy("start_ms", "end_ms")
    prev_b, next_a = F.lag("b").over(order), F.lead("a").over(order)
    start = F.when(prev_b > F.col("a"), F.floor((prev_b + F.col("a")) / 2)).otherwise(F.col("a"))
    end = F.when(next_a < F.col("b"), F.floor((F.col("b") + next_a) / 2)).otherwise(F.col("b"))
    return wide.select(*[c for c in intervals.columns if c not in ("start_ms", "end_ms")], start.alias("start_ms"), end.alias("end_ms"))


def fill_gaps(segments: DataFrame, sentences: DataFrame, least_ms: int = 2000, coverage: float = 0.6, bin_ms: int = 3_600_000) -> DataFrame:
    """An interval for each gap between segments: the first sentence wholly inside it, else one in its middle.

    The middle one covers ``coverage`` of the gap, one to three seconds, with a fifth of a second left at both ends; it
    is only made if over half a second is usable. Gaps and sentences meet by the hour (``bin_ms``) in which these begin.
    """
    order = Window.partitionBy("video_id").orderBy("start_ms", "end_ms")
    gaps = segments.select("video_id", F.col("end_ms").alias("a"), F.lead("start_ms").over(order).alias("b")).where(F.col("b") - F.col("a") > least_ms)
    hours = gaps.withColumn("bin", F.explode(F.sequence(F.floor(F.col("a") / bin_ms), F.floor(F.col("b") / bin_ms))))
    said = sentences.select("video_id", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), F.floor(F.col("start_ms") / bin_ms).alias("bin"))
    inside = hours.join(said, ["video_id", "bin"]).where("s >= a AND e <= b")
    first = inside.groupBy("video_id", "a", "b").agg(F.min(F.struct("s", "e")).alias("x"))
    usable = F.col("b") - F.col("a") - 400
    length = F.least(F.least(F.greatest(F.floor((F.col("b") - F.col("a")) * coverage), F.lit(1000)), F.lit(3000)), usable)
    middle = F.floor((F.col("a") + F.col("b")) / 2)
    out = gaps.join(first, ["video_id", "a", "b"], "left").withColumn("length", length)
    out = out.where(F.col("x").isNotNull() | (usable > 500))
    start = F.coalesce("x.s", middle - F.floor(F.col("length") / 2))
    return out.select("video_id", start.alias("start_ms"), F.coalesce("x.e", start + F.col("length")).alias("end_ms"), F.col("x").isNull().alias("synthetic"))


def video_type(intervals: DataFrame) -> DataFrame:
    """Concatenated, continuous or mixed recording, scored by the gaps and durations of its intervals."""
    order = Window.partitionBy("video_id").orderBy("start_ms", "end_ms")
    rows = intervals.withColumn("gap", F.col("start_ms") - F.lag("end_ms").over(order)).withColumn("length", F.col("end_ms") - F.col("start_ms"))
    per = rows.groupBy("video_id").agg(
        F.count("*").alias("n"), F.avg("gap").alias("avg_gap"), F.stddev_pop("length").alias("std_length"), F.avg("length").alias("avg_length")
    )
    score = (F.col("avg_gap") > 500).cast("int") + (F.col("std_length") < 0.5 * F.col("avg_length")).cast("int") + (F.col("avg_length") > 1000).cast("int")
    kind = F.when(score >= 2, "concatenated").when(score == 1, "mixed").otherwise("continuous")
    return per.withColumn("score", score).withColumn("type", F.when(F.col("avg_gap").isNull(), "mixed").otherwise(kind))


def valleys(frames: DataFrame, w: int = 5, share: float = 0.2, apart: int = 5, block_rows: int = WALK_ROWS) -> DataFrame:
    """Cuts at local minima below ``share`` of the local maximum, from the left at least ``apart`` frames apart.

    Candidates are found with one window; only they are walked (:func:`walk`).
    """
    near = in_order().rowsBetween(-w, w)
    low = frames.withColumn("low", F.min("v").over(near)).withColumn("high", F.max("v").over(near))
    found = low.where((F.col("v") == F.col("low")) & (F.col("v") < share * F.col("high"))).select("clip_id", "frame_idx")

    def step(state, clip, rows):
        kept = []
        for i in rows["frame_idx"] if rows else ():
            if state is None or i - state[0] >= apart:
                state = [i]
                kept.append((clip, i))
        return state, kept

    kind = frames.schema["clip_id"].dataType.simpleString()
    return walk(found, "clip_id", ["frame_idx"], step, f"clip_id {kind}, frame_idx long", block_rows)


def trim_signing_region(frames: DataFrame, least: int = 8, spread: float = 5.0) -> DataFrame:
    """Frames of each clip that show signing, by the height ``y`` of the highest hand (null: no hand).

    With little movement the middle, from half to nine tenths of the clip, is kept; else the frames from the first to the
    last that is raised above two fifths of the range. Clips with hands in under 30 % of their frames stay whole, as do
    those of which fewer than ``least`` frames would be left.
    """
    per = frames.groupBy("clip_id").agg(F.count("*").alias("n"), F.count("y").alias("valid"), F.min("y").alias("top"), F.max("y").alias("bottom"))
    rows = frames.join(per, "clip_id")
    raised = F.col("y") < F.col("bottom") - 0.4 * (F.col("bottom") - F.col("top"))
    marks = rows.groupBy("clip_id").agg(F.min(F.when(raised, F.col("frame_idx"))).alias("first"), F.max(F.when(raised, F.col("frame_idx"))).alias("last"))
    rows = rows.join(marks, "clip_id")
    still = F.col("bottom") - F.col("top") < spread
    a = F.when(still, F.floor(F.col("n") * 0.5)).otherwise(F.col("first"))
    b = F.when(still, F.floor(F.col("n") * 0.9)).otherwise(F.col("last"))
    whole = (F.col("valid") < 0.3 * F.col("n")) | a.isNull() | (b - a + 1 < least)
    return rows.where(whole | F.col("frame_idx").between(a, b)).select(*frames.columns)
