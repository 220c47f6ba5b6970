"""Caption buffers over gloss events, as streams and as batches that give the same rows.

Events are ``(session_id, event_id, ts, gloss, confidence)``. Time is that of the events: a pause lies between a word and
the one before. A session's events go through a small state machine in order of time and id; the state is a few words.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossmill.streaming import buckets as B

# Words that end a caption.
QUESTION_WORDS = ("WHAT", "WHERE", "WHEN", "WHO", "WHY", "HOW", "WHICH")
END_WORDS = ("FINISH", "DONE", "END", "BYE", "THANK-YOU")

CAPTION = "session_id string, ts timestamp, text string, n long, confidence double, reason string"
COUNTED = "session_id string, ts timestamp, n long, is_rest boolean"


@dataclass
class TriggerBuffer:
    """Buffers words and says when they become a caption.

    A word closes the buffer when it makes it full, is a question word that is not alone, is an end word, or comes more
    than ``timeout`` seconds after the last caption. A silence of more than ``pause`` seconds closes it as it is. One of
    more than ``session_end`` seconds ends the session: what follows knows of no earlier caption.
    """

    pause: float = 1.8
    full: int = 3
    timeout: float = 10.0
    session_end: float = 1800.0
    questions: tuple[str, ...] = QUESTION_WORDS
    ends: tuple[str, ...] = END_WORDS
    words: list[str] = field(default_factory=list)
    confidences: list[float] = field(default_factory=list)
    last_word: float = 0.0
    last_call: float | None = None

    ROWS = "at long, text string, n long, confidence double, reason string"
    STATE = "words array<string>, confidences array<double>, last_word double, last_call double"

    def _close(self, at: float, reason: str) -> tuple[float, str, int, float, str]:
        out = (at, " ".join(self.words), len(self.words), sum(self.confidences) / len(self.confidences), reason)
        self.words, self.confidences, self.last_call = [], [], at
        return out

    def silence(self, now: float) -> list[tuple]:
        """Captions due to the silence from the last word to ``now``."""
        out = []
        if self.words and now - self.last_word > self.pause:
            out.append(self._close(self.last_word + self.pause, "pause" if len(self.words) > 1 else "idle"))
        if now - self.last_word > self.session_end:
            self.last_call = None
        return out

    def word(self, now: float, gloss: str, confidence: float) -> list[tuple]:
        out = self.silence(now)
        if self.last_call is None:
            self.last_call = now
        self.words.append(gloss)
        self.confidences.append(confidence)
        self.last_word = now
        known = gloss.upper()
        if len(self.words) >= self.full:
            out.append(self._close(now, "full"))
        elif known in self.questions and len(self.words) > 1:
            out.append(self._close(now, "question"))
        elif known in self.ends:
            out.append(self._close(now, "end"))
        elif now - self.last_call > self.timeout:
            out.append(self._close(now, "timeout"))
        return out

    def save(self) -> tuple:
        return (self.words, self.confidences, self.last_word, self.last_call)

    def load(self, words, confidences, last_word, last_call) -> None:
        self.words, self.confidences, self.last_word, self.last_call = list(words), list(confidences), last_word, last_call

    def due(self) -> float:
        """When silence does something next."""
        return self.last_word + (self.pause if self.words else self.session_end)

    def over(self, now: float) -> bool:
        """Whether nothing before ``now`` matters any more."""
        return not self.words and now - self.last_word > self.session_end


@dataclass
class CountBuffer:
    """Emits all unprocessed glosses as soon as there are ``n``, at least ``gap`` seconds after the last emission.

    After a silence of more than ``session_end`` seconds the session is over: if glosses are left, all of the session are
    emitted once more as the rest, at the time of the last one.
    """

    n: int = 3
    gap: float = 2.0
    session_end: float = 1800.0
    waiting: int = 0
    total: int = 0
    last_word: float = 0.0
    last_call: float | None = None

    ROWS = "at long, n long, is_rest boolean"
    STATE = "waiting long, total long, last_word double, last_call double"

    def silence(self, now: float) -> list[tuple]:
        if now - self.last_word <= self.session_end:
            return []
        out = [(self.last_word, self.total, True)] if self.waiting else []
        self.waiting, self.total, self.last_call = 0, 0, None
        return out

    def word(self, now: float, gloss: str, confidence: float) -> list[tuple]:
        out = self.silence(now)
        self.waiting, self.total, self.last_word = self.waiting + 1, self.total + 1, now
        if self.waiting >= self.n and (self.last_call is None or now - self.last_call >= self.gap):
            out.append((now, self.waiting, False))
            self.waiting, self.last_call = 0, now
        return out

    def save(self) -> tuple:
        return (self.waiting, self.total, self.last_word, self.last_call)

    def load(self, waiting, total, last_word, last_call) -> None:
        self.waiting, self.total, self.last_word, self.last_call = waiting, total, last_word, last_call

    def due(self) -> float:
        return self.last_word + self.session_end

    def over(self, now: float) -> bool:
        return now - self.last_word > self.session_end


def _micros(seconds: float) -> int:
    return round(seconds * 1e6)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    """Rows ``(session, time in seconds, ...)`` with the time in whole microseconds."""
    names = ["session_id", *(column.split()[0] for column in schema.split(", "))]
    return pd.DataFrame.from_records([(s, _micros(at), *rest) for s, at, *rest in rows], columns=names)


def _events(events: DataFrame) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return events.select(F.col("session_id").cast("string").alias("session_id"), "ts", "event_id", seconds.alias("t"), "gloss", "confidence")


def _timed(rows: DataFrame) -> DataFrame:
    return rows.select("session_id", F.timestamp_micros("at").alias("ts"), *[c for c in rows.columns if c not in ("session_id", "at")])


def _batch(events: DataFrame, make, until: datetime.datetime | None) -> DataFrame:
    """Walks sessions one after another, sorted inside partitions, so a long session needs no more memory."""
    schema, end = make().ROWS, math.inf
    if until is not None:
        end = until.replace(tzinfo=until.tzinfo or datetime.timezone.utc).timestamp()
        events = events.where(F.unix_micros(F.col("ts").cast("timestamp")) <= _micros(end))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, buffer = None, None
        for pdf in batches:
            out: list[tuple] = []
            for s, t, gloss, conf in zip(pdf["session_id"], pdf["t"], pdf["gloss"], pdf["confidence"], strict=True):
                if buffer is None or s != session:
                    if buffer is not None:
                        out += [(session, *row) for row in buffer.silence(end)]
                    session, buffer = s, make()
                out += [(s, *row) for row in buffer.word(t, gloss, conf)]
            yield _frame(out, schema)
        if buffer is not None:
            yield _frame([(session, *row) for row in buffer.silence(end)], schema)

    rows = _events(events).repartition("session_id").sortWithinPartitions("session_id", "ts", "event_id")
    return _timed(rows.mapInPandas(run, f"session_id string, {schema}"))


def _stream(events: DataFrame, make, watermark: str, buckets: int) -> DataFrame:
    """The same walk with the buffers as state.

    Events wait in the state until the watermark has passed them, so they are walked in order of time whatever order
    they come in; a timer brings the next moment at which an event or a silence counts. A session that is over leaves no
    state. A call walks the sessions of one of ``buckets`` buckets: it holds their events of one micro-batch and those
    that wait; the reader's ``maxFilesPerTrigger`` or ``maxBytesPerTrigger`` bounds the former, the watermark's delay the
    latter.
    """
    schema, kept = make().ROWS, ["session_id", *(column.split()[0] for column in make().STATE.split(", "))]
    columns = ["session_id", "t", "event_id", "gloss", "confidence"]

    def run(key, batches, state):
        buffers, frames, out = {}, [], []
        if state.exists:
            saved, left = state.get
            for session, *values in zip(*B.unpack(saved).to_pydict().values(), strict=True) if saved else ():
                buffers[session] = make()
                buffers[session].load(*values)
            frames = B.unpack_rows(left)
        if not state.hasTimedOut:
            frames += [pdf[columns] for pdf in batches]
        passed, waiting, first = state.getCurrentWatermarkMs(), None, {}
        if frames:
            rows, _ = B.in_order(frames)
            ready = (rows["t"] * 1e6).round() <= passed * 1000
            waiting = rows[~ready]
            for session, t, _, gloss, confidence in zip(*(rows.loc[ready, c].tolist() for c in columns), strict=True):
                if session not in buffers:
                    buffers[session] = make()
                out += [(session, *row) for row in buffers[session].word(t, gloss, confidence)]
            head = waiting.drop_duplicates("session_id")
            first = dict(zip(head["session_id"], head["t"].tolist(), strict=True))
        for session, buffer in buffers.items():
            out += [(session, *row) for row in buffer.silence(passed / 1000)]
        live = {session: buffer for session, buffer in buffers.items() if not buffer.over(passed / 1000)}
        if live or first:
            saved = zip(*((session, *buffer.save()) for session, buffer in live.items()), strict=True)
            saved = B.pack(pa.table(dict(zip(kept, map(list, saved), strict=True)))) if live else None
            state.update((saved, B.pack_rows(waiting) if first else None))
            due = min([*(buffer.due() for buffer in live.values()), *first.values()])
            state.setTimeoutTimestamp(max(math.ceil(due * 1000) - 1, passed, 1))  # comes when the watermark is beyond it
        else:
            state.remove()
        yield from (_frame(part, schema) for part in B.parts(out))

    rows = _events(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark))
    grouped = B.bucketed(rows, buckets)
    return _timed(grouped.applyInPandasWithState(run, f"session_id string, {schema}", "sessions binary, waiting binary", "append", "EventTimeTimeout"))


def trigger_captions(events: DataFrame, until: datetime.datetime | None = None, **settings) -> DataFrame:
    """Captions of a table of events: the batch twin of :func:`trigger_caption_stream`.

    With ``until`` (UTC if it names no zone) only what is known at that time comes out, as from a stream whose watermark
    is there; without it every buffer is closed by the silence after its last word.
    """
    return _batch(events, lambda: TriggerBuffer(**settings), until)


def trigger_caption_stream(events: DataFrame, watermark: str = "10 seconds", buckets: int = B.BUCKETS, **settings) -> DataFrame:
    """Captions of a stream of events; those of :func:`trigger_captions` up to the watermark, in any order of arrival.

    Rows later than the watermark are dropped.
    """
    return _stream(events, lambda: TriggerBuffer(**settings), watermark, buckets)


def count_batches(events: DataFrame, n: int = 3, gap: float = 2.0, until: datetime.datetime | None = None, session_end: float = 1800.0) -> DataFrame:
    """Emissions ``(session_id, ts, n, is_rest)`` of :class:`CountBuffer` over a table of events."""
    return _batch(events, lambda: CountBuffer(n, gap, session_end), until)


def count_batch_stream(
    events: DataFrame, watermark: str = "10 seconds", n: int = 3, gap: float = 2.0, session_end: float = 1800.0, buckets: int = B.BUCKETS
) -> DataFrame:
    """Emissions of :func:`count_batches` from a stream; the rest comes when the watermark ends the session."""
    return _stream(events, lambda: CountBuffer(n, gap, session_end), watermark, buckets)


def session_captions(events: DataFrame, pause: str = "1800 milliseconds") -> DataFrame:
    """Captions cut at pauses only: works on tables and, with a watermark, on streams."""
    window = F.session_window(F.col("ts").cast("timestamp"), pause)
    listed = F.array_sort(F.collect_list(F.struct("ts", "event_id", "gloss")))
    out = events.groupBy("session_id", window.alias("w")).agg(F.transform(listed, lambda x: x["gloss"]).alias("glosses"), F.avg("confidence").alias("confidence"))
    return out.select("session_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "glosses", "confidence")


def gloss_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Glosses of each session in tumbling or sliding windows; works on tables and streams."""
    w = F.window(F.col("ts").cast("timestamp"), window, slide) if slide else F.window(F.col("ts").cast("timestamp"), window)
    return events.groupBy("session_id", w.alias("w"), "gloss").agg(F.count("*").alias("n")).select("session_id", F.col("w.start").alias("start_ts"), "gloss", "n")


def last_n(events: DataFrame, n: int = 6) -> DataFrame:
    """The last ``n`` glosses at each event."""
    order = Window.partitionBy("session_id").orderBy("ts", "event_id").rowsBetween(1 - n, 0)
    return events.withColumn("recent", F.collect_list("gloss").over(order))


def sign_activity(frames: DataFrame, cooldown: int = 3) -> DataFrame:
    """Signs from frames ``(session_id, ts, moves)``: runs of moving frames that are less than ``cooldown`` frames apart.

    Frames are counted; :func:`sign_windows` takes the cooldown as time, which streams can do.
    """
    order = Window.partitionBy("session_id").orderBy("ts", "event_id")
    numbered = frames.withColumn("i", F.row_number().over(order)).where("moves")
    new = F.coalesce((F.col("i") - F.lag("i").over(order) > cooldown).cast("int"), F.lit(0))
    runs = numbered.withColumn("new", new).withColumn("sign_no", F.sum("new").over(order))
    return runs.groupBy("session_id", "sign_no").agg(F.min("i").alias("start_frame"), F.max("i").alias("end_frame"), F.count("*").alias("moving"))


def sign_windows(frames: DataFrame, cooldown: str = "200 milliseconds") -> DataFrame:
    """Signs from frames ``(session_id, ts, moves)`` as session windows over the moving ones: tables and streams.

    A sign is over when no frame moves for ``cooldown``; on a stream with a watermark it comes out then.
    """
    window = F.session_window(F.col("ts"), cooldown)
    out = frames.where("moves").groupBy("session_id", window.alias("w")).agg(F.count("*").alias("moving"), F.max("ts").alias("last_ts"))
    return out.select("session_id", F.col("w.start").alias("start_ts"), "last_ts", "moving")


def run_available(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Run a stream over what is there into Parquet files under ``path``; the checkpoint lies beside them.

    In complete mode each batch replaces the files with the whole result.
    """
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}-state")
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
