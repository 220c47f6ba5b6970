"""What came before in a session: the last glosses, sentences and latencies, and which glosses a caption used.

Every function takes a table or a stream and gives the same rows for both. On a stream, rows wait in the state until the
watermark has passed them and are walked in order of event time and id, so the order of arrival does not show; rows
later than the watermark are dropped. A silence of more than ``session_end`` seconds ends a session and frees its state.
Rows without a session, a time or a value are left out.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from glossmill.streaming import buckets as B

# Words that may change how earlier ones are to be read.
CLARIFYING_WORDS = (
    "who", "what", "which", "that", "this", "these", "those",
    "mother", "father", "man", "woman", "doctor", "cousin", "brother", "sister", "son", "daughter", "friend",
    "now", "before", "finish", "year", "yesterday", "tomorrow",
    "where", "when", "why", "how",
    "no", "not", "never", "wrong",
    "all", "many", "few", "some",
)

RUN = 32  # rows of a session that a stream's walk gives as one

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, so it may be larger than memory."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _tails(n: int | None, session_end: float):
    """The last ``n`` values of each session (all, if ``n`` is none) at each of its rows, for the sessions of a bucket.

    The state holds the rows that the watermark has not passed and the last ones before it, as many as the next row
    needs; a timer brings the first of those that wait, or the end of a session. Up to ``RUN`` rows of a session come out
    as one, with their values and those before them once; :func:`_each` makes a row of each.
    """
    end = round(session_end * 1e6)
    columns = ["session_id", "event_id", "t", "value", "mark"]

    def run(key, batches, state) -> Iterator[pd.DataFrame]:
        frames = B.unpack_rows(state.get[0]) if state.exists else []
        if not state.hasTimedOut:
            frames += [pdf[columns].assign(done=False) for pdf in batches]
        passed = state.getCurrentWatermarkMs() * 1000
        earliest = min(int(pdf["t"].min()) for pdf in frames)
        if earliest >= passed:  # all wait, so there is nothing to put in order yet
            state.update((B.pack_rows(pd.concat(frames, ignore_index=True)),))
            state.setTimeoutTimestamp(max(earliest // 1000, passed // 1000, 1))
            return
        rows, session = B.in_order(frames)
        at, t, ready = np.arange(len(rows)), rows["t"].to_numpy(), rows["t"].to_numpy() < passed
        first = np.diff(session, prepend=-1) != 0
        start = np.maximum.accumulate(np.where(first | (np.diff(t, prepend=t[:1]) > end), at, 0))
        new = at[ready & ~rows["done"].to_numpy(dtype=bool)]
        low = start[new] if n is None else np.maximum(start[new], new - n + 1)

        begin, number = at[first], np.cumsum(first) - 1
        last = begin + np.bincount(number, ready).astype(int) - 1  # of the ready rows of each session
        some, waits = last >= begin, np.append(begin[1:], len(rows)) - 1 > last
        over = some & ~waits & (passed - t[last] > end)
        tail = ready & ~over[number] & (at >= start[last][number])
        if n is not None:
            tail &= at > last[number] - max(n - 1, 1)
        kept = rows[tail | ~ready].assign(done=ready[tail | ~ready])
        if len(kept):
            state.update((B.pack_rows(kept),))
            due = np.concatenate([t[~ready], t[last[some & ~waits & ~over]] + end]).min()
            state.setTimeoutTimestamp(max(int(due) // 1000, passed // 1000, 1))  # comes when the watermark is beyond it
        else:
            state.remove()
        yield from _runs(rows, new, low, first)

    return run


def _runs(rows: pd.DataFrame, new: np.ndarray, low: np.ndarray, first: np.ndarray) -> Iterator[pd.DataFrame]:
    """The rows at ``new``, whose values begin at ``low``, as runs of at most ``RUN`` that lie together in a session."""
    k = np.arange(len(new))
    fresh = (np.diff(new, prepend=-2) != 1) | first[new]
    begins = k[(k - np.maximum.accumulate(np.where(fresh, k, 0))) % RUN == 0]
    lengths = np.diff(begins, append=len(new))
    inside = (low - np.repeat(low[begins], lengths)).tolist()
    sessions, events, times, values, marks = (rows[c].tolist() for c in ("session_id", "event_id", "t", "value", "mark"))
    runs = list(zip(begins.tolist(), lengths.tolist(), new[begins].tolist(), low[begins].tolist(), strict=True))
    for some in B.parts(runs):
        yield pd.DataFrame({
            "session_id": [sessions[i] for _, _, i, _ in some],
            "before": [i - j for _, _, i, j in some],
            "event_id": [events[i : i + m] for _, m, i, _ in some],
            "t": [times[i : i + m] for _, m, i, _ in some],
            "mark": [marks[i : i + m] for _, m, i, _ in some],
            "low": [inside[b : b + m] for b, m, _, _ in some],
            "values": [values[j : i + m] for _, m, i, j in some],
        })


def _each(runs: DataFrame) -> DataFrame:
    """Runs of rows as ``(session_id, event_id, t, value, mark, recent)``, a row for each."""
    one = F.posexplode(F.arrays_zip("event_id", "t", "mark", "low")).alias("k", "one")
    rows = runs.select("session_id", "values", "before", one).withColumn("at", F.col("before") + F.col("k"))
    recent = F.slice("values", F.col("one.low") + 1, F.col("at") - F.col("one.low") + 1)
    return rows.select("session_id", "one.event_id", "one.t", F.get("values", "at").alias("value"), "one.mark", recent.alias("recent"))


def _micros(column: str = "ts") -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def _at(until: datetime.datetime) -> int:
    return round(until.replace(tzinfo=until.tzinfo or datetime.timezone.utc).timestamp() * 1e6)


def recent(
    rows: DataFrame, value: Column, n: int | None, mark: Column | None = None, session_end: float = 1800.0,
    watermark: str = "10 seconds", until: datetime.datetime | None = None, buckets: int = B.BUCKETS,
) -> DataFrame:
    """``rows(session_id, event_id, ts)`` as ``(session_id, event_id, ts, value, mark, recent)``.

    ``recent`` are the last ``n`` values up to and with the row's own, oldest first. ``until`` gives of a table what a
    stream has given when its watermark is there: rows before that moment. A call on a stream holds the rows of one of
    ``buckets`` buckets of sessions.
    """
    mark = F.lit(False) if mark is None else F.coalesce(mark, F.lit(False))
    flat = rows.select(
        F.col("session_id").cast("string").alias("session_id"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"),
        _micros().alias("t"), value.alias("value"), mark.alias("mark"),
    ).where("session_id IS NOT NULL AND event_id IS NOT NULL AND t IS NOT NULL AND value IS NOT NULL")
    if rows.isStreaming:
        kind = flat.schema["value"].dataType
        schema = T.StructType().add("session_id", T.StringType()).add("before", T.IntegerType())
        lists = {"event_id": T.LongType(), "t": T.LongType(), "mark": T.BooleanType(), "low": T.IntegerType(), "values": kind}
        for name, of in lists.items():
            schema = schema.add(name, T.ArrayType(of))
        grouped = B.bucketed(flat.withWatermark("ts", watermark), buckets)
        out = _each(grouped.applyInPandasWithState(_tails(n, session_end), schema, "rows binary", "append", "EventTimeTimeout"))
    else:
        if until is not None:
            flat = flat.where(F.col("t") < _at(until))
        order = Window.partitionBy("session_id").orderBy("t", "event_id")
        new = F.coalesce((F.col("t") - F.lag("t").over(order) > round(session_end * 1e6)).cast("int"), F.lit(0))
        part = flat.withColumn("new", new).withColumn("part", F.sum("new").over(order))
        start = Window.unboundedPreceding if n is None else 1 - n
        inside = Window.partitionBy("session_id", "part").orderBy("t", "event_id").rowsBetween(start, 0)
        out = part.withColumn("recent", F.collect_list("value").over(inside))
    return out.select("session_id", "event_id", F.timestamp_micros("t").alias("ts"), "value", "mark", "recent")


def clarifies(gloss: Column, top_k: Column | None = None, words: tuple[str, ...] = CLARIFYING_WORDS, top: int = 3) -> Column:
    """A gloss, or one of the first ``top`` of its candidates ``top_k`` (structs with a ``gloss``), is a clarifying word."""
    known = F.array(*map(F.lit, words))
    own = F.array_contains(known, F.lower(gloss))
    if top_k is None:
        return F.coalesce(own, F.lit(False))
    names = F.transform(F.slice(top_k, 1, top), lambda c: F.lower(c["gloss"]))
    return F.coalesce(own, F.lit(False)) | F.coalesce(F.exists(names, lambda g: F.array_contains(known, g)), F.lit(False))


def last_glosses(events: DataFrame, n: int | None = 6, smart: bool = False, words: tuple[str, ...] = CLARIFYING_WORDS, **settings) -> DataFrame:
    """The glosses that a caption is made from at each of ``events(session_id, event_id, ts, gloss[, top_k])``.

    The caption is rebuilt from the last ``n`` glosses; if ``smart``, only where the new gloss or one of its first three
    candidates is a clarifying word, else it goes on from the new gloss alone. Returns ``(session_id, event_id, ts,
    glosses, rebuild)``; settings are those of :func:`recent`.
    """
    top_k = F.col("top_k") if "top_k" in events.columns else None
    mark = clarifies(F.col("gloss"), top_k, words) if smart else F.lit(True)
    out = recent(events, F.col("gloss"), n, mark, **settings)
    glosses = F.when(F.col("mark"), F.col("recent")).otherwise(F.array("value"))
    return out.select("session_id", "event_id", "ts", glosses.alias("glosses"), F.col("mark").alias("rebuild"))


def sentence_context(captions: DataFrame, n: int | None = 2, **settings) -> DataFrame:
    """``(session_id, event_id, ts, sentence, context)``: the ``n`` sentences before each, oldest first.

    Without ``n`` it is all of the session, which grows with it.
    """
    out = recent(captions, F.col("sentence"), None if n is None else n + 1, **settings)
    before = F.slice("recent", 1, F.size("recent") - 1)
    return out.select("session_id", "event_id", "ts", F.col("value").alias("sentence"), before.alias("context"))


def latency_means(calls: DataFrame, n: int = 20, **settings) -> DataFrame:
    """``(session_id, event_id, ts, latency, avg_latency)``: the mean of the last ``n`` latencies at each call."""
    out = recent(calls, F.col("latency").cast("double"), n, **settings)
    mean = F.aggregate("recent", F.lit(0.0), lambda s, x: s + x) / F.size("recent")
    value, mean = (F.coalesce(c, F.lit(float("nan"))) for c in (F.col("value"), mean))  # a stream's walk gives NaN as null
    return out.select("session_id", "event_id", "ts", value.alias("latency"), mean.alias("avg_latency"))


def settled_glosses(
    glosses: DataFrame, calls: DataFrame, within: str = "30 seconds", watermark: str = "10 seconds", until: datetime.datetime | None = None
) -> DataFrame:
    """Which of the pending ``glosses(session_id, gloss_id, ts, gloss)`` a caption used.

    A call ``calls(session_id, since, ts, selections)`` settles the glosses after ``since`` (null: the beginning), up to
    and with its own time, at most ``within`` before it; calls of one session do not overlap. Returns ``(session_id,
    gloss_id, ts, gloss, settled, used)``. ``used`` is whether the gloss is among the selections, in any case; a gloss
    that no call settles in time is dropped (neither). On streams, a join with a time range: both sides leave the
    state with the watermark, and a dropped gloss comes out then. ``until`` is the watermark for tables.
    """
    g = glosses.select(F.col("session_id").alias("session_id"), "gloss_id", F.col("ts").cast("timestamp").alias("ts"), "gloss").where("ts IS NOT NULL")
    c = calls.select(
        F.col("session_id").alias("s"), F.coalesce(F.col("since").cast("timestamp"), F.timestamp_micros(F.lit(0))).alias("since"),
        F.col("ts").cast("timestamp").alias("at"), F.transform("selections", F.lower).alias("selections"),
    ).where("at IS NOT NULL")
    if glosses.isStreaming:
        g, c = g.withWatermark("ts", watermark), c.withWatermark("at", watermark)
    meets = F.expr(f"session_id = s AND ts > since AND ts <= at AND at <= ts + INTERVAL {within}")
    out = g.join(c, meets, "left_outer")
    used = F.coalesce(F.array_contains("selections", F.lower("gloss")), F.lit(False))
    out = out.select("session_id", "gloss_id", "ts", "gloss", F.col("at").isNotNull().alias("settled"), used.alias("used"))
    if until is not None and not glosses.isStreaming:
        out = out.where(F.col("settled") | (F.col("ts") + F.expr(f"INTERVAL {within}") < F.timestamp_micros(F.lit(_at(until)))))
    return out
