"""Queries for what came before in a session, over tables and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossmill.plans.q_captions import _KNOWN, _plain_times, event_stream, events
from glossmill.plans.q_eval import rounded
from glossmill.plans.registry import query
from glossmill.sources.scratch import scratch_path
from glossmill.streaming import captions as C
from glossmill.streaming import context as X

_END = 86400.0
_WORDS = ("who", "signup")

# The last values of a session, which a silence of a day ends; ``known`` is a stream's watermark.
_PARTS = """WITH f AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id, ts, event_type, value FROM events {known}),
g AS (SELECT *, coalesce(CAST(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 86400000000 AS INT), 0) AS new FROM f WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)),
p AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS part FROM g)"""
_STREAMED = f"WHERE epoch_us(ts) / 1e6 < {_KNOWN}"
_GLOSSES = """, r AS (SELECT *, event_type = 'signup' OR value > 450 AS rebuild, list(event_type) OVER (PARTITION BY session_id, part ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS recent FROM p)
SELECT session_id, event_id, ts, CASE WHEN rebuild THEN array_to_string(recent, ' ') ELSE event_type END AS glosses, rebuild FROM r"""
_CONTEXT = """, r AS (SELECT *, list(event_type || ' ' || CAST(event_id AS VARCHAR)) OVER (PARTITION BY session_id, part ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS context FROM p)
SELECT session_id, event_id, ts, event_type || ' ' || CAST(event_id AS VARCHAR) AS sentence, coalesce(array_to_string(context, ' | '), '') AS context FROM r"""
_LATENCY = """ SELECT session_id, event_id, ts, value AS latency, round(avg(value) OVER (PARTITION BY session_id, part ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS avg_latency FROM p"""


def _glosses(rows, **settings):
    """Events with candidates; the second is now and then a clarifying word."""
    second = F.when(F.col("confidence") > 0.9, F.lit("Who")).otherwise(F.lit("none"))
    top_k = F.array(*[F.struct(g.alias("gloss"), F.col("confidence")) for g in (F.col("gloss"), second)])
    return X.last_glosses(rows.withColumn("top_k", top_k), 6, smart=True, words=_WORDS, session_end=_END, **settings)


def _contexts(rows, **settings):
    said = rows.withColumn("sentence", F.concat_ws(" ", "gloss", F.col("event_id").cast("string")))
    return X.sentence_context(said, 2, session_end=_END, **settings)


def _latencies(rows, **settings):
    return X.latency_means(rows.withColumn("latency", F.col("confidence") * 500), 20, session_end=_END, **settings)


def _collected(spark, stream, name):
    """What a stream gives until its input is used up."""
    path = scratch_path(spark, name)
    with X.rocksdb(spark):
        C.run_available(stream, path)
    return spark.read.schema(stream.schema).parquet(path)


def _shown(df, name, between=" "):
    return _plain_times(df.withColumn(name, F.array_join(name, between)), "ts")


@query("last_glosses", _PARTS.format(known="") + _GLOSSES)
def last_glosses(spark, sf_dir):
    return _shown(_glosses(events(spark, sf_dir)), "glosses")


@query("last_glosses_stream", _PARTS.format(known=_STREAMED) + _GLOSSES)
def last_glosses_stream(spark, sf_dir):
    return _shown(_collected(spark, _glosses(event_stream(spark, sf_dir), watermark="1 hour"), "last-glosses"), "glosses")


@query("sentence_context", _PARTS.format(known="") + _CONTEXT)
def sentence_context(spark, sf_dir):
    return _shown(_contexts(events(spark, sf_dir)), "context", " | ")


@query("sentence_context_stream", _PARTS.format(known=_STREAMED) + _CONTEXT)
def sentence_context_stream(spark, sf_dir):
    return _shown(_collected(spark, _contexts(event_stream(spark, sf_dir), watermark="1 hour"), "contexts"), "context", " | ")


@query("latency_means", _PARTS.format(known="") + _LATENCY)
def latency_means(spark, sf_dir):
    return rounded(_plain_times(_latencies(events(spark, sf_dir)), "ts"), "latency", "avg_latency")


@query("latency_means_stream", _PARTS.format(known=_STREAMED) + _LATENCY)
def latency_means_stream(spark, sf_dir):
    return rounded(_plain_times(_collected(spark, _latencies(event_stream(spark, sf_dir), watermark="1 hour"), "latencies"), "ts"), "latency", "avg_latency")


# Purchases are the calls of a caption; each settles what came since the one before and selects two kinds of glosses.
_SETTLED = """WITH c AS (SELECT user_id, ts AS "at", lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS since, value FROM events WHERE event_type = 'purchase')
SELECT CAST(e.user_id AS VARCHAR) AS session_id, e.event_id AS gloss_id, e.ts, e.event_type AS gloss, c."at" IS NOT NULL AS settled,
  c."at" IS NOT NULL AND (e.event_type = 'click' OR e.event_type = CASE WHEN c.value > 250 THEN 'view' ELSE 'signup' END) AS used
FROM events e LEFT JOIN c ON c.user_id = e.user_id AND e.ts <= c."at" AND (c.since IS NULL OR e.ts > c.since) AND c."at" <= e.ts + INTERVAL 12 HOUR
WHERE e.event_type <> 'purchase'"""


def _calls(spark, sf_dir):
    order = Window.partitionBy("session_id").orderBy("ts", "event_id")
    calls = events(spark, sf_dir).where("gloss = 'purchase'").withColumn("since", F.lag("ts").over(order))
    second = F.when(F.col("confidence") > 0.5, F.lit("View")).otherwise(F.lit("Signup"))
    return calls.select("session_id", "since", "ts", F.array(F.lit("CLICK"), second).alias("selections"))


def _pending(rows):
    return rows.where("gloss <> 'purchase'").withColumnRenamed("event_id", "gloss_id")


@query("settled_glosses", _SETTLED)
def settled_glosses(spark, sf_dir):
    return _plain_times(X.settled_glosses(_pending(events(spark, sf_dir)), _calls(spark, sf_dir), "12 hours"), "ts")


_BOTH = "(SELECT (min(t) // 1000 - 3600000) / 1e3 FROM (SELECT max(epoch_us(ts)) AS t FROM events GROUP BY event_type = 'purchase'))"


@query("settled_glosses_stream", f"{_SETTLED} AND (c.\"at\" IS NOT NULL OR epoch_us(e.ts) / 1e6 + 43200 < {_BOTH})")
def settled_glosses_stream(spark, sf_dir):
    """Two streams: pending glosses, and the calls that settle them."""
    path = scratch_path(spark, "calls")
    _calls(spark, sf_dir).write.parquet(path)
    calls = spark.readStream.schema("session_id string, since timestamp, ts timestamp, selections array<string>").parquet(path)
    out = X.settled_glosses(_pending(event_stream(spark, sf_dir)), calls, "12 hours", "1 hour")
    return _plain_times(_collected(spark, out, "settled"), "ts")
