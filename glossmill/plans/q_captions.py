"""Queries for captions, streams, sources and sinks."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossmill.functions import text as T
from glossmill.operators import extras as X
from glossmill.operators import splits
from glossmill.plans import proxies as P
from glossmill.plans.q_eval import rounded
from glossmill.plans.q_splits import _ALL, _assigned
from glossmill.plans.registry import query
from glossmill.sources import readers, sinks
from glossmill.sources.scratch import scratch_path
from glossmill.streaming import captions as C


def events(spark, sf_dir):
    """Gloss events: a user is a session, the event's type the gloss."""
    return _shape(P.table(spark, sf_dir, "events"))


def _shape(df):
    return df.select(
        F.col("user_id").cast("string").alias("session_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("gloss"), (F.col("value") / 500).alias("confidence"),
    )


def event_stream(spark, sf_dir):
    schema = P.table(spark, sf_dir, "events").schema
    return _shape(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*"))


# Both buffers as recursion over the number of the event: each step takes every session's next event.
_SETTINGS = {"pause": 7200.0, "timeout": 36000.0, "session_end": 172800.0, "questions": ("SIGNUP",), "ends": ("ERROR",)}
_DELAY = datetime.timedelta(hours=1)
_KNOWN = "(SELECT (epoch_us(max(ts)) // 1000 - 3600000) / 1e3 FROM events)"


def _watermark(spark, sf_dir):
    """Where the watermark of the streams below ends, in whole milliseconds."""
    micros = P.table(spark, sf_dir, "events").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]
    return datetime.datetime.fromtimestamp(0, datetime.timezone.utc) + datetime.timedelta(milliseconds=micros // 1000) - _DELAY


def _event_sql(until: str | None) -> str:
    known = f"WHERE epoch_us(ts) / 1e6 <= {until}" if until else ""
    return f"""e AS (SELECT CAST(user_id AS VARCHAR) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i,
  epoch_us(ts) / 1e6 AS t, event_type AS g, value / 500 AS c FROM events {known})"""


def _trigger_sql(until: str | None = None) -> str:
    close = "{'at': %s, 'words': %s, 'confs': %s, 'reason': %s}"
    idle = close % ("last_word + 7200", "words", "confs", "CASE WHEN len(words) > 1 THEN 'pause' ELSE 'idle' END")
    return f"""WITH RECURSIVE {_event_sql(until)}, m AS (
  SELECT DISTINCT s, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS words, CAST([] AS DOUBLE[]) AS confs, 0::DOUBLE AS last_word, CAST(NULL AS DOUBLE) AS last_call,
    CAST(NULL AS STRUCT("at" DOUBLE, words VARCHAR[], confs DOUBLE[], reason VARCHAR)) AS o1, CAST(NULL AS STRUCT("at" DOUBLE, words VARCHAR[], confs DOUBLE[], reason VARCHAR)) AS o2 FROM e
  UNION ALL SELECT s, i, CASE WHEN reason IS NULL THEN words ELSE [] END, CASE WHEN reason IS NULL THEN confs ELSE [] END, t, CASE WHEN reason IS NULL THEN last_call ELSE t END,
    o1, CASE WHEN reason IS NOT NULL THEN {close % ("t", "words", "confs", "reason")} END
  FROM (SELECT *, CASE WHEN len(words) >= 3 THEN 'full' WHEN upper(g) = 'SIGNUP' AND len(words) > 1 THEN 'question' WHEN upper(g) = 'ERROR' THEN 'end' WHEN t - last_call > 36000 THEN 'timeout' END AS reason
    FROM (SELECT s, i, t, g, CASE WHEN due THEN [g] ELSE list_append(words, g) END AS words, CASE WHEN due THEN [c] ELSE list_append(confs, c) END AS confs, CASE WHEN due THEN {idle} END AS o1,
        CASE WHEN t - last_word > 172800 THEN t ELSE coalesce(CASE WHEN due THEN last_word + 7200 ELSE last_call END, t) END AS last_call
      FROM (SELECT m.s, e.i, m.words, m.confs, m.last_word, m.last_call, len(m.words) > 0 AND e.t - m.last_word > 7200 AS due, e.t, e.g, e.c FROM m JOIN e ON e.s = m.s AND e.i = m.i + 1)))),
z AS (SELECT s, arg_max(words, i) AS words, arg_max(confs, i) AS confs, max(last_word) AS last_word FROM m GROUP BY 1),
o AS (SELECT s, o1 AS o FROM m UNION ALL SELECT s, o2 FROM m UNION ALL SELECT s, {idle} FROM z WHERE len(words) > 0 {f"AND {until} - last_word > 7200" if until else ""})
SELECT s AS session_id, make_timestamp(CAST(round(o.at * 1e6) AS BIGINT)) AS ts, array_to_string(o.words, ' ') AS text, len(o.words) AS n, round(list_sum(o.confs) / len(o.confs), 6) AS confidence, o.reason AS reason FROM o WHERE o IS NOT NULL"""


def _count_sql(until: str | None = None) -> str:
    return f"""WITH RECURSIVE {_event_sql(until)}, m AS (
  SELECT DISTINCT s, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS waiting, CAST(0 AS BIGINT) AS total, 0::DOUBLE AS last_word, CAST(NULL AS DOUBLE) AS last_call,
    CAST(NULL AS BIGINT) AS sent, CAST(NULL AS BIGINT) AS rest, CAST(NULL AS DOUBLE) AS rest_at FROM e
  UNION ALL SELECT s, i, CASE WHEN out THEN 0 ELSE waiting END, total, t, CASE WHEN out THEN t ELSE last_call END, CASE WHEN out THEN waiting END, rest, rest_at
  FROM (SELECT *, waiting >= 3 AND coalesce(t - last_call >= 7200, true) AS out
    FROM (SELECT e.s, e.i, e.t, CASE WHEN t - last_word > 172800 THEN 1 ELSE waiting + 1 END AS waiting, CASE WHEN t - last_word > 172800 THEN 1 ELSE total + 1 END AS total,
      CASE WHEN t - last_word <= 172800 THEN last_call END AS last_call, CASE WHEN t - last_word > 172800 AND waiting > 0 THEN total END AS rest, last_word AS rest_at FROM m JOIN e ON e.s = m.s AND e.i = m.i + 1))),
z AS (SELECT s, arg_max(waiting, i) AS waiting, arg_max(total, i) AS total, max(last_word) AS last_word FROM m GROUP BY 1),
o AS (SELECT s, last_word AS t, sent AS n, false AS is_rest FROM m WHERE sent IS NOT NULL UNION ALL SELECT s, rest_at, rest, true FROM m WHERE rest IS NOT NULL
  UNION ALL SELECT s, last_word, total, true FROM z WHERE waiting > 0 {f"AND {until} - last_word > 172800" if until else ""})
SELECT s AS session_id, make_timestamp(CAST(round(t * 1e6) AS BIGINT)) AS ts, n, is_rest FROM o"""


@query("trigger_captions", _trigger_sql())
def trigger_captions(spark, sf_dir):
    return rounded(_plain_times(C.trigger_captions(events(spark, sf_dir), **_SETTINGS), "ts"), "confidence")


@query("trigger_caption_stream", _trigger_sql(_KNOWN))
def trigger_caption_stream(spark, sf_dir):
    path = scratch_path(spark, "captions")
    C.run_available(C.trigger_caption_stream(event_stream(spark, sf_dir), "1 hour", **_SETTINGS), path)
    return rounded(_plain_times(spark.read.schema(C.CAPTION).parquet(path), "ts"), "confidence")


@query("count_batches", _count_sql())
def count_batches(spark, sf_dir):
    return _plain_times(C.count_batches(events(spark, sf_dir), 3, 7200.0, session_end=172800.0), "ts")


@query("count_batch_stream", _count_sql(_KNOWN))
def count_batch_stream(spark, sf_dir):
    path = scratch_path(spark, "counted")
    C.run_available(C.count_batch_stream(event_stream(spark, sf_dir), "1 hour", 3, 7200.0, 172800.0), path)
    return _plain_times(spark.read.schema(C.COUNTED).parquet(path), "ts")


_SIGN_WINDOWS = """WITH v AS (SELECT CAST(user_id AS VARCHAR) AS session_id, ts, event_id FROM events WHERE value > 50),
g AS (SELECT *, coalesce(CAST(ts - lag(ts) OVER w >= INTERVAL 6 HOUR AS INT), 0) AS new FROM v WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS block FROM g)
SELECT session_id, min(ts) AS start_ts, max(ts) AS last_ts, count(*) AS moving FROM b GROUP BY session_id, block"""


def _moving(frames):
    return frames.withColumn("moves", F.col("confidence") * 500 > 50)


@query("sign_windows", _SIGN_WINDOWS)
def sign_windows(spark, sf_dir):
    return _plain_times(C.sign_windows(_moving(events(spark, sf_dir)), "6 hours"), "start_ts", "last_ts")


@query("sign_windows_stream", f"{_SIGN_WINDOWS} HAVING epoch_us(max(ts)) / 1e6 + 21600 <= (SELECT (epoch_us(max(ts)) // 1000 - 3600000) / 1e3 FROM events WHERE value > 50)")
def sign_windows_stream(spark, sf_dir):
    path = scratch_path(spark, "signs")
    frames = _moving(event_stream(spark, sf_dir)).where("moves").withWatermark("ts", "1 hour")
    C.run_available(C.sign_windows(frames, "6 hours"), path)
    return _plain_times(spark.read.schema("session_id string, start_ts timestamp, last_ts timestamp, moving long").parquet(path), "start_ts", "last_ts")


_EV = "ev AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id, ts, event_type AS gloss, value / 500 AS confidence FROM events)"


@query(
    "session_captions",
    f"""WITH {_EV}, g AS (SELECT *, coalesce(CAST(ts - lag(ts) OVER w >= INTERVAL 2 HOUR AS INT), 0) AS new FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS block FROM g)
SELECT session_id, min(ts) AS start_ts, max(ts) + INTERVAL 2 HOUR AS end_ts, string_agg(gloss, ' ' ORDER BY ts, event_id) AS glosses, round(avg(confidence), 6) AS confidence FROM b GROUP BY session_id, block""",
)
def session_captions(spark, sf_dir):
    out = C.session_captions(events(spark, sf_dir), "2 hours").withColumn("glosses", F.array_join("glosses", " "))
    return rounded(_plain_times(out, "start_ts", "end_ts"), "confidence")


def _plain_times(df, *names):
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


_COUNTS = f"WITH {_EV} SELECT session_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start_ts, gloss, count(*) AS n FROM ev GROUP BY 1, 2, 3"


@query("gloss_counts", _COUNTS)
def gloss_counts(spark, sf_dir):
    return _plain_times(C.gloss_counts(events(spark, sf_dir), "6 hours"), "start_ts")


@query("gloss_counts_stream", _COUNTS)
def gloss_counts_stream(spark, sf_dir):
    path = scratch_path(spark, "counts")
    C.run_available(C.gloss_counts(event_stream(spark, sf_dir), "6 hours"), path, "complete")
    return _plain_times(spark.read.parquet(path), "start_ts")


@query("last_n", f"WITH {_EV}, l AS (SELECT session_id, event_id, list(gloss) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS r FROM ev) SELECT session_id, event_id, array_to_string(r, ' ') AS recent FROM l")
def last_n(spark, sf_dir):
    return C.last_n(events(spark, sf_dir)).select("session_id", "event_id", F.array_join("recent", " ").alias("recent"))


@query(
    "sign_activity",
    """WITH n AS (SELECT CAST(user_id AS VARCHAR) AS session_id, value > 50 AS moves, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
g AS (SELECT *, coalesce(CAST(i - lag(i) OVER (PARTITION BY session_id ORDER BY i) > 3 AS INT), 0) AS new FROM n WHERE moves), b AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS sign_no FROM g)
SELECT session_id, CAST(sign_no AS BIGINT) AS sign_no, min(i) AS start_frame, max(i) AS end_frame, count(*) AS moving FROM b GROUP BY 1, 2""",
)
def sign_activity(spark, sf_dir):
    return C.sign_activity(_moving(events(spark, sf_dir)))


@query(
    "caption_triggers",
    f"""WITH {_EV}, x AS (SELECT *, row_number() OVER w % 4 AS n, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w), 0) / 3.6e9::DOUBLE AS gap FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN gap > 1.8 AND n >= 2 THEN 'pause' WHEN n >= 3 THEN 'full' WHEN gloss = 'signup' AND n >= 2 THEN 'question' WHEN gloss = 'error' THEN 'end' WHEN gap * 2 > 10 THEN 'timeout' END AS reason FROM x""",
)
def caption_triggers(spark, sf_dir):
    order = Window.partitionBy("session_id").orderBy("ts", "event_id")
    us = F.unix_micros("ts")
    gap = F.coalesce(us - F.lag(us).over(order), F.lit(0)) / 3.6e9
    rows = events(spark, sf_dir).withColumn("n", F.row_number().over(order) % 4).withColumn("gap", gap)
    return rows.select("event_id", X.caption_trigger(F.col("gloss"), F.col("n"), F.col("gap"), F.col("gap") * 2, ("SIGNUP",), ("ERROR",)).alias("reason"))


@query(
    "quick_reply",
    """SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)\\b(hello|hi|hey)\\b') THEN 'Hello!' WHEN regexp_matches(text, '(?i)\\b(thanks|thank you)\\b') THEN 'You are welcome.'
WHEN regexp_matches(text, '(?i)\\bhow are you\\b') THEN 'I am fine, and you?' WHEN regexp_matches(text, '(?i)\\b(bye|goodbye)\\b') THEN 'Goodbye!' END AS reply FROM conversations""",
)
def quick_reply(spark, sf_dir):
    return P.table(spark, sf_dir, "conversations").select("conv_id", "turn", X.quick_reply(F.col("text")).alias("reply"))


@query(
    "join_by_position",
    f"""WITH {P.ENTRIES_SQL}, r AS (SELECT entry_id, unnest(range(greatest(len(glosses), len(predicted)))) AS position, glosses, predicted FROM entries)
SELECT entry_id, position, coalesce(predicted[position + 1], '[NONE]') AS predicted, coalesce(glosses[position + 1], '[NONE]') AS truth,
coalesce(predicted[position + 1], '[NONE]') = coalesce(glosses[position + 1], '[NONE]') AS matches FROM r""",
)
def join_by_position(spark, sf_dir):
    return X.join_by_position(P.entries(spark, sf_dir).withColumnRenamed("glosses", "truth"))


@query(
    "baseline_vs_model",
    f"WITH {P.SCORES_SQL} SELECT entry_id, round(avg(baseline), 7) AS baseline, round(avg(model), 7) AS model, round(avg(model) - avg(baseline), 7) AS change FROM scores GROUP BY 1",
)
def baseline_vs_model(spark, sf_dir):
    long = P.scores(spark, sf_dir).select("entry_id", F.expr("stack(2, 'baseline', baseline, 'model', model) AS (run, value)"))
    return X.baseline_vs_model(long, "value").withColumns({c: F.round(c, 7) for c in ("baseline", "model", "change")})


@query(
    "effective_glosses",
    f"""WITH {P.PREDICTIONS_SQL} SELECT video_id, aug_id, signer_id, true_gloss, CASE WHEN true_gloss IN (g1, g2, g3) THEN true_gloss ELSE g1 END AS used FROM predictions""",
)
def effective_glosses(spark, sf_dir):
    positions = F.array(F.transform("top_k", lambda c: c["gloss"]))
    used = T.effective_glosses(positions, F.array().cast("array<string>"), F.concat(F.lit("We said "), F.lower("true_gloss"), F.lit(".")))
    return P.predictions(spark, sf_dir).select("video_id", "aug_id", "signer_id", "true_gloss", used[0].alias("used"))


@query(
    "parse_response",
    "SELECT event_id, event_type || ' ' || CAST(user_id AS VARCHAR) AS sentence, 2 AS n FROM events",
)
def parse_response(spark, sf_dir):
    said = F.concat_ws(" ", "event_type", F.col("user_id").cast("string"))
    body = F.to_json(F.struct(said.alias("sentence"), F.array("event_type", F.col("user_id").cast("string")).alias("selections")))
    parsed = T.parse_response(F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```")))
    return P.table(spark, sf_dir, "events").select("event_id", parsed.alias("p")).select("event_id", "p.sentence", F.size("p.selections").alias("n"))


@query("gloss_stream_round_trip", "SELECT event_type AS gloss, count(*) AS n, round(sum(value / 500), 4) AS confidence FROM events GROUP BY 1")
def gloss_stream_round_trip(spark, sf_dir):
    """Events written as JSON lines, read as a stream and counted."""
    path = scratch_path(spark, "gloss-lines")
    events(spark, sf_dir).write.json(path)
    out = scratch_path(spark, "gloss-rows")
    C.run_available(readers.read_gloss_stream(spark, path), out)
    return spark.read.parquet(out).groupBy("gloss").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"))


@query("baseline_sentence", f"WITH {P.ENTRIES_SQL} SELECT entry_id, array_to_string(glosses, ' ') || '.' AS sentence FROM entries")
def baseline_sentence(spark, sf_dir):
    return P.entries(spark, sf_dir).select("entry_id", T.baseline_sentence(F.col("glosses")).alias("sentence"))


@query("ms_to_frame", "SELECT event_id, CAST(epoch_us(ts) // 1000 % 86400000 / 1000 * 25 AS INT) AS frame FROM events")
def ms_to_frame(spark, sf_dir):
    return P.table(spark, sf_dir, "events").select("event_id", T.ms_to_frame(F.expr("unix_millis(CAST(ts AS timestamp)) % 86400000"), 25).alias("frame"))


@query("manifest_round_trip", f"{_ALL} SELECT split, gloss, CAST(video_id AS VARCHAR) AS video_id, bucket AS frame_bucket, 'pool/' || clip_id || '.pkl' AS file FROM assigned JOIN families USING (gloss, video_id)")
def manifest_round_trip(spark, sf_dir):
    buckets = splits.families(P.clips(spark, sf_dir)).select("gloss", "video_id", F.col("bucket").alias("frame_bucket"))
    files = _assigned(spark, sf_dir).join(buckets, ["gloss", "video_id"]).withColumn("file", F.concat("clip_id", F.lit(".pkl")))
    path = scratch_path(spark, "manifest")
    sinks.write_manifest(files.select("split", "gloss", "video_id", "frame_bucket", "file"), path, "pool")
    return readers.read_manifest(spark, path)


@query("assignment_round_trip", f"{_ALL} SELECT split, count(*) AS n, count(DISTINCT gloss) AS glosses FROM assigned GROUP BY 1")
def assignment_round_trip(spark, sf_dir):
    path = scratch_path(spark, "assignment")
    sinks.write_assignment(_assigned(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("gloss").alias("glosses"))


@query("report_round_trip", "SELECT p_brand AS gloss, count(*) AS n FROM part GROUP BY 1")
def report_round_trip(spark, sf_dir):
    path = scratch_path(spark, "report")
    sinks.write_report(P.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("gloss")).agg(F.count("*").alias("n")), path)
    return spark.read.schema("gloss string, n long").json(path)


@query("survey_round_trip", "SELECT CAST(o_orderkey AS VARCHAR) AS rater, i AS sentence_id, CAST((o_orderkey + i) % 5 + 1 AS INT) AS rating FROM orders, range(5) t(i) WHERE (o_orderkey + i) % 7 <> 0")
def survey_round_trip(spark, sf_dir):
    cells = [F.when((F.col("o_orderkey") + i) % 7 == 0, "n/a").otherwise(((F.col("o_orderkey") + i) % 5 + 1).cast("string")).alias(f"s{i}") for i in range(5)]
    path = scratch_path(spark, "survey")
    P.table(spark, sf_dir, "orders").select("o_orderkey", F.lit("x").alias("a"), F.lit("y").alias("b"), F.lit("z").alias("c"), *cells).write.csv(path, header=True)
    return readers.read_survey(spark, path, 4, 5)


@query(
    "predictions_round_trip",
    f"WITH {P.PREDICTIONS_SQL} SELECT true_gloss, count(*) AS n, round(sum(c1), 4) AS confidence FROM predictions GROUP BY 1",
)
def predictions_round_trip(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    P.predictions(spark, sf_dir).write.json(path)
    back = readers.read_predictions(spark, path)
    return back.groupBy("true_gloss").agg(F.count("*").alias("n"), F.round(F.sum(F.col("top_k")[0]["confidence"]), 4).alias("confidence"))
