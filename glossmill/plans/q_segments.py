"""Queries for motion segments, intervals and frame ranges."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossmill.operators import segments as S
from glossmill.plans import proxies as P
from glossmill.plans.q_eval import rounded
from glossmill.plans.registry import query

_WITH = f"WITH {P.MOTION_SQL}"
_W = "(PARTITION BY clip_id ORDER BY frame_idx {})"


@query(
    "velocity",
    f"""WITH {P.FRAMES_SQL}, b AS (SELECT *, lag(kp) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS p FROM frames)
SELECT clip_id, frame_idx, round(CASE WHEN p IS NULL THEN 0 ELSE list_sum([sqrt((kp[i][1] - p[i][1]) ** 2 + (kp[i][2] - p[i][2]) ** 2 + (kp[i][3] - p[i][3]) ** 2) for i in range(1, 22)]) / 21 END, 6) AS v FROM b""",
)
def velocity(spark, sf_dir):
    return rounded(S.velocity(P.frames(spark, sf_dir)).select("clip_id", "frame_idx", "v"), "v")


@query("smooth", f"{_WITH} SELECT clip_id, frame_idx, round(sum(v) OVER {_W.format('ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING')} / 5, 6) AS smooth FROM motion")
def smooth(spark, sf_dir):
    return rounded(S.smooth(P.motion(spark, sf_dir)).drop("v"), "smooth")


_SEG_SQL = f"""sm AS (SELECT clip_id, frame_idx, sum(v) OVER {_W.format('ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING')} / 5 AS s FROM motion),
th AS (SELECT clip_id, count(*) AS n_frames, CASE WHEN max(s) > 1 THEN greatest(0.2 * median(s) FILTER (s > 0), 0.02 * max(s)) ELSE 0.02 END * 4 AS threshold FROM sm GROUP BY 1),
act AS (SELECT sm.*, n_frames FROM sm JOIN th USING (clip_id) WHERE s > threshold),
isl AS (SELECT *, frame_idx - lag(frame_idx) OVER {_W.format('')} - 1 >= 3 AS new FROM act),
num AS (SELECT *, sum(CAST(coalesce(new, false) AS INT)) OVER {_W.format('ROWS UNBOUNDED PRECEDING')} AS island FROM isl),
runs AS (SELECT clip_id, island, min(frame_idx) AS a, max(frame_idx) AS b, min(n_frames) AS n_frames FROM num GROUP BY 1, 2),
kept AS (SELECT *, max(island) OVER (PARTITION BY clip_id) AS last FROM runs),
segs AS (SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY a) AS seg_no, greatest(a - 1, 0) AS start_frame, least(b + 1, n_frames - 1) AS end_frame
  FROM kept WHERE b - a >= 2 AND (b - a <= 20 OR island = last))"""


def _segments(spark, sf_dir):
    frames = S.motion_threshold(S.smooth(P.motion(spark, sf_dir)))
    n = F.count("*").over(Window.partitionBy("clip_id"))
    moving = frames.withColumn("n_frames", n).withColumn("moves", F.col("smooth") > F.col("threshold") * 4)
    return S.motion_segments(moving, 2, 20, 3, 1)


@query("motion_segments", f"{_WITH}, {_SEG_SQL} SELECT * FROM segs")
def motion_segments(spark, sf_dir):
    return _segments(spark, sf_dir)


@query("longest_region", f"{_WITH}, {_SEG_SQL} SELECT clip_id, start_frame, end_frame FROM segs QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY end_frame - start_frame DESC, start_frame) = 1")
def longest_region(spark, sf_dir):
    return S.longest_region(_segments(spark, sf_dir))


@query("frames_in_segments", f"{_WITH}, {_SEG_SQL} SELECT m.clip_id, m.frame_idx, m.v, seg_no FROM motion m JOIN segs s ON m.clip_id = s.clip_id AND m.frame_idx BETWEEN start_frame AND end_frame")
def frames_in_segments(spark, sf_dir):
    return S.frames_in_segments(P.motion(spark, sf_dir), _segments(spark, sf_dir), 8).drop("start_frame", "end_frame")


@query(
    "frame_to_segment",
    f"""{_WITH}, {_SEG_SQL}, nb AS (SELECT *, coalesce(sum(CAST(seg_no % 2 = 0 AS INT)) OVER (PARTITION BY clip_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence_no FROM segs)
SELECT m.clip_id, m.frame_idx, m.v, min(seg_no) AS seg_no, CAST(arg_min(sentence_no, seg_no) AS BIGINT) AS sentence_no
FROM motion m LEFT JOIN nb s ON m.clip_id = s.clip_id AND m.frame_idx BETWEEN start_frame AND end_frame GROUP BY 1, 2, 3""",
)
def frame_to_segment(spark, sf_dir):
    segs = _segments(spark, sf_dir).withColumn("sentence_break_after", F.col("seg_no") % 2 == 0)
    return S.frame_to_segment(P.motion(spark, sf_dir), segs)


@query("rolling_peak", f"{_WITH} SELECT clip_id, frame_idx, v, max(v) OVER {_W.format('ROWS BETWEEN 4 PRECEDING AND CURRENT ROW')} AS peak FROM motion")
def rolling_peak(spark, sf_dir):
    return S.rolling_peak(P.motion(spark, sf_dir))


@query(
    "most_active_window",
    f"""{_WITH}, t AS (SELECT *, sum(v) OVER {_W.format('ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING')} AS s, count(*) OVER (PARTITION BY clip_id) AS n FROM motion)
SELECT clip_id, frame_idx AS start_frame, round(s, 6) AS motion FROM t WHERE frame_idx + 10 <= n OR frame_idx = 0 QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY round(s, 9) DESC, frame_idx) = 1""",
)
def most_active_window(spark, sf_dir):
    return rounded(S.most_active_window(P.motion(spark, sf_dir), 10), "motion")


@query(
    "motion_profile",
    f"""{_WITH} SELECT clip_id, frame_idx // 30 AS chunk, round(avg(v), 6) AS mean, max(v) AS max, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75 FROM motion GROUP BY 1, 2""",
)
def motion_profile(spark, sf_dir):
    return rounded(S.motion_profile(P.motion(spark, sf_dir)), "mean", "p25", "p50", "p75")


_ORDERS = "SELECT o_orderkey AS clip_id, CAST(floor(o_totalprice / 1000) AS INT) AS n_frames FROM orders"


def _orders(spark, sf_dir):
    return P.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("clip_id"), F.floor(F.col("o_totalprice") / 1000).cast("int").alias("n_frames"))


@query("sliding_scan", f"WITH c AS ({_ORDERS}), s AS (SELECT *, unnest(range(0, greatest(n_frames - 40, 0) + 1, 20)) AS start_frame FROM c) SELECT clip_id, start_frame, least(start_frame + 40, n_frames) AS end_frame FROM s")
def sliding_scan(spark, sf_dir):
    return S.sliding_scan(_orders(spark, sf_dir))


@query(
    "fixed_segments",
    f"""WITH c AS ({_ORDERS}), n AS (SELECT *, CAST(floor((n_frames - 2.0::DOUBLE + 0.5) / 2.5) AS INT) AS n FROM c), k AS (SELECT *, unnest(range(n)) AS k FROM n WHERE n > 0)
SELECT clip_id, k, CAST(trunc((1 + k * 2.5::DOUBLE) * 25) AS INT) AS start_frame, CAST(trunc(least(1 + k * 2.5::DOUBLE + 2, n_frames) * 25) AS INT) AS end_frame FROM k""",
)
def fixed_segments(spark, sf_dir):
    clips = _orders(spark, sf_dir).select("clip_id", F.col("n_frames").cast("double").alias("seconds"))
    return S.fixed_segments(clips, sign=2.0, pause=0.5, pad=1.0, fps=25.0)


_PARTS = "SELECT l_orderkey AS clip_id, CAST(l_quantity AS INT) AS n_frames, (l_linenumber, l_partkey, l_suppkey) AS pos, l_linenumber, l_partkey, l_suppkey FROM lineitem"


@query(
    "offsets",
    f"""WITH p AS ({_PARTS}), o AS (SELECT *, coalesce(sum(n_frames) OVER (PARTITION BY clip_id ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM p)
SELECT clip_id, l_linenumber, l_partkey, l_suppkey, CAST(s AS BIGINT) AS start_frame, CAST(s + n_frames - 1 AS BIGINT) AS end_frame FROM o""",
)
def offsets(spark, sf_dir):
    parts = P.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("clip_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"), F.col("l_quantity").cast("int").alias("n_frames")
    )
    return S.offsets(parts).select("clip_id", "pos.*", "start_frame", "end_frame")


def _glosses(spark, sf_dir):
    return P.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), F.struct("ts", "event_id").alias("pos"), F.col("event_type").alias("gloss"), (F.col("value") > 60).alias("break_after")
    )


_GL = "SELECT user_id AS session_id, ts, event_id, event_type AS gloss, value > 60 AS brk FROM events"


@query(
    "sentence_groups",
    f"""WITH g AS ({_GL}), b AS (SELECT *, coalesce(lag(CAST(brk AS INT)) OVER w, 0) AS c FROM g WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(c) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sentence_no FROM b)
SELECT session_id, CAST(sentence_no AS BIGINT) AS sentence_no, string_agg(gloss, ' ' ORDER BY ts, event_id) AS glosses FROM n GROUP BY 1, 2""",
)
def sentence_groups(spark, sf_dir):
    return S.sentence_groups(_glosses(spark, sf_dir)).withColumn("glosses", F.array_join("glosses", " "))


@query(
    "caption_batches",
    f"""WITH g AS ({_GL}), n AS (SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) - 1) // 3 AS batch FROM g)
SELECT session_id, batch, string_agg(gloss, ' ' ORDER BY ts, event_id) AS glosses FROM n GROUP BY 1, 2""",
)
def caption_batches(spark, sf_dir):
    return S.caption_batches(_glosses(spark, sf_dir)).withColumn("glosses", F.array_join("glosses", " "))


_IV = f"WITH {P.INTERVALS_SQL}"
_MERGE = """mb AS (SELECT *, coalesce(CAST(start_ms - max(end_ms) OVER (PARTITION BY video_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 600000 AS INT), 0) AS new FROM annotations),
mm AS (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS block FROM mb),
merged AS (SELECT video_id, CAST(block AS BIGINT) AS block, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS parts FROM mm GROUP BY 1, 2)"""


@query("merge_intervals", f"{_IV}, {_MERGE} SELECT * FROM merged")
def merge_intervals(spark, sf_dir):
    return S.merge_intervals(P.annotations(spark, sf_dir), 600_000)


@query(
    "merge_short_intervals",
    """WITH RECURSIVE a AS (SELECT user_id AS v, epoch_us(ts) // 1000 AS s, epoch_us(ts) // 1000 + CAST(floor(value * 100000) AS BIGINT) AS e FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY s, e) AS i FROM a),
m AS (SELECT v, i, s, e, CAST(1 AS BIGINT) AS parts, s AS first FROM n WHERE i = 1
  UNION ALL SELECT v, i, CASE WHEN j THEN ms ELSE s END, CASE WHEN j THEN greatest(me, e) ELSE e END, CASE WHEN j THEN parts + 1 ELSE 1 END, CASE WHEN j THEN first ELSE s END
  FROM (SELECT n.v, n.i, n.s, n.e, m.s AS ms, m.e AS me, m.parts, m.first, n.s - m.e <= 3600000 AND m.e - m.s < 20000000 AND n.e - n.s < 20000000 AS j FROM m JOIN n ON n.v = m.v AND n.i = m.i + 1)),
k AS (SELECT *, coalesce(lead(parts) OVER (PARTITION BY v ORDER BY i), 1) = 1 AS done FROM m)
SELECT v AS video_id, s AS start_ms, e AS end_ms, parts FROM k WHERE done""",
)
def merge_short_intervals(spark, sf_dir):
    return S.merge_short_intervals(P.annotations(spark, sf_dir), 3_600_000, 20_000_000)


@query(
    "merge_annotations",
    """WITH RECURSIVE a AS (SELECT user_id AS v, epoch_us(ts) // 1000 AS s, epoch_us(ts) // 1000 + CAST(floor(value * 100000) AS BIGINT) AS e FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY s, e) AS i FROM a),
m AS (SELECT v, i, s, e, CAST(1 AS BIGINT) AS parts FROM n WHERE i = 1
  UNION ALL SELECT v, i, CASE WHEN j THEN ms ELSE s END, e, CASE WHEN j THEN parts + 1 ELSE 1 END
  FROM (SELECT n.v, n.i, n.s, n.e, m.s AS ms, m.parts, n.s - m.e < 600000 OR (n.s - m.e < 7200000 AND (m.e - m.s < 3000000 OR n.e - n.s < 3000000)) AS j FROM m JOIN n ON n.v = m.v AND n.i = m.i + 1)),
k AS (SELECT *, coalesce(lead(parts) OVER (PARTITION BY v ORDER BY i), 1) = 1 AS done FROM m)
SELECT v AS video_id, s AS start_ms, e AS end_ms, parts FROM k WHERE done""",
)
def merge_annotations(spark, sf_dir):
    return S.merge_annotations(P.annotations(spark, sf_dir), 600_000, 7_200_000, 3_000_000)


@query(
    "extend_intervals",
    f"""{_IV}, f AS (SELECT *, CASE WHEN end_ms - start_ms < 700000 THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END AS k FROM annotations),
w AS (SELECT *, greatest(start_ms - CAST(floor(300000 * k) AS BIGINT), 0) AS a, end_ms + CAST(floor(400000 * k) AS BIGINT) AS b FROM f),
n AS (SELECT *, lag(b) OVER o AS pb, lead(a) OVER o AS na FROM w WINDOW o AS (PARTITION BY video_id ORDER BY start_ms, end_ms))
SELECT video_id, annotation_id, text, CASE WHEN pb > a THEN (pb + a) // 2 ELSE a END AS start_ms, CASE WHEN na < b THEN (b + na) // 2 ELSE b END AS end_ms FROM n""",
)
def extend_intervals(spark, sf_dir):
    return S.extend_intervals(P.annotations(spark, sf_dir), 300_000, 400_000, 700_000)


@query(
    "fill_gaps",
    f"""{_IV}, s AS (SELECT * FROM annotations WHERE text <> 'click'), q AS (SELECT * FROM annotations WHERE text = 'click'),
g AS (SELECT video_id, end_ms AS a, lead(start_ms) OVER (PARTITION BY video_id ORDER BY start_ms, end_ms) AS b FROM s), gg AS (SELECT * FROM g WHERE b - a > 2000),
i AS (SELECT gg.*, min((q.start_ms, q.end_ms)) AS x FROM gg JOIN q ON q.video_id = gg.video_id AND q.start_ms >= a AND q.end_ms <= b GROUP BY ALL),
o AS (SELECT gg.*, i.x, least(least(greatest(CAST(floor((gg.b - gg.a) * 0.6::DOUBLE) AS BIGINT), 1000), 3000), gg.b - gg.a - 400) AS length FROM gg LEFT JOIN i ON i.video_id = gg.video_id AND i.a = gg.a AND i.b = gg.b)
SELECT video_id, coalesce(x[1], (a + b) // 2 - length // 2) AS start_ms, coalesce(x[2], (a + b) // 2 - length // 2 + length) AS end_ms, x IS NULL AS synthetic FROM o WHERE x IS NOT NULL OR b - a - 400 > 500""",
)
def fill_gaps(spark, sf_dir):
    every = P.annotations(spark, sf_dir)
    return S.fill_gaps(every.where("text != 'click'"), every.where("text = 'click'"))


@query(
    "video_type",
    f"""{_IV}, r AS (SELECT *, start_ms - lag(end_ms) OVER (PARTITION BY video_id ORDER BY start_ms, end_ms) AS gap, end_ms - start_ms AS length FROM annotations),
p AS (SELECT video_id, count(*) AS n, avg(gap) AS avg_gap, stddev_pop(length) AS std_length, avg(length) AS avg_length FROM r GROUP BY 1),
s AS (SELECT *, CAST(avg_gap > 500 AS INT) + CAST(std_length < 0.5 * avg_length AS INT) + CAST(avg_length > 1000 AS INT) AS score FROM p)
SELECT video_id, n, round(avg_gap, 3) AS avg_gap, round(std_length, 3) AS std_length, round(avg_length, 3) AS avg_length, score,
       CASE WHEN avg_gap IS NULL THEN 'mixed' WHEN score >= 2 THEN 'concatenated' WHEN score = 1 THEN 'mixed' ELSE 'continuous' END AS type FROM s""",
)
def video_type(spark, sf_dir):
    out = S.video_type(P.annotations(spark, sf_dir))
    return out.withColumns({c: F.round(c, 3) for c in ("avg_gap", "std_length", "avg_length")})


@query(
    "valleys",
    """WITH RECURSIVE f AS (SELECT user_id AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS v FROM events),
l AS (SELECT *, min(v) OVER w AS low, max(v) OVER w AS high FROM f WINDOW w AS (PARTITION BY c ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
d AS (SELECT c, i FROM l WHERE v = low AND v < 0.2::DOUBLE * high),
k AS (SELECT c, min(i) AS i FROM d GROUP BY 1 UNION ALL SELECT k.c, (SELECT min(d.i) FROM d WHERE d.c = k.c AND d.i >= k.i + 5) AS i FROM k WHERE EXISTS (SELECT 1 FROM d WHERE d.c = k.c AND d.i >= k.i + 5))
SELECT c AS clip_id, i AS frame_idx FROM k""",
)
def valleys(spark, sf_dir):
    return S.valleys(P.motion(spark, sf_dir))


_TRIM = "t AS (SELECT clip_id, frame_idx, CASE WHEN v < 120 THEN v END AS y FROM motion)"


@query(
    "trim_signing_region",
    f"""{_WITH}, {_TRIM}, p AS (SELECT clip_id, count(*) AS n, count(y) AS valid, min(y) AS top, max(y) AS bottom FROM t GROUP BY 1),
r AS (SELECT * FROM t JOIN p USING (clip_id)), m AS (SELECT clip_id, min(frame_idx) FILTER (y < bottom - 0.4 * (bottom - top)) AS f, max(frame_idx) FILTER (y < bottom - 0.4 * (bottom - top)) AS l FROM r GROUP BY 1),
x AS (SELECT r.*, CASE WHEN bottom - top < 60 THEN CAST(floor(n * 0.5) AS BIGINT) ELSE f END AS a, CASE WHEN bottom - top < 60 THEN CAST(floor(n * 0.9::DOUBLE) AS BIGINT) ELSE l END AS b FROM r JOIN m USING (clip_id))
SELECT clip_id, frame_idx, y FROM x WHERE coalesce(valid < 0.3 * n OR a IS NULL OR b - a + 1 < 8, true) OR frame_idx BETWEEN a AND b""",
)
def trim_signing_region(spark, sf_dir):
    rows = P.motion(spark, sf_dir).select("clip_id", "frame_idx", F.when(F.col("v") < 120, F.col("v")).alias("y"))
    return S.trim_signing_region(rows, 8, 60.0)
