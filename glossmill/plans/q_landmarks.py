"""Queries over frame tables: landmarks, features, augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossmill.functions import geometry as G
from glossmill.operators import landmarks as L
from glossmill.operators import splits
from glossmill.plans import proxies as P
from glossmill.plans.q_eval import rounded
from glossmill.plans.registry import query
from glossmill.sources import readers, sinks
from glossmill.sources.scratch import scratch_path

_WITH = f"WITH {P.FRAMES_SQL}"
_LEFT, _RIGHT = list(range(0, 5)), list(range(5, 10))


def _sum(df, digits=6):
    return df.select("clip_id", "frame_idx", F.round(L.energy(F.col("kp")), digits).alias("s"))


@query("select_landmarks", f"{_WITH} SELECT clip_id, frame_idx, round(kp[1][1] + kp[1][2] + kp[6][1] + kp[6][2] + kp[18][1] + kp[18][2], 6) AS s FROM frames")
def select_landmarks(spark, sf_dir):
    return _sum(P.frames(spark, sf_dir).withColumn("kp", G.select_points(F.col("kp"), [0, 5, 17], 2)))


_SH = "[(kp[12][i] + kp[13][i]) / 2 for i in range(1, 4)] AS o, sqrt((kp[12][1] - kp[13][1]) ** 2 + (kp[12][2] - kp[13][2]) ** 2) AS w"


@query("normalize_shoulders", f"{_WITH}, n AS (SELECT *, {_SH} FROM frames) SELECT clip_id, frame_idx, round(list_sum([(p[1] - o[1]) / w + (p[2] - o[2]) / w + (p[3] - o[3]) / w for p in kp]), 3) AS s FROM n")
def normalize_shoulders(spark, sf_dir):
    return _sum(P.frames(spark, sf_dir).withColumn("kp", G.normalize_shoulders(F.col("kp"))), 3)


@query(
    "normalize_center_scale",
    f"{_WITH}, n AS (SELECT *, {_SH} FROM frames) SELECT clip_id, frame_idx, round(list_sum([CASE WHEN w > 0.01 THEN (p[1] - o[1]) / w + (p[2] - o[2]) / w + p[3] END for p in kp]), 3) AS s FROM n WHERE w > 0.01",
)
def normalize_center_scale(spark, sf_dir):
    frames = P.frames(spark, sf_dir)
    a, b = (F.slice(F.get("kp", F.lit(i)), 1, 2) for i in (11, 12))
    return _sum(frames.where(G.distance(a, b) > 0.01).withColumn("kp", G.normalize_center_scale(F.col("kp"))), 3)


@query("flatten_landmarks", f"{_WITH} SELECT clip_id, frame_idx, 63 AS n, true AS same FROM frames")
def flatten_landmarks(spark, sf_dir):
    flat = G.flatten_points(F.col("kp"))
    return P.frames(spark, sf_dir).select("clip_id", "frame_idx", F.size(flat).alias("n"), (G.unflatten_points(flat, 3) == F.col("kp")).alias("same"))


@query("clean_points", f"{_WITH} SELECT clip_id, frame_idx, 24 AS points, round(list_sum([p[1] + p[2] for p in kp]), 6) AS s FROM frames")
def clean_points(spark, sf_dir):
    frames = P.frames(spark, sf_dir).withColumn("kp", G.clean_points(F.transform("kp", lambda p: F.slice(p, 1, 2)), 24, 3))
    return rounded(frames.select("clip_id", "frame_idx", F.size("kp").alias("points"), L.energy(F.col("kp")).alias("s")), "s")


@query(
    "pad_or_truncate",
    f"""{_WITH}, z AS (SELECT clip_id, max(frame_idx) + 1 AS n FROM frames GROUP BY 1)
SELECT clip_id, count(*) AS n, count(*) FILTER (i < n0) AS kept FROM (SELECT clip_id, n AS n0, unnest(range(24)) AS i FROM z) GROUP BY 1""",
)
def pad_or_truncate(spark, sf_dir):
    out = L.pad_or_truncate(P.frames(spark, sf_dir).select("clip_id", "frame_idx", "kp"), 24)
    return out.groupBy("clip_id").agg(F.count("*").alias("n"), F.count_if("mask").alias("kept"))


@query(
    "clip_box",
    f"""{_WITH}, e AS (SELECT clip_id, unnest(kp) AS p FROM frames), b AS (SELECT clip_id, min(p[1]) AS x0, max(p[1]) AS x1, min(p[2]) AS y0, max(p[2]) AS y1 FROM e GROUP BY 1)
SELECT clip_id, frame_idx, round(list_sum([(p[1] - (x0 + x1) / 2) / greatest(x1 - x0, y1 - y0) * 200 + 256 + (p[2] - (y0 + y1) / 2) / greatest(x1 - x0, y1 - y0) * 200 + 256 + p[3] for p in kp]), 3) AS s FROM frames JOIN b USING (clip_id)""",
)
def clip_box(spark, sf_dir):
    return _sum(L.clip_box(P.frames(spark, sf_dir)), 3)


_CEN = "[list_avg([p[i] for p in kp[{0}:{1}]]) for i in range(1, 4)]"
_HANDS = f"""h AS (SELECT clip_id, frame_idx, label, kp, {_CEN.format(1, 5)} AS l, {_CEN.format(6, 10)} AS r FROM frames),
hv AS (SELECT *, coalesce(list_distance(l, lag(l) OVER w), 0) AS vl, coalesce(list_distance(r, lag(r) OVER w), 0) AS vr FROM h WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx))"""


@query(
    "motion_features",
    f"""{_WITH}, {_HANDS}, p AS (SELECT *, max(vl) OVER w AS pl, max(vr) OVER w AS pr FROM hv WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT clip_id, frame_idx, round(vl, 6) AS v_left, round(vr, 6) AS v_right, round(pl, 6) AS peak_left, round(pr, 6) AS peak_right, vl > 0.15 AS active_left, vr > 0.15 AS active_right, round(vl / (vr + 1e-6), 4) AS ratio, round(pl / (pr + 1e-6), 4) AS peak_ratio FROM p""",
)
def motion_features(spark, sf_dir):
    out = L.motion_features(P.frames(spark, sf_dir).drop("label"), _LEFT, _RIGHT, 0.15)
    return rounded(out, "v_left", "v_right", "peak_left", "peak_right").withColumns({c: F.round(c, 4) for c in ("ratio", "peak_ratio")})


@query(
    "mask_stationary_hand",
    f"""{_WITH}, {_HANDS}, t AS (SELECT clip_id, sum(vl) AS a, sum(vr) AS b FROM hv GROUP BY 1)
SELECT clip_id, frame_idx, round(list_sum([p[1] + p[2] + p[3] for p in kp]) - CASE WHEN a < 0.95 * b THEN list_sum([p[1] + p[2] + p[3] for p in kp[1:5]]) ELSE 0 END - CASE WHEN b < 0.95 * a THEN list_sum([p[1] + p[2] + p[3] for p in kp[6:10]]) ELSE 0 END, 6) AS s FROM hv JOIN t USING (clip_id)""",
)
def mask_stationary_hand(spark, sf_dir):
    return _sum(L.mask_stationary_hand(P.frames(spark, sf_dir), _LEFT, _RIGHT, 0.95))


@query("zero_pattern", f"{_WITH}, {_HANDS}, t AS (SELECT clip_id, sum(vl) AS a, sum(vr) AS b FROM hv GROUP BY 1) SELECT clip_id, CAST(a < 0.95 * b AS INT)::DOUBLE AS zero_left, CAST(b < 0.95 * a AS INT)::DOUBLE AS zero_right FROM t")
def zero_pattern(spark, sf_dir):
    return L.zero_pattern(L.mask_stationary_hand(P.frames(spark, sf_dir), _LEFT, _RIGHT, 0.95), {"left": _LEFT, "right": _RIGHT})


@query(
    "spatial_features",
    f"""{_WITH}, {_HANDS}, s AS (SELECT clip_id, frame_idx, l AS c, kp[21] AS n, vl AS step, coalesce(l[1] - lag(l[1]) OVER w, 0) AS dx, coalesce(l[2] - lag(l[2]) OVER w, 0) AS dy, list_distance(l, lag(l, 6) OVER w) AS net,
  sum(vl) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS run, sum(vl) OVER (w ROWS UNBOUNDED PRECEDING) AS path FROM hv WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx)),
q AS (SELECT *, CASE WHEN run > 1e-9 THEN least(net / run, 1) END AS lin0, net IS NULL AS none, (c[2] - n[2]) / 0.2 AS ratio FROM s)
SELECT clip_id, frame_idx, round(dx, 6) AS dx, round(dy, 6) AS dy, round(CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE atan2(dy, dx) END, 6) AS angle, round(run, 6) AS run, round(path, 6) AS path,
round(CASE WHEN none THEN 0 ELSE lin0 END, 6) AS linearity, round(c[1] - n[1], 6) AS nose_dx, CASE WHEN ratio < 0.3 THEN 'face' WHEN ratio < 1 THEN 'chest' ELSE 'waist' END AS zone FROM q""",
)
def spatial_features(spark, sf_dir):
    out = _spatial(spark, sf_dir)
    return rounded(out.select("clip_id", "frame_idx", "dx", "dy", "angle", "run", "path", "linearity", "nose_dx", "zone"), "dx", "dy", "angle", "run", "path", "linearity", "nose_dx")


def _spatial(spark, sf_dir):
    # The palm needs the bases of two fingers: the five points stand for a hand that has its other points unseen.
    frames = P.frames(spark, sf_dir)
    zero = F.array(*[F.lit(0.0)] * 3)
    padded = frames.withColumn("kp", F.concat(F.slice("kp", 1, 5), F.array_repeat(zero, 16), F.slice("kp", 21, 1)))
    return L.spatial_features(padded, list(range(21)), 21)


@query(
    "start_end_trajectory",
    f"""{_WITH}, r AS (SELECT clip_id, kp[1][1] AS x, row_number() OVER w AS i, count(*) OVER (PARTITION BY clip_id) AS n FROM frames WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx)),
k AS (SELECT *, greatest(floor(n * 0.1), 1) AS k FROM r) SELECT clip_id, round(avg(x) FILTER (i <= k), 6) AS start, round(avg(x) FILTER (i > n - k), 6) AS "end" FROM k GROUP BY 1""",
)
def start_end_trajectory(spark, sf_dir):
    return rounded(L.start_end_trajectory(P.frames(spark, sf_dir), F.col("kp")[0][0]), "start", "end")


@query(
    "hands_sync",
    f"""{_WITH}, {_HANDS}, d AS (SELECT clip_id, l[1] - lag(l[1]) OVER w AS lx, l[2] - lag(l[2]) OVER w AS ly, r[1] - lag(r[1]) OVER w AS rx, r[2] - lag(r[2]) OVER w AS ry FROM hv WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx)),
u AS (SELECT clip_id, lx AS a, rx AS b, -rx AS m FROM d WHERE lx IS NOT NULL UNION ALL SELECT clip_id, ly, ry, ry FROM d WHERE lx IS NOT NULL)
SELECT clip_id, round(corr(a, b), 5) AS sync, round(corr(a, m), 5) AS mirror FROM u GROUP BY 1""",
)
def hands_sync(spark, sf_dir):
    return L.hands_sync(P.frames(spark, sf_dir), _LEFT, _RIGHT).withColumns({c: F.round(c, 5) for c in ("sync", "mirror")})


@query(
    "hand_activity",
    f"""{_WITH}, {_HANDS}, g AS (SELECT clip_id, avg(CAST(vl > 0.15 AS INT)) * 100 AS al, avg(CAST(vr > 0.15 AS INT)) * 100 AS ar, avg(CAST(vl > 0.15 AND vr > 0.15 AS INT)) * 100 AS both_a,
  avg(vl) AS ml, max(vr) AS tr, var_pop(l[1]) AS xl FROM hv GROUP BY 1)
SELECT clip_id, round(al, 6) AS active_left, round(ar, 6) AS active_right, round(both_a, 6) AS both_active, round(ml, 6) AS velocity_left, round(tr, 6) AS top_right, round(xl, 6) AS variance_left,
CASE WHEN both_a > 50 THEN 'two' WHEN ar >= al THEN 'right' ELSE 'left' END AS handedness FROM g""",
)
def hand_activity(spark, sf_dir):
    out = L.hand_activity(P.frames(spark, sf_dir), _LEFT, _RIGHT, 0.15)
    names = ("active_left", "active_right", "both_active", "velocity_left", "top_right", "variance_left")
    return rounded(out, *names).select("clip_id", *names, "handedness")


_D = "list_distance(kp[{0}], kp[{1}])"


def _ext(i: int) -> str:
    chain = " + ".join(_D.format(i + k, i + k + 1) for k in range(3))
    return f"least({_D.format(i, i + 3)} / ({chain}), 1)"


@query(
    "hand_features",
    f"""{_WITH}, a AS (SELECT clip_id, frame_idx, {", ".join(f"{_ext(2 + 4 * k)} AS e{k}" for k in range(5))},
{", ".join(f"least(acos(least(greatest(list_cosine_similarity([kp[{5 + 4 * k}][i] - kp[{2 + 4 * k}][i] for i in range(1, 4)], [kp[{9 + 4 * k}][i] - kp[{6 + 4 * k}][i] for i in range(1, 4)]), -1), 1)) / (pi() / 2), 1) AS s{k}" for k in range(4))},
{_D.format(5, 9)} / {_D.format(1, 10)} AS tip FROM frames)
SELECT clip_id, frame_idx, round(e0, 5) AS ext_thumb, round(e4, 5) AS ext_pinky, round(s0, 5) AS spread_thumb_index, round(tip, 5) AS tip_thumb_index,
round(0.7 * (e0 + e1 + e2 + e3 + e4) / 5 + 0.3 * (s0 + s1 + s2 + s3) / 4, 5) AS openness FROM a""",
)
def hand_features(spark, sf_dir):
    made = G.hand_features(F.col("kp"))
    names = ("ext_thumb", "ext_pinky", "spread_thumb_index", "tip_thumb_index", "openness")
    return P.frames(spark, sf_dir).select("clip_id", "frame_idx", *[F.round(made[n], 5).alias(n) for n in names])


@query(
    "palm_facing",
    f"""{_WITH}, v AS (SELECT clip_id, frame_idx, [kp[6][i] - kp[1][i] for i in range(1, 4)] AS u, [kp[18][i] - kp[1][i] for i in range(1, 4)] AS v FROM frames),
c AS (SELECT clip_id, frame_idx, u[2] * v[3] - u[3] * v[2] AS x, u[3] * v[1] - u[1] * v[3] AS y, u[1] * v[2] - u[2] * v[1] AS z FROM v)
SELECT clip_id, frame_idx, CASE WHEN abs(z) >= abs(x) AND abs(z) >= abs(y) THEN CASE WHEN z < 0 THEN 'camera' ELSE 'body' END WHEN abs(y) >= abs(x) THEN CASE WHEN y < 0 THEN 'up' ELSE 'down' END
ELSE CASE WHEN x < 0 THEN 'left' ELSE 'right' END END AS facing FROM c""",
)
def palm_facing(spark, sf_dir):
    return P.frames(spark, sf_dir).select("clip_id", "frame_idx", G.palm_facing(G.palm_normal(F.col("kp"))).alias("facing"))


_CLIPF = f"""cf AS (SELECT clip_id, min(label) AS label, frame_idx, {_CEN.format(1, 21)} AS c, max(list_max([p[1] for p in kp])) - min(list_min([p[1] for p in kp])) AS w FROM frames GROUP BY clip_id, frame_idx, kp),
cv AS (SELECT *, coalesce(list_distance(c, lag(c) OVER (PARTITION BY clip_id ORDER BY frame_idx)), 0) AS v FROM cf),
feat AS (SELECT clip_id, count(*) AS frames, avg(c[1]) AS mean_x, stddev_pop(c[2]) AS std_y, min(c[2]) AS highest, avg(v) AS velocity, var_pop(v) AS velocity_var, avg(w) AS extent FROM cv GROUP BY 1),
lab AS (SELECT vec_id // 16 AS clip_id, min(label) AS label FROM embeddings GROUP BY 1), gf AS (SELECT label, count(*) AS clips, avg(mean_x) AS mean_x, avg(velocity) AS velocity, avg(extent) AS extent FROM feat JOIN lab USING (clip_id) GROUP BY 1)"""


@query("clip_pose_features", f"{_WITH}, {_CLIPF} SELECT clip_id, frames, round(mean_x, 6) AS mean_x, round(std_y, 6) AS std_y, round(highest, 6) AS highest, round(velocity, 6) AS velocity, round(velocity_var, 6) AS velocity_var, round(extent, 6) AS extent FROM feat")
def clip_pose_features(spark, sf_dir):
    names = ("mean_x", "std_y", "highest", "velocity", "velocity_var", "extent")
    return rounded(L.clip_pose_features(P.frames(spark, sf_dir)).select("clip_id", "frames", *names), *names)


def _gloss_features(spark, sf_dir):
    frames = P.frames(spark, sf_dir)
    labels = frames.groupBy("clip_id").agg(F.min("label").alias("label"))
    return L.gloss_features(L.clip_pose_features(frames).join(labels, "clip_id"))


@query("gloss_features", f"{_WITH}, {_CLIPF} SELECT label, clips, round(mean_x, 6) AS mean_x, round(velocity, 6) AS velocity, round(extent, 6) AS extent FROM gf")
def gloss_features(spark, sf_dir):
    return rounded(_gloss_features(spark, sf_dir).select("label", "clips", "mean_x", "velocity", "extent"), "mean_x", "velocity", "extent")


@query(
    "compare_pose_stats",
    f"""{_WITH}, {_CLIPF}, p AS (SELECT x.label AS a, y.label AS b, x.velocity AS v, y.velocity AS w FROM gf x JOIN gf y ON x.label < y.label)
SELECT a, b, round(v - w, 6) AS velocity, CASE WHEN abs(v - w) / greatest(abs(v), abs(w), 1e-6) * 100 > 30 THEN 'yes' WHEN abs(v - w) / greatest(abs(v), abs(w), 1e-6) * 100 > 15 THEN 'maybe' ELSE 'no' END AS sep_velocity FROM p""",
)
def compare_pose_stats(spark, sf_dir):
    return rounded(L.compare_pose_stats(_gloss_features(spark, sf_dir), ["velocity"]).select("a", "b", "velocity", "sep_velocity"), "velocity")


_SEP = "CASE WHEN abs(x.{0} - y.{0}) / greatest(abs(x.{0}), abs(y.{0}), 1e-6) * 100 > 30 THEN 'yes' WHEN abs(x.{0} - y.{0}) / greatest(abs(x.{0}), abs(y.{0}), 1e-6) * 100 > 15 THEN 'maybe' ELSE 'no' END AS sep_{0}"


@query(
    "compare_class_stats",
    f"""WITH c AS (SELECT substr(p_brand, 7) AS label, avg(p_size) AS size, avg(p_size * p_size) AS square FROM part GROUP BY 1),
d AS (SELECT *, size > 25 AS large, substr(label, 1, 1) AS maker FROM c),
s AS (SELECT x.label AS a, y.label AS b, x.size - y.size AS size, x.square - y.square AS square, {_SEP.format("size")}, {_SEP.format("square")},
  CASE WHEN x.large = y.large THEN 'no' ELSE 'yes' END AS sep_large, CASE WHEN x.maker = y.maker THEN 'no' ELSE 'yes' END AS sep_maker FROM d x JOIN d y ON x.label < y.label)
SELECT a, b, round(size, 6) AS size, round(square, 6) AS square, sep_size, sep_square, sep_large, sep_maker,
  CAST(len([v for v in [sep_size, sep_square, sep_large, sep_maker] if v = 'yes']) AS INT) AS n_yes, CAST(len([v for v in [sep_size, sep_square, sep_large, sep_maker] if v = 'maybe']) AS INT) AS n_maybe,
  concat_ws(' ', CASE WHEN sep_size = 'yes' THEN 'size' END, CASE WHEN sep_square = 'yes' THEN 'square' END, CASE WHEN sep_large = 'yes' THEN 'large' END, CASE WHEN sep_maker = 'yes' THEN 'maker' END) AS separating FROM s""",
)
def compare_class_stats(spark, sf_dir):
    """Brands compared by numbers, a boolean and a string."""
    size = F.col("p_size").cast("double")
    stats = P.table(spark, sf_dir, "part").groupBy(F.substring("p_brand", 7, 9).alias("label")).agg(F.avg(size).alias("size"), F.avg(size * size).alias("square"))
    stats = stats.withColumn("large", F.col("size") > 25).withColumn("maker", F.substring("label", 1, 1))
    out = L.compare_pose_stats(stats, ["size", "square", "large", "maker"])
    return rounded(out.withColumn("separating", F.array_join("separating", " ")), "size", "square")


@query(
    "repetition",
    f"""WITH {P.MOTION_SQL}, c AS (
  SELECT clip_id, frame_idx, v - avg(v) OVER (PARTITION BY clip_id) AS x, count(*) OVER (PARTITION BY clip_id) AS n FROM motion
), p AS (SELECT clip_id, sum(x * x) AS power FROM c GROUP BY 1),
r AS (
  SELECT a.clip_id, b.frame_idx - a.frame_idx AS k, sum(a.x * b.x) AS s
  FROM c a JOIN c b ON a.clip_id = b.clip_id AND b.frame_idx - a.frame_idx BETWEEN 2 AND a.n // 2 GROUP BY 1, 2
)
SELECT p.clip_id, coalesce(arg_max(k, struct_pack(r := s / power, k := -k)) FILTER (power > 1e-12 AND s / power > 0.3), 0) AS period
FROM p LEFT JOIN r ON r.clip_id = p.clip_id GROUP BY p.clip_id""",
)
def repetition(spark, sf_dir):
    return L.repetition(P.motion(spark, sf_dir).withColumn("kp", F.lit(None)), F.col("v"))


@query("flip_and_move", f"{_WITH} SELECT clip_id, frame_idx, round(list_sum([-(p[1] + 0.1) + p[2] - 0.2 + p[3] for p in kp]), 6) AS s FROM frames")
def flip_and_move(spark, sf_dir):
    moved = G.flip(G.translate(F.col("kp"), F.lit(0.1), F.lit(-0.2)))
    return _sum(P.frames(spark, sf_dir).withColumn("kp", moved))


@query("scale_clip", f"{_WITH}, o AS (SELECT *, {_CEN.format(1, 21)} AS c FROM frames) SELECT clip_id, frame_idx, round(list_sum([(p[1] - c[1]) * 1.3 + c[1] for p in kp]), 6) AS x, round(kp[1][1] * 1.3 - c[1] * 0.3, 6) AS first FROM o")
def scale_clip(spark, sf_dir):
    moved = P.frames(spark, sf_dir).withColumn("kp", G.scale_about(F.col("kp"), G.hand_centroid(F.col("kp")), F.lit(1.3)))
    x = F.aggregate(F.transform("kp", lambda p: p[0]), F.lit(0.0), lambda s, v: s + v)
    return rounded(moved.select("clip_id", "frame_idx", x.alias("x"), F.col("kp")[0][0].alias("first")), "x", "first")


@query(
    "rotate_view",
    f"""{_WITH}, o AS (SELECT *, {_CEN.format(1, 21)} AS c FROM frames), p AS (SELECT *, kp[1][1] - c[1] AS x, kp[1][2] - c[2] AS y, kp[1][3] - c[3] AS z FROM o),
q AS (SELECT *, y * sin(0.2) + z * cos(0.2) AS z2, y * cos(0.2) - z * sin(0.2) AS y2 FROM p) SELECT clip_id, frame_idx, round(x * cos(0.3) + z2 * sin(0.3) + c[1], 6) AS x, round(y2 + c[2], 6) AS y, round(-x * sin(0.3) + z2 * cos(0.3) + c[3], 6) AS z FROM q""",
)
def rotate_view(spark, sf_dir):
    moved = G.rotate_view(F.col("kp"), G.hand_centroid(F.col("kp")), F.lit(0.2), F.lit(0.3))
    return rounded(P.frames(spark, sf_dir).withColumn("kp", moved).select("clip_id", "frame_idx", *[F.col("kp")[0][i].alias(n) for i, n in enumerate("xyz")]), "x", "y", "z")


@query("augment_clips", None)
def augment_clips(spark, sf_dir):
    frames = P.frames(spark, sf_dir)
    sizes = frames.select(F.col("clip_id").alias("key")).distinct().withColumn("n", F.lit(12))
    plan = splits.augmentation_sequence(sizes).select(F.col("key").alias("clip_id"), F.col("aug_no").alias("aug_id"), "technique")
    out = L.augment_clips(L.clip_arrays(frames), plan, body=(0, 7), hands=((7, 14), (14, 21)))
    return out.select("clip_id", "aug_id", "technique", F.size("clip").alias("frames"), L.energy(F.flatten("clip")).alias("s"))


@query(
    "bucketed_clips",
    f"{_WITH}, c AS (SELECT clip_id, count(*) AS n, sum(list_sum([p[1] + p[2] + p[3] for p in kp])) AS s FROM frames GROUP BY 1) SELECT clip_id, clip_id % 3 AS aug_id, CAST(n AS INT) AS frames, round(s, 6) AS s FROM c",
)
def bucketed_clips(spark, sf_dir):
    """Clips and their plan as tables of the same buckets, joined where they lie."""
    clips = L.clip_arrays(P.frames(spark, sf_dir))
    plan = clips.select("clip_id", (F.col("clip_id") % 3).alias("aug_id"))
    tables = []
    for name, rows in (("clips", clips), ("plan", plan)):
        path = scratch_path(spark, name)
        tables.append(sinks.write_bucketed(rows, path.rsplit("/", 1)[-1].replace("-", "_"), path, 8))
    return tables[0].join(tables[1], "clip_id").select("clip_id", "aug_id", F.size("clip").alias("frames"), F.round(L.energy(F.flatten("clip")), 6).alias("s"))


@query(
    "concat_with_rest",
    f"""{_WITH}, f AS (SELECT clip_id // 4 AS sentence_id, clip_id % 4 AS pos, frame_idx FROM frames), l AS (SELECT sentence_id, pos, max(frame_idx) AS last, max(pos) OVER (PARTITION BY sentence_id) AS e FROM f GROUP BY 1, 2),
u AS (SELECT * FROM f UNION ALL SELECT sentence_id, pos, unnest(range(last + 1, last + 4)) FROM l WHERE pos < e)
SELECT *, row_number() OVER (PARTITION BY sentence_id ORDER BY pos, frame_idx) - 1 AS frame_no FROM u""",
)
def concat_with_rest(spark, sf_dir):
    parts = P.frames(spark, sf_dir).select(F.expr("clip_id div 4").alias("sentence_id"), (F.col("clip_id") % 4).alias("pos"), "frame_idx", "kp")
    return L.concat_with_rest(parts, 3).drop("kp")


@query(
    "shift_to_baseline",
    f"""{_WITH}, {_HANDS}, m AS (SELECT clip_id, [avg(l[1]), avg(l[2]), avg(l[3])] AS m FROM hv GROUP BY 1), d AS (SELECT a.clip_id, [b.m[i] - a.m[i] for i in range(1, 4)] AS d FROM m a JOIN m b ON b.clip_id = a.clip_id // 2)
SELECT clip_id, frame_idx, round(list_sum([p[1] + p[2] + p[3] for p in kp]) + 5 * (d[1] + d[2] + d[3]), 6) AS s FROM hv JOIN d USING (clip_id)""",
)
def shift_to_baseline(spark, sf_dir):
    frames = P.frames(spark, sf_dir)
    pairs = frames.select("clip_id").distinct().withColumn("base_id", F.expr("clip_id div 2"))
    return _sum(L.shift_to_baseline(frames, pairs, _LEFT))


def _hand_place(name, a, b):
    seen, n = f"[p for p in kp[{a}:{b}] if p[1] <> 0 OR p[2] <> 0]", b - a + 1
    zeros = f"len([x for x in flatten([p[1:2] for p in kp[{a}:{b}]]) if x = 0]) / {2.0 * n}"
    return ", ".join(
        [f"avg(coalesce(list_sum([(p[{i}] - o[{i}]) / scale for p in {seen}]), 0) / {n}) AS {name}_{c}" for i, c in ((1, "x"), (2, "y"))] + [f"avg({zeros}) AS {name}_zero"]
    )


def _hand_moved(name, a, b):
    step = f"CASE WHEN p[1] <> 0 OR p[2] <> 0 THEN 0.5 * scale * (b.{name}_x - a.{name}_x + b.{name}_y - a.{name}_y) ELSE 0 END"
    return f"CASE WHEN b.{name}_zero > 0.8 THEN 0 ELSE list_sum([p[1] + p[2] + p[3] + {step} for p in kp[{a}:{b}]]) END"


@query(
    "blend_to_baseline",
    f"""{_WITH}, z AS (SELECT clip_id, frame_idx, CASE WHEN clip_id % 5 = 0 THEN list_concat([[0.0, 0.0, 0.0] for i in range(5)], kp[6:21]) ELSE kp END AS kp FROM frames),
m AS (SELECT *, [p for p in kp if p[1] <> 0 OR p[2] <> 0] AS good FROM z),
w AS (SELECT *, [(kp[12][1] + kp[13][1]) / 2, (kp[12][2] + kp[13][2]) / 2] AS o, sqrt((kp[12][1] - kp[13][1]) ** 2 + (kp[12][2] - kp[13][2]) ** 2) AS w, list_avg([p[1] for p in good]) AS mx, list_avg([p[2] for p in good]) AS my FROM m),
s AS (SELECT *, CASE WHEN w > 0.01 THEN w ELSE sqrt(list_sum([(p[1] - mx) ** 2 + (p[2] - my) ** 2 for p in good]) / (2 * len(good))) END AS scale FROM w),
c AS (SELECT clip_id, {_hand_place("l", 1, 5)}, {_hand_place("r", 6, 10)} FROM s GROUP BY 1)
SELECT s.clip_id, frame_idx, round({_hand_moved("l", 1, 5)} + {_hand_moved("r", 6, 10)} + list_sum([p[1] + p[2] + p[3] for p in kp[11:21]]), 5) AS s
FROM s JOIN c a ON a.clip_id = s.clip_id JOIN c b ON b.clip_id = s.clip_id // 2""",
)
def blend_to_baseline(spark, sf_dir):
    """Half way to the baseline; every fifth clip has no left hand."""
    frames = P.frames(spark, sf_dir)
    hidden = F.transform("kp", lambda p, i: F.when((F.col("clip_id") % 5 == 0) & (i < 5), F.transform(p, lambda x: F.lit(0.0))).otherwise(p))
    frames = frames.withColumn("kp", hidden)
    pairs = frames.select("clip_id").distinct().withColumn("base_id", F.expr("clip_id div 2"))
    return _sum(L.blend_to_baseline(frames, pairs, {"left": _LEFT, "right": _RIGHT}, blend=0.5), 5)


_TRAJECTORY = ("path", "net", "linearity", "direction", "vertical", "circularity")


@query(
    "trajectory_features",
    f"""{_WITH}, h AS (SELECT clip_id, frame_idx, (kp[6][1] + kp[7][1] + kp[8][1] + kp[9][1] + kp[10][1]) / 5 AS x, (kp[6][2] + kp[7][2] + kp[8][2] + kp[9][2] + kp[10][2]) / 5 AS y FROM frames),
d AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM h WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx)),
t AS (SELECT *, lag(dx) OVER w * dy - lag(dy) OVER w * dx AS turn FROM d WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx)),
s AS (SELECT clip_id, count(*) AS n, sum(sqrt(dx * dx + dy * dy)) AS path, sum(abs(dx)) AS ax, sum(abs(dy)) AS ay, sum(turn) AS turn, arg_max(x, frame_idx) - arg_min(x, frame_idx) AS nx, arg_max(y, frame_idx) - arg_min(y, frame_idx) AS ny FROM t GROUP BY 1)
SELECT clip_id, round(path, 6) AS path, round(sqrt(nx * nx + ny * ny), 6) AS net, round(sqrt(nx * nx + ny * ny) / greatest(path, 1e-6), 6) AS linearity, round(degrees(atan2(ny, nx)), 6) AS direction,
round(ay / greatest(ax + ay, 1e-6), 6) AS vertical, round(abs(turn) / greatest(path * path, 1e-6) * (n - 1), 6) AS circularity FROM s WHERE n >= 3""",
)
def trajectory_features(spark, sf_dir):
    hand = P.frames(spark, sf_dir).select(
        "clip_id", "frame_idx", *[(sum((F.col("kp")[i][c] for i in _RIGHT), F.lit(0.0)) / 5).alias(n) for c, n in enumerate("xy")]
    )
    return rounded(L.trajectory_features(hand), *_TRAJECTORY)


@query(
    "read_clips",
    """WITH e AS (SELECT vec_id, embedding, CAST([75, 83, 543, 576][CAST(vec_id % 4 + 1 AS INT)] AS BIGINT) AS n FROM embeddings),
i AS (SELECT vec_id, n, embedding, CASE WHEN n >= 543 THEN list_concat(range(0, 33), range(501, 543), [34, 94, 324, 185, 140, 369, 66, 296]) ELSE range(0, n) END AS idx FROM e)
SELECT vec_id AS clip_id, 83 AS points, 3 AS coords, round(list_sum([CAST(embedding[CAST(k % 64 + 1 AS INT)] AS DOUBLE) for k in idx]), 6) AS x,
CAST(list_sum(idx) AS DOUBLE) AS y, CAST(idx[34] AS DOUBLE) AS hand, CAST(coalesce(idx[83], 0) AS DOUBLE) AS last FROM i""",
)
def read_clips(spark, sf_dir):
    """Frames of four layouts in one folder of Parquet files, read as one layout."""
    path = scratch_path(spark, "clips")
    n = F.element_at(F.array(*map(F.lit, (75, 83, 543, 576))), (F.col("vec_id") % 4 + 1).cast("int"))
    points = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(F.get("embedding", i % 64).cast("double"), i.cast("double")))
    P.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_id"), F.lit(0).alias("frame_idx"), points.alias("kp")).write.parquet(path)
    kp, total = F.col("kp"), lambda c: F.aggregate("kp", F.lit(0.0), lambda s, p: s + p[c])
    out = readers.read_clips(spark, path).select(
        "clip_id", F.size(kp).alias("points"), F.size(kp[0]).alias("coords"), total(0).alias("x"), total(1).alias("y"), kp[33][1].alias("hand"), kp[82][1].alias("last")
    )
    return rounded(out, "x")
