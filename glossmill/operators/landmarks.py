"""Frame tables of keypoints: selection, normalisation, features, and augmentation of whole clips."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from glossmill.functions import geometry as G
from glossmill.functions.vectors import total


def in_order() -> WindowSpec:
    """The frames of a clip in order."""
    return Window.partitionBy("clip_id").orderBy("frame_idx")


def in_clip() -> WindowSpec:
    return Window.partitionBy("clip_id")


def pad_or_truncate(frames: DataFrame, most: int = 256) -> DataFrame:
    """Exactly ``most`` frames of each clip: zero frames are added at the end and masked out."""
    sizes = frames.groupBy("clip_id").agg(F.max("frame_idx").alias("last"), F.first("kp").alias("like"))
    zero = F.transform("like", lambda p: F.transform(p, lambda _: F.lit(0.0)))
    missing = sizes.where(F.col("last") + 1 < most).select("clip_id", F.explode(F.sequence(F.col("last") + 1, F.lit(most - 1).cast("long"))).alias("frame_idx"), zero.alias("kp"), F.lit(False).alias("mask"))
    kept = frames.where(F.col("frame_idx") < most).select("clip_id", F.col("frame_idx").cast("long").alias("frame_idx"), "kp", F.lit(True).alias("mask"))
    return kept.unionByName(missing)


def clip_box(frames: DataFrame) -> DataFrame:
    """Points of each clip centred at (256, 256) and scaled to a box of 200, by the box of the points seen in it."""
    good = F.filter("kp", G.seen)
    low = [F.min(F.array_min(F.transform(good, G.coordinate(i)))).over(in_clip()) for i in (0, 1)]
    high = [F.max(F.array_max(F.transform(good, G.coordinate(i)))).over(in_clip()) for i in (0, 1)]
    boxed = frames.withColumns({"_x0": low[0], "_x1": high[0], "_y0": low[1], "_y1": high[1]})
    size = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"), F.lit(1e-9))
    cx, cy = (F.col("_x0") + F.col("_x1")) / 2, (F.col("_y0") + F.col("_y1")) / 2
    place = lambda p: F.when(G.seen(p), F.concat(F.array((p[0] - cx) / size * 200 + 256, (p[1] - cy) / size * 200 + 256), F.slice(p, 3, 10))).otherwise(p)
    return boxed.withColumn("kp", F.transform("kp", place)).drop("_x0", "_x1", "_y0", "_y1")


def path_length(points: Column) -> Column:
    before = F.lag(points).over(in_order())
    return F.when(before.isNotNull(), G.distance(points, before)).otherwise(0.0)


def mask_stationary_hand(frames: DataFrame, left: list[int], right: list[int], share: float = 0.5) -> DataFrame:
    """Zeroes the hand whose whole path is under ``share`` of the other's."""
    step = {s: path_length(G.hand_centroid(G.select_points(F.col("kp"), idx))) for s, idx in (("l", left), ("r", right))}
    rows = frames.withColumn("_l", step["l"]).withColumn("_r", step["r"])
    rows = rows.withColumn("_pl", F.sum("_l").over(in_clip())).withColumn("_pr", F.sum("_r").over(in_clip()))
    drop_l, drop_r = F.col("_pl") < share * F.col("_pr"), F.col("_pr") < share * F.col("_pl")
    inside = lambda i, idx: F.array_contains(F.array(*map(F.lit, idx)), i)
    kept = F.transform("kp", lambda p, i: F.when((drop_l & inside(i, left)) | (drop_r & inside(i, right)), F.transform(p, lambda _: F.lit(0.0))).otherwise(p))
    return rows.withColumn("kp", kept).drop("_l", "_r", "_pl", "_pr")


def zero_pattern(frames: DataFrame, groups: dict[str, list[int]]) -> DataFrame:
    """Share of zero coordinates of each group of points in each clip."""
    def share(idx: list[int]) -> Column:
        flat = F.flatten(G.select_points(F.col("kp"), idx))
        return F.size(F.filter(flat, lambda x: x == 0)) / F.size(flat)

    return frames.groupBy("clip_id").agg(*[F.avg(share(idx)).alias(f"zero_{name}") for name, idx in groups.items()])


def motion_features(frames: DataFrame, left: list[int], right: list[int], active: float = 0.005) -> DataFrame:
    """Eight columns for each frame: velocity and rolling peak of both hands, their ratios, and whether they move."""
    out = frames
    for side, idx in (("left", left), ("right", right)):
        out = out.withColumn(f"v_{side}", path_length(G.hand_centroid(G.select_points(F.col("kp"), idx))))
    for side in ("left", "right"):
        out = out.withColumn(f"peak_{side}", F.max(f"v_{side}").over(in_order().rowsBetween(-4, 0)))
        out = out.withColumn(f"active_{side}", F.col(f"v_{side}") > active)
    out = out.withColumn("ratio", F.col("v_left") / (F.col("v_right") + 1e-6))
    return out.withColumn("peak_ratio", F.col("peak_left") / (F.col("peak_right") + 1e-6)).drop("kp")


def spatial_features(frames: DataFrame, hand: list[int], nose: int, window: int = 7) -> DataFrame:
    """Path of one hand for each frame: direction, path and net displacement over a window, linearity, circularity,
    path so far, height relative to the nose, palm normal and zone. All windows share one order, so one sort serves."""
    points = G.select_points(F.col("kp"), hand)
    c = frames.withColumn("c", G.hand_centroid(points)).withColumn("n", F.get("kp", F.lit(nose))).withColumn("palm", G.palm_normal(points))
    c = c.withColumn("step", path_length(F.col("c")))
    before, back = F.lag("c").over(in_order()), F.lag("c", window - 1).over(in_order())
    c = c.withColumn("dx", F.coalesce(F.col("c")[0] - before[0], F.lit(0.0))).withColumn("dy", F.coalesce(F.col("c")[1] - before[1], F.lit(0.0)))
    c = c.withColumn("net", F.when(back.isNotNull(), G.distance(F.col("c"), back)))
    c = c.withColumn("run", F.sum("step").over(in_order().rowsBetween(2 - window, 0))).withColumn("path", F.sum("step").over(in_order().rowsBetween(Window.unboundedPreceding, 0)))
    linear = F.when(F.col("net").isNotNull() & (F.col("run") > 1e-9), F.least(F.col("net") / F.col("run"), F.lit(1.0)))
    c = c.withColumn("linearity", F.coalesce(linear, F.lit(0.0))).withColumn("circularity", F.coalesce(1 - linear, F.lit(0.0)))
    c = c.withColumn("angle", F.when((F.col("dx") == 0) & (F.col("dy") == 0), 0.0).otherwise(F.atan2("dy", "dx")))
    c = c.withColumn("nose_dx", F.col("c")[0] - F.col("n")[0]).withColumn("nose_dy", F.col("c")[1] - F.col("n")[1])
    c = c.withColumn("zone", G.zone(F.col("c")[1], F.col("n")[1], F.col("n")[1] + 0.2)).withColumn("facing", G.palm_facing(F.col("palm")))
    return c.select("clip_id", "frame_idx", "dx", "dy", "angle", "step", "run", "path", "linearity", "circularity", "nose_dx", "nose_dy", "zone", "facing")


def start_end_trajectory(frames: DataFrame, value: Column, share: float = 0.1) -> DataFrame:
    """Mean of a value over the first and the last tenth of each clip's frames, at least one."""
    rows = frames.withColumn("x", value).withColumn("i", F.row_number().over(in_order())).withColumn("n", F.count("*").over(in_clip()))
    k = F.greatest(F.floor(F.col("n") * share), F.lit(1))
    return rows.groupBy("clip_id").agg(F.avg(F.when(F.col("i") <= k, F.col("x"))).alias("start"), F.avg(F.when(F.col("i") > F.col("n") - k, F.col("x"))).alias("end"))


def hands_sync(frames: DataFrame, left: list[int], right: list[int]) -> DataFrame:
    """Correlation of the displacements of both hands over x and y; 0 where a hand does not move. ``mirror`` with x turned."""
    rows = frames.withColumn("l", G.hand_centroid(G.select_points(F.col("kp"), left))).withColumn("r", G.hand_centroid(G.select_points(F.col("kp"), right)))
    moves = [(F.col(s)[i] - F.lag(F.col(s)[i]).over(in_order())) for s in "lr" for i in (0, 1)]
    lx, ly, rx, ry = (f"_{k}" for k in range(4))
    rows = rows.withColumns(dict(zip((lx, ly, rx, ry), moves, strict=True))).where(F.col(lx).isNotNull())
    both = rows.select("clip_id", F.explode(F.array(F.struct(F.col(lx).alias("a"), F.col(rx).alias("b"), (-F.col(rx)).alias("m")), F.struct(F.col(ly).alias("a"), F.col(ry).alias("b"), F.col(ry).alias("m")))).alias("d")).select("clip_id", "d.*")
    ok = (F.stddev_pop("a") > 1e-6) & (F.stddev_pop("b") > 1e-6)
    return both.groupBy("clip_id").agg(F.when(ok, F.corr("a", "b")).otherwise(0.0).alias("sync"), F.when(ok, F.corr("a", "m")).otherwise(0.0).alias("mirror"))


def hand_activity(frames: DataFrame, left: list[int], right: list[int], least: float = 0.005) -> DataFrame:
    """Share of frames in which each hand is there and moves, its spread and velocity, and which hand leads."""
    rows = frames
    for side, idx in (("left", left), ("right", right)):
        points = G.select_points(F.col("kp"), idx)
        rows = rows.withColumn(f"there_{side}", F.exists(points, G.seen)).withColumn(f"c_{side}", G.hand_centroid(points))
        rows = rows.withColumn(f"v_{side}", path_length(F.col(f"c_{side}")))
    aggs = []
    for side in ("left", "right"):
        aggs += [
            (F.avg(F.col(f"there_{side}").cast("double")) * 100).alias(f"present_{side}"), (F.avg((F.col(f"v_{side}") > least).cast("double")) * 100).alias(f"active_{side}"),
            F.var_pop(F.col(f"c_{side}")[0]).alias(f"variance_{side}"), F.avg(f"v_{side}").alias(f"velocity_{side}"), F.max(f"v_{side}").alias(f"top_{side}"),
        ]
    both = (F.col("v_left") > least) & (F.col("v_right") > least)
    out = rows.groupBy("clip_id").agg(*aggs, (F.avg(both.cast("double")) * 100).alias("both_active"))
    lead = F.when(F.col("both_active") > 50, "two").when(F.col("active_right") >= F.col("active_left"), "right").otherwise("left")
    return out.withColumn("handedness", lead)


def clip_pose_features(frames: DataFrame) -> DataFrame:
    """Shape of a clip: means and spreads of the points' position, heights, velocity and extent."""
    c = frames.withColumn("c", G.hand_centroid(F.col("kp"))).withColumn("v", path_length(G.hand_centroid(F.col("kp"))))
    c = c.withColumn("w", F.array_max(F.transform("kp", lambda p: p[0])) - F.array_min(F.transform("kp", lambda p: p[0])))
    return c.groupBy("clip_id").agg(
        F.count("*").alias("frames"), *[F.avg(F.col("c")[i]).alias(f"mean_{n}") for i, n in enumerate("xyz")], *[F.stddev_pop(F.col("c")[i]).alias(f"std_{n}") for i, n in enumerate("xyz")],
        F.min(F.col("c")[1]).alias("highest"), F.max(F.col("c")[1]).alias("lowest"), F.avg("v").alias("velocity"), F.var_pop("v").alias("velocity_var"), F.avg("w").alias("extent"),
    )


def gloss_features(features: DataFrame, by: str = "label") -> DataFrame:
    """Mean of numeric features, and the commonest of others, for each class."""
    aggs = [F.avg(c).alias(c) if kind in ("double", "bigint", "int", "float") else F.mode(c, True).alias(c) for c, kind in features.dtypes if c not in (by, "clip_id")]
    return features.groupBy(by).agg(F.count("*").alias("clips"), *aggs)


def separable(a: Column, b: Column, number: bool = True) -> Column:
    """Can two classes be told apart: a relative difference over 30 % yes, over 15 % maybe; strings and booleans if unequal."""
    if not number:
        return F.when(a.eqNullSafe(b), "no").otherwise("yes")
    delta = F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-6)) * 100
    return F.when(delta > 30, "yes").when(delta > 15, "maybe").otherwise("no")


#: Parts that the classes are cut into where all their pairs are compared.
PAIR_BLOCKS = 32


def compare_pose_stats(features: DataFrame, names: list[str], by: str = "label", blocks: int = PAIR_BLOCKS) -> DataFrame:
    """All pairs of classes of a table with one row each: difference of each feature and whether it separates them.

    Strings and booleans have no difference, only ``sep_``. ``n_yes`` and ``n_maybe`` count the features, and
    ``separating`` names those that tell the two apart. One side is sent to each of ``blocks`` parts of the other, so the
    pairs are an equality join of bounded parts.
    """
    kinds = dict(features.dtypes)
    numbers = {n for n in names if kinds[n] not in ("string", "boolean")}
    own = F.pmod(F.xxhash64(by), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = features.select(F.col(by).alias("a"), own.alias("part"), *[F.col(n).alias(f"a_{n}") for n in names])
    b = features.select(F.col(by).alias("b"), every.alias("part"), *[F.col(n).alias(f"b_{n}") for n in names])
    pairs = a.join(b, "part").where(F.col("a") < F.col("b"))
    seps = {n: separable(F.col(f"a_{n}"), F.col(f"b_{n}"), n in numbers) for n in names}
    out = pairs.select("a", "b", *[(F.col(f"a_{n}") - F.col(f"b_{n}")).alias(n) for n in names if n in numbers], *[s.alias(f"sep_{n}") for n, s in seps.items()])
    count = lambda kind: sum(((F.col(f"sep_{n}") == kind).cast("int") for n in names), F.lit(0))
    apart = F.array_compact(F.array(*[F.when(F.col(f"sep_{n}") == "yes", n) for n in names]))
    return out.withColumns({"n_yes": count("yes"), "n_maybe": count("maybe"), "separating": apart})


def trajectory_features(frames: DataFrame) -> DataFrame:
    """How a point moves through each clip of ``frames(clip_id, frame_idx, x, y)``; clips of under three frames are left out.

    ``path`` is the way gone, ``net`` the way from the first to the last frame, ``linearity`` their ratio, ``direction``
    the angle of the net way in degrees, ``vertical`` the vertical share of all steps and ``circularity`` the turning
    (cross products of neighbouring steps) by the squared path. One window and one aggregate for each clip.
    """
    order = Window.partitionBy("clip_id").orderBy("frame_idx")
    steps = frames.select("clip_id", "frame_idx", "x", "y", *[(F.col(c) - F.lag(c).over(order)).alias(f"d{c}") for c in "xy"])
    turns = steps.withColumn("turn", F.lag("dx").over(order) * F.col("dy") - F.lag("dy").over(order) * F.col("dx"))
    ends = [f(F.struct("x", "y"), F.col("frame_idx")).alias(n) for f, n in ((F.min_by, "first"), (F.max_by, "last"))]
    sums = turns.groupBy("clip_id").agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))), F.lit(0.0)).alias("path"),
        F.sum(F.abs("dx")).alias("ax"), F.sum(F.abs("dy")).alias("ay"), F.coalesce(F.sum("turn"), F.lit(0.0)).alias("turn"), *ends,
    )
    nx, ny = F.col("last.x") - F.col("first.x"), F.col("last.y") - F.col("first.y")
    net, least = F.sqrt(nx * nx + ny * ny), F.lit(1e-6)
    return sums.where("n >= 3").select(
        "clip_id", "path", net.alias("net"), (net / F.greatest("path", least)).alias("linearity"), F.degrees(F.atan2(ny, nx)).alias("direction"),
        (F.col("ay") / F.greatest(F.col("ax") + F.col("ay"), least)).alias("vertical"),
        (F.abs("turn") / F.greatest(F.col("path") * F.col("path"), least) * (F.col("n") - 1)).alias("circularity"),
    )


def repetition(frames: DataFrame, value: Column, least: int = 2) -> DataFrame:
    """Period of a clip's movement: the lag of the highest peak of its autocorrelation, 0 if there is none over 0.3.

    The whole autocorrelation comes from the power spectrum; lags that may be the highest are then computed again as
    plain sums, so ties fall to the shortest lag.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("frame_idx")["x"].to_numpy(float)
        x = x - x.mean()
        power, lag, best = float(x @ x), 0, 0.3
        if power > 1e-12 and len(x) // 2 >= least:
            size = 1 << (2 * len(x) - 1).bit_length()
            r = np.fft.irfft(np.abs(np.fft.rfft(x, size)) ** 2, size)[least : len(x) // 2 + 1] / power
            for k in least + np.flatnonzero(r >= max(float(r.max()), best) - 1e-9):
                exact = float(x[k:] @ x[:-k]) / power
                if exact > best + 1e-12:
                    lag, best = int(k), exact
        return pd.DataFrame({"clip_id": [pdf["clip_id"].iloc[0]], "period": [lag]})

    return frames.select("clip_id", "frame_idx", value.alias("x")).groupBy("clip_id").applyInPandas(run, "clip_id long, period long")


# Augmentation: a clip as one row, ``(clip_id, kp)`` with a list of frames, and a plan of ``(clip_id, aug_id, technique)``.


def clip_arrays(frames: DataFrame) -> DataFrame:
    """Clips as rows with the list of their frames in order."""
    listed = F.array_sort(F.collect_list(F.struct("frame_idx", "kp")))
    return frames.groupBy("clip_id").agg(F.transform(listed, lambda x: x["kp"]).alias("clip"))


def _resample(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    low = np.clip(np.floor(at).astype(int), 0, len(x) - 1)
    high = np.minimum(low + 1, len(x) - 1)
    part = (at - low)[:, None, None]
    return x[low] * (1 - part) + x[high] * part


#: Points of the body and of the hands in the 83-point layout, first and end; a hand's first point is its wrist.
BODY, HANDS = (0, 33), ((33, 54), (54, 75))
# Strengths of the techniques, of which the number of an augmentation picks one, and ranges of draws.
LEVELS = {
    "noise": (0.01, 0.02, 0.03),
    "translation": (0.1, 0.2, 0.3),
    "occlusion": (0.15, 0.25, 0.35),
    "speed": (0.75, 1.25),
    "temporal_warp": (0.2, 0.3, 0.5),
}
SCALES, HAND_SCALES, BODY_SCALES = (0.7, 1.5), (0.8, 1.2), (0.9, 1.1)
SHEAR, TURN, VIEW = 0.1, math.radians(5), 0.15


def _middle(x: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Mean of the seen points of each frame, zero if there are none."""
    n = there.sum(1, keepdims=True)
    return np.where(there, x, 0).sum(1, keepdims=True) / np.maximum(n, 1)


def _turn(x: np.ndarray, i: int, j: int, angle: float) -> np.ndarray:
    """The plane of coordinates ``i`` and ``j`` turned by an angle."""
    out = x.copy()
    out[..., i] = np.cos(angle) * x[..., i] - np.sin(angle) * x[..., j]
    out[..., j] = np.sin(angle) * x[..., i] + np.cos(angle) * x[..., j]
    return out


def augment(
    x: np.ndarray, technique: str, draw: np.random.Generator, number: int = 0,
    body: tuple[int, int] = BODY, hands: tuple[tuple[int, int], ...] = HANDS,
) -> np.ndarray:
    """One augmentation of a clip of shape (frames, points, coordinates); points that were not seen stay zero.

    ``number`` picks the technique's level and the hand that is dropped. ``geometric`` shears and turns each frame about
    the middle of its seen points, ``combined`` scales the outcome as well; ``viewpoint`` turns about the x axis, then
    the y axis, or in the plane if there are two coordinates; ``proportion`` scales each hand about its wrist and the
    body about its own middle.
    """
    there = (x[..., :2] != 0).any(-1, keepdims=True)
    level = LEVELS[technique][number % len(LEVELS[technique])] if technique in LEVELS else 0.0
    if technique == "flip":
        return x * np.r_[-1.0, np.ones(x.shape[-1] - 1)]
    if technique == "translation":
        return np.where(there, x + np.r_[draw.uniform(-level, level, 2), np.zeros(x.shape[-1] - 2)], x)
    if technique == "scaling":
        middle = x[there[..., 0]].mean(0) if there.any() else np.zeros(x.shape[-1])
        return np.where(there, (x - middle) * draw.uniform(*SCALES) + middle, x)
    if technique == "noise":
        return np.where(there, x + draw.normal(0, level, x.shape), x)
    if technique == "occlusion":
        gone = draw.permutation(x.shape[1])[: int(x.shape[1] * level)]
        out = x.copy()
        out[:, gone] = 0
        return out
    if technique == "hand_drop":
        out, (start, end) = x.copy(), hands[number % len(hands)]
        out[:, start:end] = 0
        return out
    if technique == "speed":
        return _resample(x, np.linspace(0, len(x) - 1, max(1, int(len(x) / level))))
    if technique == "temporal_warp" and len(x) >= 4:
        steps = np.cumsum(draw.uniform(1 - level, 1 + level, len(x) - 1))
        return _resample(x, np.r_[0, steps / steps[-1] * (len(x) - 1)])
    if technique == "proportion":
        out, hand, torso = x.copy(), draw.uniform(*HAND_SCALES), draw.uniform(*BODY_SCALES)
        for start, end in hands:
            wrist = x[:, start : start + 1]
            out[:, start:end] = (x[:, start:end] - wrist) * hand + wrist
        part = slice(*body)
        middle = _middle(x[:, part], there[:, part])
        out[:, part] = (x[:, part] - middle) * torso + middle
        return np.where(there, out, x)
    middle = _middle(x, there)
    if technique == "viewpoint":
        rx, ry = draw.uniform(-VIEW, VIEW, 2)
        out = _turn(_turn(x - middle, 1, 2, rx), 2, 0, ry) if x.shape[-1] > 2 else _turn(x - middle, 0, 1, ry)
        return np.where(there, out + middle, x)
    if technique in ("geometric", "combined"):
        out, (sx, sy) = x.copy(), draw.normal(0, SHEAR, 2)
        out[..., 0] += sx * x[..., 1]
        out[..., 1] += sy * out[..., 0]
        middle = _middle(out, there)
        out = np.where(there, _turn(out - middle, 0, 1, draw.normal(0, TURN)) + middle, x)
        return out if technique == "geometric" else augment(out, "scaling", draw, number)
    return x


#: Bytes of coordinates that a task has made before it hands them on.
MADE_BYTES = 4 << 20


def _clip_array(clip: pa.ListScalar) -> np.ndarray:
    """A clip's coordinates of shape (frames, points, coordinates); a null is NaN."""
    frames = clip.values
    points = frames.flatten()
    values = points.flatten().to_numpy(zero_copy_only=False)
    per_frame = len(points) // max(len(frames), 1)
    return values.reshape(len(frames), per_frame, len(values) // max(len(points), 1))


def _clip_lists(clips: list[np.ndarray]) -> pa.ListArray:
    """Clips as lists of frames of points; NaN is a null."""
    values = pa.array(np.concatenate([x.ravel() for x in clips]), pa.float64(), from_pandas=True)
    for axis in (2, 1, 0):
        sizes = np.concatenate([np.full(math.prod(x.shape[:axis]), x.shape[axis]) for x in clips])
        values = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), values)
    return values


def augment_clips(
    clips: DataFrame, plan: DataFrame, parts: int | None = None, body: tuple[int, int] = BODY, hands: tuple[tuple[int, int], ...] = HANDS,
    spread: bool = True,
) -> DataFrame:
    """New clips ``(clip_id, aug_id, technique, clip)``, one for each row of ``plan(clip_id, aug_id, technique)``.

    Clips meet their plan by an equi-join and are spread by clip and number, as the output is many times the input. The
    random draw of a row depends on its clip and number only, so a retried task gives the same clip. ``body`` and
    ``hands`` say where these points are (first and end). Without ``spread`` the clips stay where the join has them: over
    tables bucketed by clip no keypoint is moved.
    """

    def run(batches):
        for batch in batches:
            seeds, numbers, techniques = (batch.column(c).to_pylist() for c in ("seed", "aug_id", "technique"))
            made, start, size = [], 0, 0
            for i, (seed, number, technique) in enumerate(zip(seeds, numbers, techniques, strict=True)):
                draw = np.random.default_rng(abs(seed))
                made.append(augment(_clip_array(batch.column("clip")[i]), technique, draw, number, body, hands))
                size += made[-1].nbytes
                if size >= MADE_BYTES or i + 1 == batch.num_rows:
                    own = [batch.column(c).slice(start, len(made)) for c in ("clip_id", "aug_id", "technique")]
                    yield pa.RecordBatch.from_arrays([*own, _clip_lists(made)], ["clip_id", "aug_id", "technique", "clip"])
                    made, start, size = [], i + 1, 0

    rows = clips.join(plan, "clip_id").withColumn("seed", F.xxhash64("clip_id", "aug_id"))
    if spread:
        rows = rows.repartition(parts, "clip_id", "aug_id") if parts else rows.repartition("clip_id", "aug_id")
    kind = dict(plan.dtypes)["aug_id"]
    rows = rows.select("clip_id", "aug_id", "technique", "seed", F.col("clip").cast("array<array<array<double>>>").alias("clip"))
    return rows.mapInArrow(run, f"clip_id {dict(clips.dtypes)['clip_id']}, aug_id {kind}, technique string, clip array<array<array<double>>>")


def concat_with_rest(parts: DataFrame, hold: int) -> DataFrame:
    """Clips put one after another, the last frame of each held for ``hold`` frames between them.

    ``parts(sentence_id, pos, frame_idx, kp)``; frames are numbered through.
    """
    last = parts.groupBy("sentence_id", "pos").agg(F.max("frame_idx").alias("last"), F.max_by("kp", "frame_idx").alias("kp"))
    final = Window.partitionBy("sentence_id")
    held = last.withColumn("end", F.max("pos").over(final)).where("pos < end")
    held = held.select("sentence_id", "pos", F.explode(F.sequence(F.col("last") + 1, F.col("last") + hold)).alias("frame_idx"), "kp")
    order = Window.partitionBy("sentence_id").orderBy("pos", "frame_idx")
    return parts.unionByName(held).withColumn("frame_no", F.row_number().over(order) - 1)


def shift_to_baseline(frames: DataFrame, baseline: DataFrame, hand: list[int]) -> DataFrame:
    """Shifts the hand of each clip by the difference of its mean position from that of a baseline clip.

    ``baseline(clip_id, base_id)`` names the baseline of each clip; the means are one row for each clip.
    """
    c = G.hand_centroid(G.select_points(F.col("kp"), hand))
    means = frames.groupBy("clip_id").agg(*[F.avg(c[i]).alias(f"m{i}") for i in range(3)])
    base = means.select(F.col("clip_id").alias("base_id"), *[F.col(f"m{i}").alias(f"b{i}") for i in range(3)])
    delta = baseline.join(means, "clip_id").join(base, "base_id").select("clip_id", F.array(*[F.col(f"b{i}") - F.col(f"m{i}") for i in range(3)]).alias("delta"))
    chosen = F.array(*map(F.lit, hand))
    moved = F.transform("kp", lambda p, i: F.when(F.array_contains(chosen, i) & G.seen(p), F.zip_with(p, F.col("delta"), lambda a, d: a + d)).otherwise(p))
    return frames.join(delta, "clip_id").withColumn("kp", moved).drop("delta")


def blend_to_baseline(
    frames: DataFrame, baseline: DataFrame, hands: dict[str, list[int]], blend: float = 1.0, most_zero: float = 0.8,
    basis: list[int] | None = None, shoulders: tuple[int, int] = (G.LEFT_SHOULDER, G.RIGHT_SHOULDER),
) -> DataFrame:
    """Moves the hands of each clip to where those of its baseline are, whatever the place and size of the signer.

    ``baseline(clip_id, base_id)`` names the baseline of each clip; clips without one that has frames are left out. A
    hand's place is the mean of its points over all frames, in the space of each frame (:func:`frame_space` of the
    points ``basis``, all if none, in which ``shoulders`` are numbered). The difference of the places, times ``blend``, is
    carried back by each frame's own scale, so points that are not shifted keep their exact values. Points not seen stay
    so, and a hand of which over ``most_zero`` of the baseline's x and y are zero is set to zero. ``hands`` names the points
    in the layout of ``frames``, so whole-body frames are changed in place. Frames are joined with a row for each clip.
    """
    own = F.col("kp") if basis is None else G.select_points(F.col("kp"), basis)
    placed = frames.withColumn("space", G.frame_space(own, *shoulders))
    stats = []
    for name, idx in hands.items():
        flat = F.flatten(G.select_points(F.col("kp"), idx, 2))
        inside = G.into_space(G.select_points(F.col("kp"), idx, 2), F.col("space"))
        stats += [F.avg(total(F.transform(inside, G.coordinate(i))) / len(idx)).alias(f"{name}_{c}") for i, c in enumerate("xy")]
        stats.append(F.avg(F.size(F.filter(flat, lambda x: x == 0)) / F.size(flat)).alias(f"{name}_zero"))
    means = placed.groupBy("clip_id").agg(*stats)
    base = means.select(F.col("clip_id").alias("base_id"), *[F.col(c).alias(f"b_{c}") for c in means.columns[1:]])
    both = baseline.select("clip_id", "base_id").join(means, "clip_id").join(base, "base_id")
    steps = [F.struct(*[((F.col(f"b_{h}_{c}") - F.col(f"{h}_{c}")) * blend).alias(c) for c in "xy"], (F.col(f"b_{h}_zero") > most_zero).alias("zero")).alias(h) for h in hands]
    changes = both.select("clip_id", F.struct(*steps).alias("change"))

    def moved(p: Column, i: Column) -> Column:
        out = F.when(~G.seen(p), p)
        for name, idx in hands.items():
            step, scale = F.col(f"change.{name}"), F.col("space.scale")
            to = F.concat(F.array(p[0] + step["x"] * scale, p[1] + step["y"] * scale), F.slice(p, 3, 10))
            hit = F.array_contains(F.array(*map(F.lit, idx)), i)
            out = out.when(hit, F.when(step["zero"], F.transform(p, lambda x: F.lit(0.0))).otherwise(to))
        return out.otherwise(p)

    return placed.join(changes, "clip_id").withColumn("kp", F.transform("kp", moved)).drop("space", "change")


def energy(kp: Column) -> Column:
    """Sum of all coordinates, to compare tables of points."""
    return total(F.flatten(kp))
