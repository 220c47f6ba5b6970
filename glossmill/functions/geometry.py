"""Column functions over keypoints: lists of points, each a list of two or three coordinates; all zero is 'not seen'."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossmill.functions.vectors import total

# Indices of the landmark layouts. A hand has its wrist first, then four points for each finger.
LEFT_SHOULDER, RIGHT_SHOULDER = 11, 12
FINGERS = {"thumb": (1, 2, 3, 4), "index": (5, 6, 7, 8), "middle": (9, 10, 11, 12), "ring": (13, 14, 15, 16), "pinky": (17, 18, 19, 20)}
# The 83 points of a whole-body layout (543 points, or 576 with refined eyes): 33 of the body, both hands, eight of the face.
FACE = (1, 61, 291, 152, 107, 336, 33, 263)
BODY_83 = (*range(33), *range(501, 522), *range(522, 543), *(33 + i for i in FACE))
WRIST, INDEX_BASE, PINKY_BASE, MIDDLE_BASE = 0, 5, 17, 9


def select_points(kp: Column, indices: list[int], dims: int = 3) -> Column:
    """Some points, in the order given, with their first ``dims`` coordinates."""
    return F.transform(F.array(*map(F.lit, indices)), lambda i: F.slice(F.get(kp, i), 1, dims))


def clean_points(kp: Column, points: int, dims: int = 3) -> Column:
    """``points`` points of ``dims`` coordinates: null and NaN become 0, points and coordinates are added or cut."""
    padded = F.slice(F.concat(kp, F.array_repeat(F.array().cast("array<double>"), points)), 1, points)
    return F.transform(
        padded,
        lambda p: F.transform(
            F.slice(F.concat(F.coalesce(p, F.array().cast("array<double>")), F.array_repeat(F.lit(0.0), dims)), 1, dims),
            lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)),
        ),
    )


def even_points(kp: Column, points: int = 83, dims: int = 3) -> Column:
    """Frames of any layout as ``points`` points of ``dims`` coordinates.

    Of a whole-body frame (543 points and more) the 83 of ``BODY_83`` are taken; 75 points (body and hands) and others
    are padded with points not seen, or cut.
    """
    own = F.when(F.size(kp) >= 543, F.transform(F.array(*map(F.lit, BODY_83)), lambda i: F.get(kp, i))).otherwise(kp)
    return clean_points(own, points, dims)


def seen(point: Column) -> Column:
    """A point was detected: x or y is not zero."""
    return (point[0] != 0) | (point[1] != 0)


def coordinate(i: int):
    """Function of a point that gives its coordinate ``i``."""
    return lambda p: p[i]


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def centre(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def shift_scale(kp: Column, origin: Column, scale: Column) -> Column:
    """Points relative to an origin, divided by a scale; points that were not seen stay zero."""
    return F.transform(kp, lambda p: F.when(seen(p), F.transform(minus(p, origin), lambda x: x / scale)).otherwise(p))


def normalize_shoulders(kp: Column, left: int = LEFT_SHOULDER, right: int = RIGHT_SHOULDER, least: float = 1e-6) -> Column:
    """Centred on the middle of the shoulders and divided by their distance in x and y.

    A frame stays as it is if a shoulder was not seen or they are closer than ``least``.
    """
    a, b = F.get(kp, F.lit(left)), F.get(kp, F.lit(right))
    width = distance(F.slice(a, 1, 2), F.slice(b, 1, 2))
    usable = seen(a) & seen(b) & (width > least)
    return F.when(usable, shift_scale(kp, centre(a, b), width)).otherwise(kp)


def frame_space(kp: Column, left: int = LEFT_SHOULDER, right: int = RIGHT_SHOULDER) -> Column:
    """Where a frame lies and how large it is: a struct of ``x``, ``y`` and ``scale``.

    The middle of the shoulders (else the mean of the points seen) and their distance if over 0.01 (else the spread of the
    points seen; 1 without any).
    """
    a, b = F.get(kp, F.lit(left)), F.get(kp, F.lit(right))
    good = F.filter(kp, seen)
    n = F.greatest(F.size(good), F.lit(1))
    mean = [total(F.transform(good, coordinate(i))) / n for i in (0, 1)]
    spread = F.sqrt(total(F.transform(good, lambda p: (p[0] - mean[0]) * (p[0] - mean[0]) + (p[1] - mean[1]) * (p[1] - mean[1]))) / (2 * n))
    both = seen(a) & seen(b)
    width = distance(F.slice(a, 1, 2), F.slice(b, 1, 2))
    cx, cy = (F.when(both, (a[i] + b[i]) / 2).otherwise(mean[i]) for i in (0, 1))
    scale = F.when(both & (width > 0.01), width).otherwise(F.when(spread > 0, spread).otherwise(1.0))
    return F.struct(cx.alias("x"), cy.alias("y"), scale.alias("scale"))


def into_space(kp: Column, space: Column) -> Column:
    """Points seen relative to a frame's space, in x and y; other coordinates stay."""
    at = lambda p: F.array((p[0] - space["x"]) / space["scale"], (p[1] - space["y"]) / space["scale"])
    return F.transform(kp, lambda p: F.when(seen(p), F.concat(at(p), F.slice(p, 3, 10))).otherwise(p))


def normalize_center_scale(kp: Column, left: int = LEFT_SHOULDER, right: int = RIGHT_SHOULDER) -> Column:
    """Points in the space of their frame (:func:`frame_space`); x and y only, other coordinates stay."""
    return into_space(kp, frame_space(kp, left, right))


def flatten_points(kp: Column) -> Column:
    return F.flatten(kp)


def unflatten_points(vector: Column, dims: int) -> Column:
    return F.transform(F.sequence(F.lit(0), (F.size(vector) / dims).cast("int") - 1), lambda i: F.slice(vector, i * dims + 1, dims))


def finger_extension(kp: Column, finger: str) -> Column:
    """Distance from base to tip over the length of the chain between, from 0 (closed) to 1 (straight)."""
    at = [F.get(kp, F.lit(i)) for i in FINGERS[finger]]
    chain = distance(at[0], at[1]) + distance(at[1], at[2]) + distance(at[2], at[3])
    return F.when(chain > 1e-6, F.least(F.greatest(distance(at[0], at[3]) / chain, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def finger_spread(kp: Column, a: str, b: str) -> Column:
    """Angle between two fingers over a right angle, at most 1."""
    one = minus(F.get(kp, F.lit(FINGERS[a][3])), F.get(kp, F.lit(FINGERS[a][0])))
    two = minus(F.get(kp, F.lit(FINGERS[b][3])), F.get(kp, F.lit(FINGERS[b][0])))
    size = F.sqrt(total(F.transform(one, lambda x: x * x))) * F.sqrt(total(F.transform(two, lambda x: x * x)))
    cos = total(F.zip_with(one, two, lambda x, y: x * y)) / F.greatest(size, F.lit(1e-12))
    angle = F.acos(F.least(F.greatest(cos, F.lit(-1.0)), F.lit(1.0)))
    return F.when(size > 1e-6, F.least(angle / 1.5707963267948966, F.lit(1.0))).otherwise(0.0)


def hand_features(kp: Column) -> dict[str, Column]:
    """Fifteen features of a hand of 21 points: extensions, spreads, distances of fingertips over the palm, openness."""
    palm = F.greatest(distance(F.get(kp, F.lit(WRIST)), F.get(kp, F.lit(MIDDLE_BASE))), F.lit(1e-6))
    names = list(FINGERS)
    out = {f"ext_{f}": finger_extension(kp, f) for f in names}
    out |= {f"spread_{a}_{b}": finger_spread(kp, a, b) for a, b in zip(names, names[1:], strict=False)}
    tip = {f: F.get(kp, F.lit(FINGERS[f][3])) for f in names}
    out |= {f"tip_thumb_{f}": distance(tip["thumb"], tip[f]) / palm for f in names[1:]}
    extension = sum(out[f"ext_{f}"] for f in names) / len(names)
    spread = sum(out[f"spread_{a}_{b}"] for a, b in zip(names, names[1:], strict=False)) / (len(names) - 1)
    out["extension"] = extension
    out["openness"] = 0.7 * extension + 0.3 * spread
    seen_any = F.exists(kp, seen)
    return {k: F.when(seen_any, v).otherwise(0.0) for k, v in out.items()}


def palm_normal(kp: Column) -> Column:
    """Unit normal of the plane through wrist and the bases of index and little finger; zeros if there is none."""
    u = minus(F.get(kp, F.lit(INDEX_BASE)), F.get(kp, F.lit(WRIST)))
    v = minus(F.get(kp, F.lit(PINKY_BASE)), F.get(kp, F.lit(WRIST)))
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    size = F.sqrt(sum(c * c for c in cross))
    return F.array(*[F.when(size > 1e-9, c / size).otherwise(0.0) for c in cross])


def palm_facing(normal: Column) -> Column:
    """Which way a palm faces, by the largest part of its normal."""
    x, y, z = (F.abs(normal[i]) for i in range(3))
    return (
        F.when((z >= x) & (z >= y), F.when(normal[2] < 0, "camera").otherwise("body"))
        .when(y >= x, F.when(normal[1] < 0, "up").otherwise("down"))
        .otherwise(F.when(normal[0] < 0, "left").otherwise("right"))
    )


def zone(height: Column, nose: Column, shoulder: Column) -> Column:
    """Face, chest or waist: how far a hand is below the nose, in distances from nose to shoulders."""
    ratio = (height - nose) / F.greatest(shoulder - nose, F.lit(1e-6))
    return F.when(ratio < 0.3, "face").when(ratio < 1.0, "chest").otherwise("waist")


def hand_centroid(kp: Column) -> Column:
    """Mean of the points of a hand that were seen; zeros if none."""
    good = F.filter(kp, seen)
    n = F.greatest(F.size(good), F.lit(1))
    return F.array(*[total(F.transform(good, coordinate(i))) / n for i in range(3)])


# Augmentations that are plain projections.


def flip(kp: Column) -> Column:
    """Mirrored in x; hands are not exchanged."""
    return F.transform(kp, lambda p: F.concat(F.array(-p[0]), F.slice(p, 2, 10)))


def translate(kp: Column, x: Column, y: Column) -> Column:
    return F.transform(kp, lambda p: F.when(seen(p), F.concat(F.array(p[0] + x, p[1] + y), F.slice(p, 3, 10))).otherwise(p))


def scale_about(kp: Column, origin: Column, s: Column) -> Column:
    return F.transform(kp, lambda p: F.when(seen(p), F.zip_with(p, origin, lambda a, c: (a - c) * s + c)).otherwise(p))


def rotate_view(kp: Column, origin: Column, rx: Column, ry: Column) -> Column:
    """Seen from another side: turned about the origin by ``rx`` about the x axis, then by ``ry`` about the y axis."""

    def turn(p: Column) -> Column:
        x, y, z = p[0] - origin[0], p[1] - origin[1], p[2] - origin[2]
        y2, z2 = y * F.cos(rx) - z * F.sin(rx), y * F.sin(rx) + z * F.cos(rx)
        return F.array(x * F.cos(ry) + z2 * F.sin(ry) + origin[0], y2 + origin[1], -x * F.sin(ry) + z2 * F.cos(ry) + origin[2])

    return F.transform(kp, lambda p: F.when(seen(p), turn(p)).otherwise(p))
