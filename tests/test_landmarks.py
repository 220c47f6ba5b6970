"""Blending of hands to a baseline, comparison of classes and periods, by values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossmill.operators import landmarks as L

HANDS = {"left": list(range(33, 54)), "right": list(range(54, 75))}
ROW = "clip_id long, frame_idx long, kp array<array<double>>"


def clips(rng, clip, frames, points=75, place=(0.0, 0.0), size=1.0):
    x = rng.normal(0, 0.2, (frames, points, 3)) + [*place, 0.0]
    x[:, 11], x[:, 12] = [place[0] - size, place[1], 0], [place[0] + size, place[1], 0]
    return [(clip, k, f.tolist()) for k, f in enumerate(x)]


def arrays(df):
    out = {}
    for r in df.orderBy("clip_id", "frame_idx").collect():
        out.setdefault(r.clip_id, []).append(r.kp)
    return {k: np.array(v) for k, v in out.items()}


def place(x, idx):
    """Mean of a hand in the space of each frame, in numpy."""
    middle, width = (x[:, 11, :2] + x[:, 12, :2]) / 2, np.linalg.norm(x[:, 11, :2] - x[:, 12, :2], axis=1)
    return ((x[:, idx, :2] - middle[:, None]) / width[:, None, None]).mean((0, 1))


def test_blend_reaches_the_baseline(spark):
    rng = np.random.default_rng(1)
    frames = spark.createDataFrame(clips(rng, 1, 6, place=(3, 4), size=2.5) + clips(rng, 2, 9, place=(-1, 0.5), size=0.4), ROW)
    pairs = spark.createDataFrame([(1, 2)], "clip_id long, base_id long")
    before, after = arrays(frames), arrays(L.blend_to_baseline(frames, pairs, HANDS))
    assert set(after) == {1}
    for idx in HANDS.values():
        assert place(after[1], idx) == pytest.approx(place(before[2], idx))
    half = arrays(L.blend_to_baseline(frames, pairs, HANDS, blend=0.5))[1]
    assert half == pytest.approx((before[1] + after[1]) / 2)
    assert (after[1][:, :33] == before[1][:, :33]).all() and (after[1][..., 2] == before[1][..., 2]).all()
    assert (arrays(L.blend_to_baseline(frames, pairs, HANDS, blend=0.0))[1] == before[1]).all()


def test_blend_copies_missing_hands(spark):
    rng = np.random.default_rng(2)
    own, base = clips(rng, 1, 4), clips(rng, 2, 4)
    for _, _, kp in base:
        kp[33:54] = [[0.0] * 3] * 21
    own[0][2][60] = [0.0] * 3
    frames = spark.createDataFrame(own + base, ROW)
    after = arrays(L.blend_to_baseline(frames, spark.createDataFrame([(1, 2), (3, 2), (4, None)], "clip_id long, base_id long"), HANDS))
    assert set(after) == {1}
    assert (after[1][:, 33:54] == 0).all() and (after[1][0, 60] == 0).all() and (after[1][1:, 60] != 0).any()


def test_blend_whole_body(spark):
    """Frames of 543 points are changed in place as the 75 points of their body and hands are."""
    rng = np.random.default_rng(3)
    basis = [*range(33), *range(501, 543)]
    whole = clips(rng, 1, 3, 543, (1, 1), 2.0) + clips(rng, 2, 3, 543)
    small = [(c, k, [kp[i] for i in basis]) for c, k, kp in whole]
    pairs = spark.createDataFrame([(1, 2)], "clip_id long, base_id long")
    hands = {"left": list(range(501, 522)), "right": list(range(522, 543))}
    a = arrays(L.blend_to_baseline(spark.createDataFrame(whole, ROW), pairs, hands, basis=basis))[1]
    b = arrays(L.blend_to_baseline(spark.createDataFrame(small, ROW), pairs, HANDS))[1]
    assert a[:, basis] == pytest.approx(b)
    assert (a[:, 33:501] == np.array([kp for c, _, kp in whole if c == 1])[:, 33:501]).all()


def test_compare_kinds(spark):
    rows = [("a", 1.0, True, "left"), ("b", 1.2, True, None), ("c", 2.0, False, "left")]
    table = spark.createDataFrame(rows, "label string, v double, two boolean, hand string")
    for blocks in (1, 5):
        got = {(r.a, r.b): (r.sep_v, r.sep_two, r.sep_hand, r.n_yes, r.n_maybe, r.separating) for r in L.compare_pose_stats(table, ["v", "two", "hand"], blocks=blocks).collect()}
        assert got == {
            ("a", "b"): ("maybe", "no", "yes", 1, 1, ["hand"]), ("a", "c"): ("yes", "yes", "no", 2, 0, ["v", "two"]), ("b", "c"): ("yes", "yes", "yes", 3, 0, ["v", "two", "hand"]),
        }


def test_period_of_long_clips(spark):
    """The spectrum gives the lag of plain sums, for random, periodic and constant movements."""
    rng = np.random.default_rng(4)
    series = [rng.normal(size=301), np.sin(np.arange(3000) * 2 * math.pi / 37), np.tile([1.0, 0, 0, 2.0, 0], 200), np.ones(50), rng.normal(size=3), np.array([1.0])]
    rows = [(c, i, float(v)) for c, x in enumerate(series) for i, v in enumerate(x)]
    got = {r.clip_id: r.period for r in L.repetition(spark.createDataFrame(rows, "clip_id long, frame_idx long, v double"), F.col("v")).collect()}
    for c, x in enumerate(series):
        x = x - x.mean()
        r = [(x[k:] @ x[:-k]) / (x @ x) for k in range(2, len(x) // 2 + 1)] if x @ x > 1e-12 else []
        best = max(r, default=0)
        assert got[c] == (2 + next(k for k, v in enumerate(r) if v > best - 1e-12) if best > 0.3 else 0)
    assert got[1] == 37 and got[2] == 5
