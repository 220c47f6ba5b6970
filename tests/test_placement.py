"""Exact percentiles by ranges, and tables whose clips are not moved."""

import numpy as np
import pytest

from glossmill.operators import landmarks as L
from glossmill.operators import statistics as S
from glossmill.sources import sinks


@pytest.mark.parametrize("ranges", [4, 256])
def test_percentiles_are_exact(spark, ranges):
    """As numpy has them: ties, hot values, one row, nulls and NaN."""
    rng = np.random.default_rng(6)
    groups = {"even": rng.normal(size=5000), "hot": np.r_[np.full(3000, 2.0), rng.normal(size=50)], "whole": rng.integers(0, 9, 800), "one": [7.5], "two": [1.0, 2.0]}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("one", None), ("one", float("nan")), ("none", None), (None, 1.0)]
    probs = [0.0, 0.01, 0.33, 0.5, 0.66, 0.999, 1.0]
    out = S.percentiles(spark.createDataFrame(rows, "g string, v double"), "v", probs, ["g"], ranges).collect()
    got = {r.g: (r.n, r.percentiles) for r in out}
    assert set(got) == set(groups)
    for g, x in groups.items():
        assert got[g][0] == len(x) and got[g][1] == pytest.approx(np.quantile(np.array(x, float), probs))


def test_percentiles_of_all(spark):
    x = spark.range(1001).selectExpr("double(id) AS v")
    assert [r.percentiles for r in S.percentiles(x, "v", [0.333, 0.5]).collect()] == [pytest.approx([333.0, 500.0])]
    assert S.percentiles(x.where("v < 0"), "v", [0.5]).collect() == []


def test_clips_stay_in_their_buckets(spark, tmp_path):
    """Augmentation over bucketed tables has no exchange and gives the rows it gives otherwise."""
    rng = np.random.default_rng(7)
    clips = spark.createDataFrame([(c, rng.normal(size=(4, 75, 3)).tolist()) for c in range(20)], "clip_id long, clip array<array<array<double>>>")
    plan = spark.createDataFrame([(c, k, t) for c in range(20) for k, t in enumerate(("viewpoint", "scaling"))], "clip_id long, aug_id long, technique string")
    want = {(r.clip_id, r.aug_id): r.clip for r in L.augment_clips(clips, plan).collect()}
    a = sinks.write_bucketed(clips, "placed_clips", str(tmp_path / "clips"), 4)
    b = sinks.write_bucketed(plan, "placed_plan", str(tmp_path / "plan"), 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = L.augment_clips(a, b, spread=False)
        text = out._jdf.queryExecution().toString()
        assert "Exchange" not in text.split("== Physical Plan ==")[1] and "Join" in text
        assert {(r.clip_id, r.aug_id): r.clip for r in out.collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("placed_clips", "placed_plan"):
            spark.sql(f"DROP TABLE {name}")
