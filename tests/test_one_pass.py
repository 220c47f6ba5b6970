"""Steps that once took a whole class in one task, or computed a row many times over."""

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossmill.functions import vectors as V
from glossmill.operators import splits
from glossmill.operators import statistics as S


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_task_orders_a_whole_class(spark):
    clips = spark.createDataFrame([(f"c{i}", None if i % 3 == 0 else f"g{i % 3}", i // 2) for i in range(900)], "clip_id string, gloss string, video_id long")
    got = splits.leaky_split(clips)
    assert "windowspecdefinition(gloss#" not in plan(got)
    order = Window.partitionBy("gloss").orderBy(splits.shuffled("42", F.col("clip_id")), "clip_id")
    want = {r.clip_id: "train" if r.rn <= 210 else "val" if r.rn <= 255 else "test" for r in clips.withColumn("rn", F.row_number().over(order)).collect()}
    assert {r.clip_id: r.split for r in got.collect()} == want


def test_softmax_computes_each_power_once(spark):
    got = spark.createDataFrame([([1.0, 2.0, 4.0],)], "z array<double>").select(V.softmax(F.col("z")).alias("p"))
    assert plan(got).lower().count("exp(") == 1
    powers = [math.exp(x - 4) for x in (1, 2, 4)]
    assert all(math.isclose(a, x / sum(powers)) for a, x in zip(got.first().p, powers, strict=True))


def test_ablation_groups_each_entry_once(spark):
    rows = [(i, run, float(i % 7 + k * (i % 3)), float(i % 5 * k)) for i in range(40) for k, run in enumerate(("baseline", "model"))]
    got = S.ablation(spark.createDataFrame(rows, "entry_id long, run string, a double, b double"), ["a", "b"])
    assert "Expand" not in plan(got)
    assert {r.variant for r in got.collect()} == {"full", "without_a", "without_b"}
