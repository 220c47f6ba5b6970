"""Ranks and rounding where the bounds of ranges or the last bit of a half could decide."""

import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from glossmill.operators import statistics as S
from glossmill.plans import registry


def test_ranks_do_not_depend_on_bounds_that_come_out_different_each_time(spark, monkeypatch):
    @F.pandas_udf("array<double>")
    def drawn(v: pd.Series) -> object:
        return sorted(random.SystemRandom().sample(v.tolist(), 20))

    monkeypatch.setattr(S.F, "percentile_approx", lambda value, *_: drawn(F.col(value)))
    rows = pd.DataFrame({"id": range(4000), "g": [i % 2 for i in range(4000)], "v": [float(i * 7919 % 1500) for i in range(4000)]})
    got = {r.id: r["rank"] for r in S.average_rank(spark.createDataFrame(rows), "v", ["g"]).collect()}
    assert got == dict(zip(rows["id"], rows.groupby("g")["v"].rank(), strict=True))


def test_half_cents_of_wilcoxon_as_in_sql(spark, tmp_path):
    # one item an order; price times (discount - 0.9 tax) comes near half a cent on either side
    prices = [round(10 + i * 0.05, 2) for i in range(400)]
    items = pd.DataFrame({"l_orderkey": range(1600), "l_returnflag": "A", "l_extendedprice": prices * 4})
    items["l_discount"] = [0.01, 0.03, 0.05, 0.07] * 400
    items["l_tax"] = [0.0, 0.05, 0.01, 0.02, 0.08] * 320
    path = f"{tmp_path}/lineitem.parquet"
    spark.createDataFrame(items).coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/*.parquet'")
    (got,) = registry.queries()["wilcoxon"](spark, str(tmp_path)).collect()
    want = con.sql(registry.oracle_sql()["wilcoxon"])
    assert [got[c] for c in want.columns] == list(want.fetchall()[0])


def test_cuts_are_found_by_halves(spark):
    cuts = [[], [1.0], [1.0, 1.0, 2.0], [float(k // 3) for k in range(127)], [float(k) for k in range(255)]]
    values = [-1.0, 0.0, 0.5, 1.0, 1.5, 2.0, 41.0, 42.0, 63.5, 254.0, 300.0, float("nan")]
    rows = spark.createDataFrame([(c, v) for c in cuts for v in values], "_cuts array<double>, v double")
    for ranges, n in ((128, 127), (256, 255)):
        some = rows.where(F.size("_cuts") <= n).withColumn("got", S._cuts_below(F.col("v"), ranges))
        assert some.where("got <> size(filter(_cuts, c -> c < v)) OR got IS NULL").count() == 0


def test_correlations_meet_the_pairs_once(spark):
    """Means and squares come from the values of each side, so the plan reads and joins the pairs once."""
    rows = spark.range(500).selectExpr("CAST(id % 23 AS DOUBLE) AS human", "CAST(id % 7 AS DOUBLE) AS x", "CAST(id * 31 % 90 AS DOUBLE) AS y", "1.0D AS same")
    out = S.correlations(rows, "human", ["x", "y", "same"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "a#" in line and "b#" in line for line in plan.splitlines()) == 1
    got = {r.metric: (r.pearson, r.spearman, r.strength) for r in out.collect()}
    pdf = rows.toPandas()
    for name in ("x", "y"):
        assert abs(got[name][0] - pdf["human"].corr(pdf[name])) < 1e-9
        assert abs(got[name][1] - pdf["human"].rank().corr(pdf[name].rank())) < 1e-9
    assert got["same"] == (None, None, "none")
