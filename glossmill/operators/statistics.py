"""Paired statistics, ranks, correlations and grids over scores.

Ranks over a whole table count equal values first and take running sums in ranges of the value, so no task orders all rows.
Test statistics are aggregates; only their p-values, one for each metric, are computed by small Python functions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossmill.functions import distributions as D
from glossmill.functions.text import ctqi_v3
from glossmill.sources.scratch import written


def _cuts_below(value: Column, ranges: int) -> Column:
    """How many of the sorted ``_cuts``, fewer than ``ranges``, are below the value: found by halves, not one by one."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((ranges - 1).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get("_cuts", at + step - 1) < value, step).otherwise(0))


def sums_below(counts: DataFrame, value: str, by: list[str], sums: list[str], ranges: int = 128) -> DataFrame:
    """``counts(*by, value, *sums)`` with the totals of each of ``sums`` over all smaller values, as ``below_<name>``.

    ``value`` is distinct inside each group of ``by``. Each group's values are cut at their approximate quantiles into
    ``ranges`` ranges of about as many rows each, however they are spread; the bounds only place rows, so the sums are
    exact. The running sum inside a range is shifted by the totals of the ranges before it. ``counts`` and bounds are
    computed once and written; totals and sums start from the files.
    """
    counts = written(counts, "counts")
    cuts = counts.groupBy(*by).agg(F.percentile_approx(value, [k / ranges for k in range(1, ranges)], 100 * ranges).alias("_cuts"))
    cuts = written(cuts, "cuts")  # sketches depend on the order they are merged in, so a second run may have other bounds
    placed = counts.join(cuts, by) if by else counts.join(F.broadcast(cuts))  # without groups the bounds are one row
    placed = placed.withColumn("_range", _cuts_below(F.col(value), ranges)).drop("_cuts")
    ahead = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*by, "_range").agg(*[F.sum(n).alias(f"_{n}") for n in sums])
    shift = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_{n}").over(ahead), F.lit(0)).alias(f"_{n}") for n in sums])
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(shift, [*by, "_range"])
    return out.select(*counts.columns, *[(F.col(f"_{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(f"below_{n}") for n in sums])


def average_rank(df: DataFrame, value: str, by: list[str], name: str = "rank") -> DataFrame:
    """``df`` with the average rank of ``value`` inside each group of ``by``; equal values share their mean rank."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranked = sums_below(counts, value, by, ["_n"])
    return df.join(ranked.select(*by, value, (F.col("below__n") + (F.col("_n") + 1) / 2).alias(name)), [*by, value])


def percentiles(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None, ranges: int = 256) -> DataFrame:
    """Exact percentiles ``(*by, n, percentiles)`` of each group, linear between neighbours; ``probs`` from 0 to 1.

    Equal values are counted and written once. Mergeable quantile sketches of fixed size (some 30 KB a group) cut the
    different values into ``ranges`` ranges, whose totals tell which of them hold the ranks asked for; only these are
    put in order, each in a task of its own. The bounds only place values, so the result is exact. Nulls, NaN and groups
    with a null in ``by`` are left out; an empty table gives no row.
    """
    by, x = by or [], F.col(value).cast("double")
    counts = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*by, x.alias("_x")).agg(F.count("*").alias("_n"))
    counts = written(counts, "values")
    at = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    cuts = counts.groupBy(*by).agg(F.kll_sketch_agg_double("_x", F.lit(2048)).alias("_sketch"), F.count("*").alias("_c"))
    cuts = cuts.select(*by, F.when(F.col("_c") > 0, F.kll_sketch_get_quantile_double("_sketch", at)).alias("_cuts"))
    cuts = written(cuts, "cuts")  # sketches draw at random, so a second run would have other bounds
    placed = counts.join(cuts, by) if by else counts.join(F.broadcast(cuts))  # without groups the bounds are one row
    placed = placed.withColumn("_range", _cuts_below(F.col("_x"), ranges)).drop("_cuts")

    totals = placed.groupBy(*by, "_range").agg(F.sum("_n").alias("_in"))
    group = Window.partitionBy(*by)
    ahead = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({"_before": F.coalesce(F.sum("_in").over(ahead), F.lit(0)), "_all": F.sum("_in").over(group)})
    place = lambda k, p: F.struct(F.lit(k).alias("k"), (F.lit(float(p)) * (F.col("_all") - 1)).alias("pos"))
    wanted = totals.withColumn("_w", F.explode(F.array(*[place(k, p) for k, p in enumerate(probs)])))
    wanted = wanted.withColumn("_at", F.explode(F.array_distinct(F.array(F.floor("_w.pos"), F.ceil("_w.pos")))))
    wanted = written(wanted.where("_at >= _before AND _at < _before + _in"), "ranks")

    chosen = placed.join(wanted.select(*by, "_range", "_before").distinct(), [*by, "_range"])
    inside = Window.partitionBy(*by, "_range").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    ordered = chosen.withColumn("_from", F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0))).drop("_before")
    found = ordered.join(wanted, [*by, "_range"]).where("_at >= _from AND _at < _from + _n")
    pos = F.first("_w.pos")
    low, high, share = F.min_by("_x", "_at"), F.max_by("_x", "_at"), pos - F.floor(pos)
    each = found.groupBy(*by, F.col("_w.k").alias("_k")).agg(F.first("_all").alias("_all"), F.when(share == 0, low).otherwise((1 - share) * low + share * high).alias("_v"))
    listed = F.array_sort(F.collect_list(F.struct("_k", "_v")))
    out = each.groupBy(*by).agg(F.first("_all").alias("n"), F.transform(listed, lambda s: s["_v"]).alias("percentiles"))
    return out.where("n IS NOT NULL")


def effect_label(d: Column) -> Column:
    size = F.abs(d)
    return F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")


def paired_stats(scores: DataFrame) -> DataFrame:
    """Paired comparison of ``scores(metric, baseline, model)`` for each metric."""
    diff = F.col("model") - F.col("baseline")
    out = scores.groupBy("metric").agg(
        F.count(diff).alias("n"), F.avg("baseline").alias("mean_baseline"), F.avg("model").alias("mean_model"),
        F.avg(diff).alias("mean_diff"), F.stddev_samp(diff).alias("sd_diff"), F.count_if(diff > 0).alias("improved"),
    )
    se = F.col("sd_diff") / F.sqrt("n")
    out = out.withColumn("t", F.when(se > 0, F.col("mean_diff") / se)).withColumn("cohens_d", F.when(F.col("sd_diff") > 0, F.col("mean_diff") / F.col("sd_diff")).otherwise(0.0))
    out = out.withColumn("ci_low", F.col("mean_diff") - 1.96 * se).withColumn("ci_high", F.col("mean_diff") + 1.96 * se)
    return out.withColumn("effect", effect_label(F.col("cohens_d")))


def wilcoxon(scores: DataFrame) -> DataFrame:
    """Signed-rank sums of the differences that are not zero, with the tie term of the variance, for each metric.

    Equal sizes are counted first; ranks, sums and ties all come from these counts, and no row is joined to its rank.
    """
    d = F.col("d")
    diff = scores.select("metric", (F.col("model") - F.col("baseline")).alias("d")).where("d != 0")
    counts = diff.groupBy("metric", F.abs(d).alias("size")).agg(F.count_if(d > 0).alias("up"), F.count_if(d < 0).alias("down"), F.count("*").alias("t"))
    ranked = sums_below(counts, "size", ["metric"], ["t"]).withColumn("rank", F.col("below_t") + (F.col("t") + 1) / 2)
    sums = ranked.groupBy("metric").agg(
        F.sum("t").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * F.col("down")).alias("w_minus"),
        F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"),
    )
    return sums.withColumn("w", F.least("w_plus", "w_minus"))


def p_values(scores: DataFrame, metrics: int | None = None) -> DataFrame:
    """p-values of each metric: paired t, Wilcoxon (normal approximation), binomial of the improved, with Bonferroni.

    What the Python function sees is one row for each metric.
    """
    stats = paired_stats(scores).select("metric", "n", "t", "improved")
    ranks = wilcoxon(scores).select("metric", F.col("n").alias("nw"), "w", "ties")
    rows = stats.join(ranks, "metric", "left")

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                t = 1.0 if r.t is None or math.isnan(r.t) else D.t_two_sided(r.t, r.n - 1)
                if r.nw and not math.isnan(r.nw):
                    sd = math.sqrt(r.nw * (r.nw + 1) * (2 * r.nw + 1) / 24 - r.ties / 48)
                    z = (r.w - r.nw * (r.nw + 1) / 4) / sd if sd else 0.0
                    w = min(1.0, 2 * D.normal_cdf(-abs(z)))
                else:
                    w = 1.0
                out.append((r.metric, t, w, D.binomial_greater(int(r.improved), int(r.n))))
            yield pd.DataFrame(out, columns=["metric", "p_t", "p_wilcoxon", "p_binomial"])

    out = rows.mapInPandas(run, "metric string, p_t double, p_wilcoxon double, p_binomial double")
    m = F.lit(metrics) if metrics else F.count("*").over(Window.partitionBy())
    return out.withColumn("p_bonferroni", F.least(F.col("p_t") * m, F.lit(1.0)))


def one_sample_t(values: DataFrame, mean: float = 0.0) -> DataFrame:
    """One-sample t of each group of ``values(metric, value)`` against ``mean``: ``(metric, n, mean, t, p)``.

    Without spread, or with fewer than two values, ``t`` is null and ``p`` is 1.
    """
    v = F.col("value")
    stats = values.groupBy("metric").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))
    stats = stats.select("metric", "n", "mean", F.when(F.col("sd") > 0, (F.col("mean") - mean) / (F.col("sd") / F.sqrt("n"))).alias("t"))
    return stats.withColumn("p", _p_column(lambda t, n: 1.0 if math.isnan(t) else D.t_two_sided(t, n - 1))("t", "n"))


def mcnemar(pairs: DataFrame) -> DataFrame:
    """Exact McNemar test of each group of ``pairs(metric, a, b)``, two booleans of one case: ``(metric, only_a, only_b, p)``.

    Cases where either is null are left out.
    """
    a, b = F.col("a"), F.col("b")
    counts = pairs.groupBy("metric").agg(F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"))
    return counts.withColumn("p", _p_column(lambda x, y: D.mcnemar_exact(int(x), int(y)))("only_a", "only_b"))


def _p_column(p):
    """A column of p-values from two columns; tables here have a row for each metric."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([p(float(i), float(j)) for i, j in zip(x, y, strict=True)], dtype="float64")

    return run


def power_sample_size(stats: DataFrame, power: float = 0.8) -> DataFrame:
    """Pairs needed for each metric of a paired comparison (its ``mean_diff`` and ``sd_diff``) at that power."""
    z = D.normal_quantile(0.975) + D.normal_quantile(power)
    need = F.ceil(F.pow(F.lit(z) * F.col("sd_diff") / F.col("mean_diff"), F.lit(2.0)))
    return stats.withColumn("needed", F.when(F.col("mean_diff") != 0, need))


def correlations(df: DataFrame, human: str, metrics: list[str]) -> DataFrame:
    """Pearson and Spearman correlation of each metric with the human score: ``(metric, pearson, spearman, strength)``.

    Spearman's is Pearson's of average ranks. Rows are counted by their pair of values and written once. Ranks, means and
    squares of both sides come from the counts of single values; only the products go back to the pairs.
    """
    long = df.unpivot([human], metrics, "metric", "score").where(F.col("score").isNotNull() & F.col(human).isNotNull())
    score, other = F.col("score").cast("double").alias("a"), F.col(human).cast("double").alias("b")
    pairs = written(long.select("metric", score, other).groupBy("metric", "a", "b").agg(F.count("*").alias("n")), "pairs")
    sides = pairs.select("metric", "n", F.explode(F.array(*[F.struct(F.lit(x).alias("side"), F.col(x).alias("v")) for x in "ab"])).alias("s"))
    counts = sides.groupBy("metric", "s.side", "s.v").agg(F.sum("n").alias("n"))
    ranked = sums_below(counts, "v", ["metric", "side"], ["n"]).withColumn("rank", F.col("below_n") + (F.col("n") + 1) / 2)
    return _rank_correlations(pairs, written(ranked.select("metric", "side", "v", "n", "rank"), "ranks"))


def _rank_correlations(pairs: DataFrame, ranked: DataFrame) -> DataFrame:
    """Correlations of the values and of the ranks of ``pairs(metric, a, b, n)``; ``ranked`` has the values of each side.

    Deviations from the means are summed, not squares of large numbers; the means are a row for each metric and side.
    A pair meets the ranks of its ``a``, and what is summed by ``b`` meets the ranks of ``b``.
    """
    n = F.col("n")
    means = ranked.groupBy("metric", "side").agg(*[(F.sum(F.col(x) * n) / F.sum(n)).alias(f"m{x}") for x in ("v", "rank")])
    off = ranked.join(means, ["metric", "side"]).select("metric", "side", "v", "n", (F.col("v") - F.col("mv")).alias("d"), (F.col("rank") - F.col("mrank")).alias("r"))
    off = written(off, "deviations")
    of = lambda x: off.where(F.col("side") == x).select("metric", F.col("v").alias(x), F.col("d").alias(f"d{x}"), F.col("r").alias(f"r{x}"))
    by_b = pairs.join(of("a"), ["metric", "a"]).groupBy("metric", "b").agg(F.sum(F.col("da") * n).alias("da"), F.sum(F.col("ra") * n).alias("ra"))
    products = by_b.join(of("b"), ["metric", "b"]).groupBy("metric").agg(*[F.sum(F.col(f"{x}a") * F.col(f"{x}b")).alias(f"{x}ab") for x in "dr"])
    square = lambda x, side: F.sum(F.when(F.col("side") == side, F.col(x) * F.col(x) * n)).alias(f"{x}{side}{side}")
    squares = off.groupBy("metric").agg(*[square(x, side) for x in "dr" for side in "ab"])
    corr = lambda x: F.when((F.col(f"{x}aa") > 0) & (F.col(f"{x}bb") > 0), F.col(f"{x}ab") / F.sqrt(F.col(f"{x}aa") * F.col(f"{x}bb")))
    r = F.abs("pearson")
    strength = F.when(r >= 0.9, "very strong").when(r >= 0.7, "strong").when(r >= 0.5, "moderate").when(r >= 0.3, "weak").otherwise("none")
    return products.join(squares, "metric").select("metric", corr("d").alias("pearson"), corr("r").alias("spearman")).withColumn("strength", strength)


def human_scores(ratings: DataFrame) -> DataFrame:
    """Mean rating of each sentence, and on a scale to 100."""
    out = ratings.groupBy("sentence_id").agg(F.avg("rating").alias("human"))
    return out.withColumn("human_100", F.col("human") * 20)


def rater_summary(ratings: DataFrame) -> DataFrame:
    """Mean and quartiles of each rater."""
    quartiles = [F.percentile("rating", F.lit(q)).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)]
    return ratings.groupBy("rater").agg(F.count("*").alias("n"), F.avg("rating").alias("mean"), *quartiles)


def rater_agreement(ratings: DataFrame) -> DataFrame:
    """Exact and within-one agreement of each pair of raters on the mean ratings of sentences both saw.

    Ratings of a rater for one sentence are averaged first, so the join has a row for each sentence and pair of raters.
    """
    once = ratings.groupBy("rater", "sentence_id").agg(F.avg("rating").alias("r"))
    a, b = (once.select(F.col("rater").alias(x), "sentence_id", F.col("r").alias(f"r{x}")) for x in "ab")
    gap = F.abs(F.col("ra") - F.col("rb"))
    return a.join(b, "sentence_id").where("a < b").groupBy("a", "b").agg(
        F.count("*").alias("sentences"), F.avg((gap < 0.5).cast("double")).alias("exact"), F.avg((gap <= 1).cast("double")).alias("within_one")
    )


def icc(ratings: DataFrame) -> DataFrame:
    """Intraclass correlation (two-way random, single rater) over sentences that all raters rated, from ANOVA sums."""
    once = ratings.groupBy("rater", "sentence_id").agg(F.avg("rating").alias("r"))
    raters = F.broadcast(once.agg(F.count_distinct("rater").alias("k")))
    full = once.groupBy("sentence_id").agg(F.count("*").alias("c")).join(raters).where("c = k").select("sentence_id")
    kept = once.join(full, "sentence_id")
    total = kept.agg(F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("ss"), F.count_distinct("rater").alias("k"), F.count_distinct("sentence_id").alias("n"))
    rows = kept.groupBy("sentence_id").agg(F.sum("r").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("rows"))
    cols = kept.groupBy("rater").agg(F.sum("r").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("cols"))
    one = total.join(rows).join(cols)
    correction = F.col("s") * F.col("s") / (F.col("k") * F.col("n"))
    one = one.withColumn("ssr", F.col("rows") / F.col("k") - correction).withColumn("ssc", F.col("cols") / F.col("n") - correction)
    one = one.withColumn("sse", F.col("ss") - correction - F.col("ssr") - F.col("ssc"))
    msr, msc = F.col("ssr") / (F.col("n") - 1), F.col("ssc") / (F.col("k") - 1)
    mse = F.col("sse") / ((F.col("n") - 1) * (F.col("k") - 1))
    value = (msr - mse) / (msr + (F.col("k") - 1) * mse + F.col("k") * (msc - mse) / F.col("n"))
    return one.select(F.col("n").alias("sentences"), F.col("k").alias("raters"), value.alias("icc"))


def alpha_sweep(df: DataFrame, human: str, step: float = 0.01) -> DataFrame:
    """Pearson correlation of the v3 index with the human score for each floor alpha from 0 to 1.

    ``df(ga, cf1, p, human)`` is crossed with the grid of at most 101 rows inside each row; one job does all points.
    """
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(round(1 / step))), lambda i: i * step)).alias("alpha")
    rows = df.select("ga", "cf1", "p", human, grid)
    return rows.groupBy("alpha").agg(F.corr(ctqi_v3(F.col("ga"), F.col("cf1"), F.col("p"), F.col("alpha")), human).alias("pearson"))


def best_alpha(sweep: DataFrame) -> DataFrame:
    return sweep.agg(F.max_by("alpha", F.struct(F.round("pearson", 9), -F.col("alpha"))).alias("alpha"), F.max("pearson").alias("pearson"))


def formula_grid(df: DataFrame, human: str, formulas: dict[str, Column]) -> DataFrame:
    """Each formula's correlation with the human score, best first."""
    long = df.select(human, *[c.alias(n) for n, c in formulas.items()]).unpivot([human], list(formulas), "formula", "score")
    out = long.groupBy("formula").agg(F.corr(human, "score").alias("pearson"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("pearson", 9)), "formula")))


def divergence(df: DataFrame) -> DataFrame:
    """From ``df(v1, v2, human, ga, cf1, p)``: which version is nearer, the weakest component, far over or under."""
    e1, e2 = F.col("v1") - F.col("human"), F.col("v2") - F.col("human")
    nearer = F.when(F.abs(e1) < F.abs(e2), "v1").when(F.abs(e2) < F.abs(e1), "v2").otherwise("tie")
    low = F.least("ga", "cf1", "p")
    weak = F.when(F.col("ga") == low, "ga").when(F.col("cf1") == low, "cf1").otherwise("p")
    side = F.when(e2 > 10, "over").when(e2 < -10, "under").otherwise("near")
    return df.groupBy(nearer.alias("nearer"), weak.alias("weak_link"), side.alias("side")).agg(F.count("*").alias("n"), F.avg(e2).alias("avg_residual"))


def band_stats(df: DataFrame, band: Column, least: int = 2) -> DataFrame:
    """Count, mean difference, its t, and its mean over the baseline's spread, in each band of ``df(baseline, model)``."""
    diff = F.col("model") - F.col("baseline")
    out = df.groupBy(band.alias("band")).agg(
        F.count("*").alias("n"), F.avg(diff).alias("mean_diff"), F.stddev_samp(diff).alias("sd"), F.stddev_samp("baseline").alias("sdb")
    ).where(F.col("n") >= least)
    t = F.when(F.col("sd") > 0, F.col("mean_diff") / (F.col("sd") / F.sqrt("n")))
    return out.select("band", "n", "mean_diff", t.alias("t"), F.when(F.col("sdb") > 0, F.col("mean_diff") / F.col("sdb")).alias("d"))


def threshold_sweep(df: DataFrame, thresholds: list[float], width: float = 10.0, least: int = 3) -> DataFrame:
    """Mean of ``value`` above and below each threshold of ``x``, and in the bin of ``width`` that begins there."""
    rows = df.select("x", "value", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    x, t = F.col("x"), F.col("threshold")
    inside = (x >= t) & (x < t + width)
    out = rows.groupBy("threshold").agg(
        F.count_if(x >= t).alias("n_above"), F.avg(F.when(x >= t, F.col("value"))).alias("above"), F.count_if(x < t).alias("n_below"),
        F.avg(F.when(x < t, F.col("value"))).alias("below"), F.count_if(inside).alias("n_bin"), F.avg(F.when(inside, F.col("value"))).alias("in_bin"),
    )
    return out.where((F.col("n_above") >= least) & (F.col("n_below") >= least))


def ablation(df: DataFrame, components: list[str]) -> DataFrame:
    """Effect of the mean of the components, and of the mean without each: ``df(entry_id, run, <components>)``.

    ``cohens_d`` is that of run 'model' over 'baseline'; ``loss`` what leaving the component out costs.
    """
    variants = {"full": components, **{f"without_{c}": [x for x in components if x != c] for c in components}}
    means = {v: sum(F.col(c) for c in kept) / len(kept) for v, kept in variants.items()}
    of = lambda run: [F.max(F.when(F.col("run") == run, x)).alias(f"{run}_{v}") for v, x in means.items()]
    both = df.groupBy("entry_id").agg(*of("model"), *of("baseline"))
    diff = {v: F.col(f"model_{v}") - F.col(f"baseline_{v}") for v in variants}
    one = both.agg(*[(F.avg(d) / F.stddev_samp(d)).alias(v) for v, d in diff.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("cohens_d")) for v in variants])).alias("row")
    out = one.select("full", rows).select("full", "row.*")
    return out.select("variant", "cohens_d", (F.col("full") - F.col("cohens_d")).alias("loss"))


def pca_weights(df: DataFrame, columns: list[str]) -> pd.DataFrame:
    """Weights from the first principal component of the columns' correlations, and the variance it explains.

    The correlations are one aggregate; their small matrix is taken apart on the driver.
    """
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    row = df.agg(*[F.corr(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    matrix = np.eye(len(columns))
    for i, j in pairs:
        matrix[i, j] = matrix[j, i] = row[f"c{i}_{j}"]
    values, vectors = np.linalg.eigh(matrix)
    loading = np.abs(vectors[:, -1])
    return pd.DataFrame({"component": columns, "weight": loading / loading.sum(), "explained": values[-1] / values.sum()})


def bootstrap_bca(scores: DataFrame, replicates: int = 10_000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Bias-corrected accelerated interval of the mean of each metric of ``scores(metric, value)``.

    Replicates are drawn with Poisson(1) weights from what each task has: a task sums weight and weighted value for all
    replicates over its rows, and only these sums are shuffled. The jackknife needs three moments.
    """
    block = 250
    parts = -(-replicates // block)
    # P(weight <= k) of Poisson(1)
    upto = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])

    def weights_of(keys: np.ndarray, b: int) -> np.ndarray:
        """Weights of the rows in the replicates of a block: the count of a hash of row key and replicate among ``upto``."""
        x = keys[:, None] + np.arange(b * block + 1, (b + 1) * block + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return np.searchsorted(upto, (x >> np.uint64(11)) * 2.0**-53, side="right").astype(float)

    def run(batches):
        held: dict[tuple[str, int], np.ndarray] = {}
        for pdf in batches:
            for metric, group in pdf.groupby("metric"):
                values, keys = group["value"].to_numpy(float), group["key"].to_numpy(np.int64).view(np.uint64)
                for b in range(parts):
                    acc = held.setdefault((metric, b), np.zeros((2, block)))
                    for start in range(0, len(values), 2_000):
                        v, k = values[start : start + 2_000], keys[start : start + 2_000]
                        weights = weights_of(k, b)
                        acc[0] += weights.sum(0)
                        acc[1] += v @ weights
        for (metric, b), acc in held.items():
            yield pd.DataFrame({"metric": metric, "replicate": b * block + np.arange(block), "w": acc[0], "s": acc[1]})

    keyed = scores.select("metric", "value", F.xxhash64("metric", "value", "id").alias("key"))
    sums = keyed.mapInPandas(run, "metric string, replicate long, w double, s double")
    means = sums.groupBy("metric", "replicate").agg(F.try_divide(F.sum("s"), F.sum("w")).alias("mean"))
    means = means.where((F.col("replicate") < replicates) & F.col("mean").isNotNull())
    x = F.col("value")
    moments = scores.groupBy("metric").agg(F.count("*").alias("n"), F.avg(x).alias("m"), F.skewness(x).alias("skew"), F.stddev_pop(x).alias("sd"))
    below = means.join(moments.select("metric", "m"), "metric").groupBy("metric").agg(
        F.avg((F.col("mean") < F.col("m")).cast("double")).alias("share"), F.sort_array(F.collect_list("mean")).alias("all")
    )

    def interval(pdf_iter):
        for pdf in pdf_iter:
            out = []
            for r in pdf.itertuples(index=False):
                share = min(max(r.share, 0.5 / replicates), 1 - 0.5 / replicates)
                z0 = D.normal_quantile(share)
                a = (0.0 if r.sd == 0 else r.skew) / (6 * math.sqrt(r.n))
                ends = []
                for p in ((1 - level) / 2, (1 + level) / 2):
                    z = z0 + D.normal_quantile(p)
                    ends.append(float(np.quantile(np.asarray(r.all, float), D.normal_cdf(z0 + z / (1 - a * z)))))
                out.append((r.metric, r.n, r.m, *ends))
            yield pd.DataFrame(out, columns=["metric", "n", "mean", "ci_low", "ci_high"])

    return below.join(moments, "metric").mapInPandas(interval, "metric string, n long, mean double, ci_low double, ci_high double")


def bleu_failures(df: DataFrame, n: int = 6) -> DataFrame:
    """The ``n`` entries of ``df(entry_id, bleu, human)`` where BLEU is furthest from the human score, with a reason."""
    error = F.col("bleu") - F.col("human")
    reason = F.when(error < -30, "valid wording punished").when(error > 30, "overlap without meaning").otherwise("moderate")
    return df.withColumn("error", error).withColumn("reason", reason).orderBy(F.desc(F.abs("error")), "entry_id").limit(n)
