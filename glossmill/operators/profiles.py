"""Reports over top-k predictions: accuracy, confusion, difficulty and error themes.

Predictions are ``(video_id, aug_id, signer_id, is_augmented, n_frames, true_gloss, top_k)``. All grouping goes by built-in
aggregates, which combine before the shuffle: the diagonal of the confusion matrix costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossmill.operators.statistics import percentiles
from glossmill.sources.scratch import written


def top1() -> Column:
    return F.col("top_k")[0]["gloss"]


def confidence() -> Column:
    return F.col("top_k")[0]["confidence"]


def correct() -> Column:
    return top1() == F.col("true_gloss")


def hit(k: int) -> Column:
    """The truth is among the first ``k`` candidates."""
    return F.exists(F.slice("top_k", 1, k), lambda c: c["gloss"] == F.col("true_gloss"))


def rate(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    """Counts of (true, predicted), long."""
    return predictions.groupBy("true_gloss", top1().alias("pred_gloss")).agg(F.count("*").alias("n"))


def confused_pairs(matrix: DataFrame) -> DataFrame:
    """Unordered pairs of confused classes: both directions, their share of the class's clips, and flags.

    ``systematic``: over a fifth of either class; ``one_sided``: one direction is more than three times the other.
    """
    totals = matrix.groupBy(F.col("true_gloss").alias("g")).agg(F.sum("n").alias("total"))
    wrong = matrix.where("true_gloss != pred_gloss")
    a, b = F.least("true_gloss", "pred_gloss"), F.greatest("true_gloss", "pred_gloss")
    pairs = wrong.groupBy(a.alias("a"), b.alias("b")).agg(
        F.sum(F.when(F.col("true_gloss") == a, F.col("n")).otherwise(0)).alias("a_to_b"),
        F.sum(F.when(F.col("true_gloss") == b, F.col("n")).otherwise(0)).alias("b_to_a"),
    )
    pairs = pairs.join(totals.select(F.col("g").alias("a"), F.col("total").alias("na")), "a", "left")
    pairs = pairs.join(totals.select(F.col("g").alias("b"), F.col("total").alias("nb")), "b", "left")
    pairs = pairs.withColumn("share_a", F.coalesce(F.col("a_to_b") / F.col("na") * 100, F.lit(0.0)))
    pairs = pairs.withColumn("share_b", F.coalesce(F.col("b_to_a") / F.col("nb") * 100, F.lit(0.0)))
    one_sided = F.greatest("a_to_b", "b_to_a") > 3 * F.least("a_to_b", "b_to_a")
    return pairs.select(
        "a", "b", "a_to_b", "b_to_a", "share_a", "share_b",
        (F.greatest("share_a", "share_b") > 20).alias("systematic"), one_sided.alias("one_sided"),
    )


def per_class_accuracy(predictions: DataFrame) -> DataFrame:
    """Clips, hits and rates of each class with its three commonest confusions."""
    counts = predictions.groupBy("true_gloss").agg(
        F.count("*").alias("total"), F.count_if(correct()).alias("correct"), (rate(correct()) * 100).alias("top1"), (rate(hit(3)) * 100).alias("top3")
    )
    order = Window.partitionBy("true_gloss").orderBy(F.desc("n"), "pred_gloss")
    wrong = confusion_matrix(predictions).where("true_gloss != pred_gloss").withColumn("k", F.row_number().over(order)).where("k <= 3")
    listed = F.array_sort(F.collect_list(F.struct("k", "pred_gloss", "n")))
    names = wrong.groupBy("true_gloss").agg(F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["pred_gloss"], x["n"].cast("string"))), ",").alias("confusions"))
    return counts.join(names, "true_gloss", "left").withColumn("confusions", F.coalesce("confusions", F.lit("")))


def keep_drop(report: DataFrame, least_top1: float, least_top3: float) -> DataFrame:
    """Classes to keep: both rates reach their threshold."""
    keep = (F.col("top1") >= least_top1) & (F.col("top3") >= least_top3)
    return report.withColumn("decision", F.when(keep, "keep").otherwise("drop"))


def difficulty(top3: Column, conf: Column) -> Column:
    """Label from the top-3 rate and the mean confidence, both in percent."""
    return F.when((top3 >= 90) & (conf >= 70), "easy").when((top3 >= 75) & (conf >= 50), "medium").otherwise("hard")


def severity(value: Column, thresholds: tuple[float, float, float] = (0.5, 0.3, 0.1)) -> Column:
    high, medium, low = thresholds
    return F.when(value >= high, "critical").when(value >= medium, "high").when(value >= low, "medium").otherwise("low")


def sign_profiles(predictions: DataFrame) -> DataFrame:
    """Profile of each class: counts, hit rates, confidence of the best candidate and of the truth where it is listed."""
    truth = F.get(F.filter(F.slice("top_k", 1, 3), lambda c: c["gloss"] == F.col("true_gloss")), F.lit(0))["confidence"]
    base = predictions.select("true_gloss", "is_augmented", correct().alias("c1"), hit(2).alias("c2"), hit(3).alias("c3"), confidence().alias("conf"), truth.alias("in3"))
    stats = base.groupBy(F.col("true_gloss").alias("sign")).agg(
        F.count("*").alias("n_clips"),
        F.count_if(~F.col("is_augmented")).alias("n_originals"),
        (rate(F.col("c1")) * 100).alias("top1_accuracy"),
        (rate(F.col("c2")) * 100).alias("top2_hit_rate"),
        (rate(F.col("c3")) * 100).alias("top3_hit_rate"),
        (F.avg("conf") * 100).alias("avg_confidence"),
        (F.stddev_pop("conf") * 100).alias("std_confidence"),
        (F.avg("in3") * 100).alias("avg_true_confidence"),
    )
    return stats.withColumn("difficulty", difficulty(F.col("top3_hit_rate"), F.col("avg_confidence")))


def confusion_maps(predictions: DataFrame) -> DataFrame:
    """Confusions of each class as a map from the predicted class to its count."""
    wrong = confusion_matrix(predictions).where("true_gloss != pred_gloss")
    return wrong.groupBy(F.col("true_gloss").alias("sign")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pred_gloss", "n")))).alias("confusions"))


def pass_rate(profiles: DataFrame, least_confidence: float = 70, least_top3: float = 85) -> DataFrame:
    """Classes that reach both thresholds, and their share."""
    passes = (F.col("top3_hit_rate") >= least_top3) & (F.col("avg_confidence") >= least_confidence)
    return profiles.agg(F.count("*").alias("signs"), F.count_if(passes).alias("passing"), (rate(passes) * 100).alias("pass_rate"))


def per_gloss_performance(predictions: DataFrame, least: int = 5) -> DataFrame:
    """Accuracy of each class, its first ten faulty videos and its band."""
    wrong = predictions.where(~correct()).select("true_gloss", "video_id").distinct()
    first = wrong.withColumn("i", F.row_number().over(Window.partitionBy("true_gloss").orderBy("video_id"))).where("i <= 10")
    errors = first.groupBy("true_gloss").agg(F.array_sort(F.collect_list("video_id")).alias("errors"))
    acc = F.col("accuracy")
    band = F.when(acc < 0.25, "0-25").when(acc < 0.5, "25-50").when(acc < 0.75, "50-75").otherwise("75-100")
    out = predictions.groupBy("true_gloss").agg(F.count("*").alias("n"), rate(correct()).alias("accuracy")).join(errors, "true_gloss", "left")
    out = out.withColumn("errors", F.coalesce("errors", F.array().cast(errors.schema["errors"].dataType)))
    return out.withColumn("band", band).withColumn("poor", (acc < 0.5) & (F.col("n") >= least))


def signer_clusters(predictions: DataFrame, bins: int = 10, least: int = 5) -> DataFrame:
    """Accuracy in ``bins`` bins of equal width of the numeric id; ``problem``: a tenth below the overall accuracy.

    The range and the overall accuracy are one row, which is broadcast.
    """
    overall = predictions.agg(F.min("video_id").alias("lo"), F.max("video_id").alias("hi"), rate(correct()).alias("overall"))
    width = F.greatest((F.col("hi") - F.col("lo")) / bins, F.lit(1e-9))
    number = F.least(F.floor((F.col("video_id") - F.col("lo")) / width), F.lit(bins - 1))
    binned = predictions.join(F.broadcast(overall)).withColumn("bin", number)
    out = binned.groupBy("bin").agg(F.count("*").alias("n"), rate(correct()).alias("accuracy"), F.first("overall").alias("overall"))
    return out.where(F.col("n") >= least).withColumn("problem", F.col("accuracy") < F.col("overall") - 0.1).drop("overall")


def length_buckets(predictions: DataFrame, least: int = 10) -> DataFrame:
    """Accuracy in five buckets of the number of frames."""
    n = F.col("n_frames")
    bucket = F.when(n < 30, "0-30").when(n < 60, "30-60").when(n < 90, "60-90").when(n < 120, "90-120").otherwise("120+")
    out = predictions.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), rate(correct()).alias("accuracy"))
    return out.where(F.col("n") >= least)


def augmentation_quality(predictions: DataFrame, least: int = 3, gap: float = 0.2) -> DataFrame:
    """Accuracy on originals and on augmented clips of each class that has ``least`` of both; large gaps are flagged."""
    aug = F.col("is_augmented")
    out = predictions.groupBy("true_gloss").agg(
        F.count_if(~aug).alias("n_original"), F.count_if(aug).alias("n_augmented"),
        F.avg(F.when(~aug, correct().cast("double"))).alias("acc_original"), F.avg(F.when(aug, correct().cast("double"))).alias("acc_augmented"),
    )
    out = out.where((F.col("n_original") >= least) & (F.col("n_augmented") >= least))
    return out.withColumn("gap", F.col("acc_original") - F.col("acc_augmented")).withColumn("flagged", F.abs("gap") > gap)


def classification_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class; a class without predictions or clips has 0 there."""
    truth = predictions.groupBy(F.col("true_gloss").alias("gloss")).agg(F.count("*").alias("support"), F.count_if(correct()).alias("tp"))
    said = predictions.groupBy(top1().alias("gloss")).agg(F.count("*").alias("predicted"))
    both = truth.join(said, "gloss", "full_outer").na.fill(0, ["support", "tp", "predicted"])
    precision = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    out = both.withColumn("precision", precision).withColumn("recall", recall)
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return out.withColumn("f1", f1.otherwise(0.0)).select("gloss", "precision", "recall", "f1", "support")


def report_averages(report: DataFrame) -> DataFrame:
    """Macro and support-weighted averages of a classification report."""
    weighted = [(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")]
    return report.agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], *weighted)


def confidence_by_outcome(predictions: DataFrame) -> DataFrame:
    """Mean and spread of the confidence of right and of wrong predictions."""
    return predictions.groupBy(correct().alias("is_correct")).agg(
        F.count("*").alias("n"), F.avg(confidence()).alias("avg_confidence"), F.stddev_pop(confidence()).alias("std_confidence")
    )


def compare_profiles(a: DataFrame, b: DataFrame) -> DataFrame:
    """Classes in both runs with the change of their rates."""
    old = a.select("sign", F.col("top1_accuracy").alias("top1_a"), F.col("top3_hit_rate").alias("top3_a"))
    new = b.select("sign", F.col("top1_accuracy").alias("top1_b"), F.col("top3_hit_rate").alias("top3_b"))
    both = old.join(new, "sign")
    return both.withColumn("top1_change", F.col("top1_b") - F.col("top1_a")).withColumn("top3_change", F.col("top3_b") - F.col("top3_a"))


def merge_profiles(a: DataFrame, b: DataFrame) -> DataFrame:
    """Profiles of either run; where both have a class the first one's count."""
    return a.unionByName(b.join(a.select("sign"), "sign", "left_anti"))


def curate_vocabulary(profiles: DataFrame, matrix: DataFrame, least_top3: float = 85, share: float = 0.5) -> DataFrame:
    """Classes to drop: a failing class most of whose errors go to one other class.

    If that other class passes, the failing one goes; if both fail, the one with the lower top-3 rate (ties: the later
    name). Returns the class dropped, the class that caused it and the share of its errors.
    """
    wrong = matrix.where("true_gloss != pred_gloss")
    errors = wrong.groupBy(F.col("true_gloss").alias("sign")).agg(
        F.sum("n").alias("errors"), F.max_by(F.struct("pred_gloss", "n"), F.struct("n", "pred_gloss")).alias("main")
    )
    main = errors.select("sign", F.col("main.pred_gloss").alias("target"), (F.col("main.n") / F.col("errors")).alias("share")).where(F.col("share") >= share)
    rated = profiles.select("sign", "top3_hit_rate", (F.col("top3_hit_rate") >= least_top3).alias("passes"))
    other = rated.select(F.col("sign").alias("target"), F.col("top3_hit_rate").alias("other_top3"), F.col("passes").alias("other_passes"))
    failing = main.join(rated.where(~F.col("passes")), "sign").join(other, "target")
    goes_self = F.col("other_passes") | (F.col("top3_hit_rate") < F.col("other_top3")) | ((F.col("top3_hit_rate") == F.col("other_top3")) & (F.col("sign") > F.col("target")))
    gone = failing.select(F.when(goes_self, F.col("sign")).otherwise(F.col("target")).alias("dropped"), F.when(goes_self, F.col("target")).otherwise(F.col("sign")).alias("because"), "share")
    return gone.groupBy("dropped").agg(F.min_by(F.struct("because", "share"), F.struct(-F.col("share"), "because")).alias("x")).select("dropped", "x.because", "x.share")


def vocabulary_curve(profiles: DataFrame, thresholds: tuple[int, ...] = (75, 80, 85, 90)) -> DataFrame:
    """Share of the best ``size`` classes that reach each threshold; classes are a dimension, ordered in one task."""
    upto = Window.orderBy(F.desc("top3_hit_rate"), "sign")
    out = profiles.withColumn("size", F.row_number().over(upto))
    for t in thresholds:
        out = out.withColumn(f"meets_{t}", F.avg((F.col("top3_hit_rate") >= t).cast("double")).over(upto.rowsBetween(Window.unboundedPreceding, 0)) * 100)
    return out.where("size >= 5").select("size", "sign", *[f"meets_{t}" for t in thresholds])


def rank_glosses(profiles: DataFrame) -> DataFrame:
    """Rank by top-1, top-3 and confidence."""
    order = Window.orderBy(F.desc("top1_accuracy"), F.desc("top3_hit_rate"), F.desc("avg_confidence"))
    return profiles.select("sign", F.dense_rank().over(order).alias("rank"))


def confidence_gate(predictions: DataFrame, least: float = 0.5) -> DataFrame:
    """Predictions below the threshold become ``<LOW_CONF>``."""
    return predictions.withColumn("gated", F.when(confidence() >= least, top1()).otherwise("<LOW_CONF>"))


def scaling_projection(profiles: DataFrame, sizes: tuple[int, ...] = (5, 10, 15, 20), targets: tuple[int, ...] = (50, 100, 200)) -> DataFrame:
    """Mean top-3 rate of the best ``size`` classes, and its logarithmic fit carried on to ``targets``."""
    ranked = profiles.withColumn("r", F.row_number().over(Window.orderBy(F.desc("top3_hit_rate"), "sign")))
    each = ranked.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).where("r <= size")
    means = each.groupBy("size").agg(F.avg("top3_hit_rate").alias("top3"))
    x = F.log(F.col("size").cast("double"))
    fit = means.agg(F.regr_slope("top3", x).alias("b"), F.regr_intercept("top3", x).alias("a"))
    said = fit.select(F.explode(F.array(*map(F.lit, targets))).alias("size"), "a", "b")
    value = F.least(F.greatest(F.col("a") + F.col("b") * F.log(F.col("size").cast("double")), F.lit(0.0)), F.lit(100.0))
    return means.withColumn("projected", F.lit(False)).unionByName(said.select("size", value.alias("top3"), F.lit(True).alias("projected")))


def scaling_analysis(sweeps: DataFrame, targets: tuple[float, ...] = (50.0, 70.0, 90.0), chronic: int = 2) -> tuple[DataFrame, DataFrame]:
    """From ``sweeps(n, sign, passes)``: largest n at or above and smallest below each target, and chronic failures."""
    rates = sweeps.groupBy("n").agg((rate(F.col("passes")) * 100).alias("pass_rate"))
    goals = sweeps.sparkSession.createDataFrame([(t,) for t in targets], "target double")
    met = F.col("pass_rate") >= F.col("target")
    reach = goals.join(rates).groupBy("target").agg(F.max(F.when(met, F.col("n"))).alias("max_above"), F.min(F.when(~met, F.col("n"))).alias("min_below"))
    failures = sweeps.where(~F.col("passes")).groupBy("sign").agg(F.count("*").alias("failures")).where(F.col("failures") >= chronic)
    return reach, failures


def worst_best(report: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` worst and the ``n`` best classes; ties by name."""
    worst = report.orderBy("accuracy", "true_gloss").limit(n).withColumn("side", F.lit("worst"))
    return worst.unionByName(report.orderBy(F.desc("accuracy"), "true_gloss").limit(n).withColumn("side", F.lit("best")))


def motion_complexity(moves: DataFrame, predictions: DataFrame, by: str = "clip_id") -> DataFrame:
    """Accuracy of clips by how much their movement varies, in thirds.

    ``moves(clip_id, frame_idx, move)`` has the displacement from the frame before (null for the first); a clip's
    complexity is the population spread of its moves. ``predictions(clip_id, correct)``. The bounds are the exact
    percentiles 33 and 66 of all clips, one row that is joined to all. Returns ``(complexity, clips, accuracy, spread)``.
    """
    spread = moves.groupBy(by).agg(F.stddev_pop("move").alias("spread"))
    known = written(predictions.join(spread, by).where("spread IS NOT NULL"), "spreads")
    bounds = percentiles(known, "spread", [0.33, 0.66]).select(F.col("percentiles").alias("b"))
    name = F.when(F.col("spread") <= F.col("b")[0], "low").when(F.col("spread") <= F.col("b")[1], "medium").otherwise("high")
    return (
        known.crossJoin(F.broadcast(bounds))
        .groupBy(name.alias("complexity"))
        .agg(F.count("*").alias("clips"), F.avg(F.col("correct").cast("int")).alias("accuracy"), F.avg("spread").alias("spread"))
    )
