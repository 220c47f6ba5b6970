"""Leak-free splits of clip families, their checks, augmentation and balancing plans.

Everything here works on metadata rows ``(clip_id, gloss, video_id, aug_id, is_augmented, n_frames)``; keypoints are never
moved to decide a split. Shuffles are by the MD5 of seed and key, so a retried task and another engine agree.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossmill.operators.statistics import sums_below
from glossmill.sources.scratch import written


def shuffled(seed: str, *key: Column) -> Column:
    """A key to order by that looks random and is the same every time."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in key]))


def frame_bucket(n: Column) -> Column:
    """Short, medium or long by the number of frames."""
    return F.when(n < 50, "short").when(n < 80, "medium").otherwise("long")


def parse_family(file: Column) -> Column:
    """Original video of a clip's file name, whatever convention names the augmentation."""
    stem = F.regexp_replace(F.regexp_replace(file, r"^.*/", ""), r"\.[A-Za-z0-9]+$", "")
    stem = F.regexp_replace(stem, r"^aug_\d+_", "")
    return F.split(F.split(stem, "_aug")[0], "_balance")[0]


def is_augmented(file: Column) -> Column:
    return file.contains("_aug") | file.rlike(r"(^|/)aug_\d+_")


def video_number(name: Column) -> Column:
    """Greatest number in a name, null if there is none."""
    return F.array_max(F.transform(F.regexp_extract_all(name, F.lit(r"(\d+)"), 1), lambda x: x.cast("long")))


def families(clips: DataFrame) -> DataFrame:
    """Families that have an original: clips, augmentations, and frames of the original."""
    original = ~F.col("is_augmented")
    out = clips.groupBy("gloss", "video_id").agg(
        F.count("*").alias("n_clips"),
        F.count_if(original).alias("n_originals"),
        F.max(F.when(original, F.col("n_frames"))).alias("n_frames"),
    )
    return out.where("n_originals > 0").withColumn("bucket", frame_bucket(F.col("n_frames")))


def stratified_family_split(fams: DataFrame, val: float = 0.15, test: float = 0.15, seed: str = "42") -> DataFrame:
    """Split of each family, the same for all of its clips.

    Of a class with three families or more each split gets one, and the rest is dealt by frame bucket with truncated
    shares; a class with two has train and val, with one only train. Class windows hold one row for each family.
    """
    order = shuffled(seed, F.col("gloss"), F.col("video_id"))
    cls = Window.partitionBy("gloss")
    rows = fams.withColumn("rn", F.row_number().over(cls.orderBy(order, "video_id"))).withColumn("n", F.count("*").over(cls))
    rest = (F.col("n") >= 3) & (F.col("rn") > 3)
    bucket = Window.partitionBy("gloss", "bucket", rest)
    rows = rows.withColumn("brn", F.row_number().over(bucket.orderBy(order, "video_id"))).withColumn("bn", F.count("*").over(bucket))
    n_val, n_test = (F.col("bn") * val).cast("int"), (F.col("bn") * test).cast("int")
    split = (
        F.when(rest & (F.col("brn") <= n_val), "val")
        .when(rest & (F.col("brn") <= n_val + n_test), "test")
        .when(rest, "train")
        .when(F.col("rn") == 1, "train")
        .when(F.col("rn") == 2, "val")
        .otherwise("test")
    )
    return rows.withColumn("split", split).drop("rn", "n", "brn", "bn")


def rounded_split(videos: DataFrame, share: float = 0.15, seed: str = "42") -> DataFrame:
    """val and test each the rounded share (half to even), at least one, for classes of three or more; else train."""
    cls = Window.partitionBy("gloss")
    order = shuffled(seed, F.col("gloss"), F.col("video_id"))
    rows = videos.withColumn("rn", F.row_number().over(cls.orderBy(order, "video_id"))).withColumn("n", F.count("*").over(cls))
    k = F.greatest(F.bround(F.col("n") * share).cast("int"), F.lit(1))
    k = F.when(2 * k < F.col("n"), k).otherwise(1)
    split = F.when(F.col("n") < 3, "train").when(F.col("rn") <= k, "val").when(F.col("rn") <= 2 * k, "test").otherwise("train")
    return rows.withColumn("split", split).drop("rn", "n")


def simple_split(videos: DataFrame, train: float = 0.7, val: float = 0.15, seed: str = "42") -> DataFrame:
    """Truncated shares with at least one video in each split of a class of three or more; train gives way first."""
    cls = Window.partitionBy("gloss")
    order = shuffled(seed, F.col("gloss"), F.col("video_id"))
    rows = videos.withColumn("rn", F.row_number().over(cls.orderBy(order, "video_id"))).withColumn("n", F.count("*").over(cls))
    n = F.col("n")
    n_val = F.greatest((n * val).cast("int"), F.lit(1))
    n_train = F.greatest(F.least(F.greatest((n * train).cast("int"), F.lit(1)), n - n_val - 1), F.lit(1))
    split = F.when(F.col("rn") <= n_train, "train").when(F.col("rn") <= n_train + n_val, "val").otherwise("test")
    return rows.withColumn("split", split).drop("rn", "n")


def leaky_split(clips: DataFrame, train: float = 0.7, val: float = 0.15, seed: str = "42") -> DataFrame:
    """The control experiment: clips are dealt one by one, whatever family they are of."""
    rows = _dealt(clips, seed)
    a, b = (F.col("n") * train).cast("int"), (F.col("n") * val).cast("int")
    return rows.withColumn("split", F.when(F.col("rn") <= a, "train").when(F.col("rn") <= a + b, "val").otherwise("test")).drop("rn", "n")


def _dealt(clips: DataFrame, seed: str) -> DataFrame:
    """``clips`` with their place ``rn`` in the shuffled order of their class and its size ``n``.

    A class is cut by the first three digits of the hash that orders it into up to 4,096 even ranges, whose totals are
    summed up first, so no task orders a whole class.
    """
    order = shuffled(seed, F.col("clip_id"))
    rows = clips.withColumn("_order", order).withColumn("_range", F.substring("_order", 1, 3)).withColumn("_class", F.struct("gloss"))
    counts = rows.groupBy("_class", "_range").agg(F.count("*").alias("_in"))
    cls = Window.partitionBy("_class")
    ahead = cls.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_class", "_range", F.coalesce(F.sum("_in").over(ahead), F.lit(0)).alias("_before"), F.sum("_in").over(cls).alias("n"))
    inside = Window.partitionBy("_class", "_range").orderBy("_order", "clip_id")
    placed = rows.withColumn("_rn", F.row_number().over(inside)).join(counts, ["_class", "_range"])
    return placed.withColumn("rn", F.col("_rn") + F.col("_before")).select(*clips.columns, "rn", "n")


def random_stratified_split(clips: DataFrame, train: float = 0.8, seed: str = "42") -> DataFrame:
    rows = _dealt(clips, seed)
    return rows.withColumn("split", F.when(F.col("rn") <= F.bround(F.col("n") * train), "train").otherwise("val")).drop("rn", "n")


def assign(clips: DataFrame, fams: DataFrame) -> DataFrame:
    """Clips with the split of their family."""
    return clips.join(fams.select("gloss", "video_id", "split"), ["gloss", "video_id"])


def leaky_overlap(assigned: DataFrame) -> DataFrame:
    """Families in two splits, and their share of the smaller-named split's families."""
    known = ["gloss", "video_id"]  # rows with a null key meet no other, but count as a family
    of = assigned.groupBy(*known).agg(F.collect_set("split").alias("splits"))
    of = of.groupBy("splits", F.col("gloss").isNotNull() & F.col("video_id").isNotNull()).agg(F.count("*").alias("n")).toDF("splits", "joins", "n")
    of = written(of, "families")  # a row for each set of splits
    sizes = of.select("n", F.explode("splits").alias("a")).groupBy("a").agg(F.sum("n").alias("families"))
    one = of.where("joins").withColumn("a", F.explode("splits"))
    both = one.select("n", "a", F.explode("splits").alias("b")).where("a < b").groupBy("a", "b").agg(F.sum("n").alias("shared"))
    return both.join(sizes, "a").select("a", "b", "shared", (F.col("shared") / F.col("families") * 100).alias("share"))


def split_summary(assigned: DataFrame) -> DataFrame:
    """Families, clips and originals of each split and class, with subtotals (null class) and the total (both null)."""
    return assigned.rollup("split", "gloss").agg(
        F.count_distinct("video_id").alias("families"), F.count("*").alias("clips"), F.count_if(~F.col("is_augmented")).alias("originals")
    )


def class_balance(assigned: DataFrame) -> DataFrame:
    """Clips of each class by split with the spread over classes; classes missing in val (3 or more) and test (5)."""
    counts = assigned.groupBy("gloss").agg(*[F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")], F.count("*").alias("total"))
    spread = counts.agg((F.stddev_pop("train") / F.avg("train")).alias("train_cv"))
    out = counts.join(F.broadcast(spread))
    return out.withColumn("missing_val", (F.col("val") == 0) & (F.col("total") >= 3)).withColumn("missing_test", (F.col("test") == 0) & (F.col("total") >= 5))


def sample_ratio_check(assigned: DataFrame) -> DataFrame:
    """Share of train, and whether it is between a half and nine tenths with no empty split."""
    n = {s: F.count_if(F.col("split") == s) for s in ("train", "val", "test")}
    out = assigned.agg(*[x.alias(s) for s, x in n.items()], (n["train"] / F.count("*")).alias("train_ratio"))
    return out.withColumn("passed", F.col("train_ratio").between(0.5, 0.9) & (F.col("val") > 0) & (F.col("test") > 0))


def ks_two_sample(values: DataFrame, a: str, b: str, least: int = 10) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic of ``values(part, value)`` between the parts ``a`` and ``b``.

    Rows are counted by value first; running sums over the distinct values are taken in ranges of the value. Nothing
    comes back if a part has fewer than ``least`` rows.
    """
    counts = values.groupBy("value").agg(F.count_if(F.col("part") == a).alias("na"), F.count_if(F.col("part") == b).alias("nb"))
    total = counts.agg(F.sum("na").alias("all_a"), F.sum("nb").alias("all_b")).where((F.col("all_a") >= least) & (F.col("all_b") >= least))
    below = sums_below(counts, "value", [], ["na", "nb"]).join(F.broadcast(total))  # one row
    gap = F.abs((F.col("below_na") + F.col("na")) / F.col("all_a") - (F.col("below_nb") + F.col("nb")) / F.col("all_b"))
    return below.groupBy(F.col("all_a").alias("na"), F.col("all_b").alias("nb")).agg(F.max(gap).alias("statistic"))


def augmentation_plan(counts: DataFrame, target: int = 100, least: int = 1, most: int = 60) -> DataFrame:
    """Augmentations for each original of a class: what is missing to ``target``, spread evenly and clamped."""
    missing = F.greatest(F.lit(target) - F.col("n"), F.lit(0))
    per = F.least(F.greatest(F.floor(missing / F.col("n")), F.lit(least)), F.lit(most))
    return counts.withColumn("missing", missing).withColumn("per_video", F.when(missing == 0, 0).otherwise(per))


def balancing_plan(train: DataFrame, target: int | None = None) -> DataFrame:
    """How many more augmentations each family of a class gets to bring the class up to ``target``, or to the largest.

    ``train(gloss, video_id)``: a row for each clip. More than the augmentations of the largest family less one are not
    added; whole numbers leave some classes short.
    """
    fams = train.groupBy("gloss", "video_id").agg(F.count("*").alias("size"))
    per = fams.groupBy("gloss").agg(F.sum("size").alias("n"), F.count("*").alias("families"), F.max("size").alias("largest"))
    if target is None:
        out = per.join(F.broadcast(per.agg(F.max("n").alias("target"))))  # one row
    else:
        out = per.withColumn("target", F.lit(target).cast("long"))
    out = out.withColumn("needed", F.greatest(F.col("target") - F.col("n"), F.lit(0)))
    extra = F.least(F.floor(F.col("needed") / F.col("families")), F.greatest(F.col("largest") - 1, F.lit(0)))
    out = out.withColumn("per_family", extra).withColumn("after", F.col("n") + F.col("per_family") * F.col("families"))
    status = F.when(F.col("needed") == 0, "already_balanced").when(F.col("after") == F.col("target"), "balanced").otherwise("partial")
    return out.withColumn("status", status)


def balance_rows(train: DataFrame, target: int | None = None) -> DataFrame:
    """The rows that a balancing plan adds: families with new augmentation numbers that continue their own."""
    plan = balancing_plan(train, target).where("per_family > 0").select("gloss", "per_family")
    fams = train.groupBy("gloss", "video_id").agg(F.max("aug_id").alias("last"))
    ids = F.sequence(F.col("last") + 1, F.col("last") + F.col("per_family").cast("int"))
    return fams.join(plan, "gloss").select("gloss", "video_id", F.explode(ids).alias("aug_id"))


def balance_train(train: DataFrame, target: int, seed: str = "42") -> DataFrame:
    """``train(clip_id, gloss, video_id, aug_id, is_augmented)`` balanced: augmentations are added, then capped at ``target``.

    New clips are named ``<video>_balance_<number>`` and carry their ``technique``, null for those that were there;
    :func:`augmentation_sequence` gives it by the clip's place among the new ones of its family. Originals all stay.
    """
    new = balance_rows(train, target)
    fams = new.groupBy("gloss", "video_id").agg(F.count("*").alias("n"), F.min("aug_id").alias("first"))
    named = augmentation_sequence(fams.select(F.struct("gloss", "video_id", "first").alias("key"), "n"))
    new = named.select(
        F.concat_ws("_", F.col("key.video_id").cast("string"), F.lit("balance"), F.col("key.first") + F.col("aug_no")).alias("clip_id"),
        "key.gloss", "key.video_id", (F.col("key.first") + F.col("aug_no")).alias("aug_id"), F.lit(True).alias("is_augmented"), "technique",
    )
    every = train.select("clip_id", "gloss", "video_id", "aug_id", "is_augmented", F.lit(None).cast("string").alias("technique"))
    return cap_class(every.unionByName(new), target, seed)


def balance_summary(train: DataFrame, balanced: DataFrame, target: int) -> DataFrame:
    """Clips of each class before and after, how many of the latter are new, and whether the target is met."""
    before = train.groupBy("gloss").agg(F.count("*").alias("before"))
    after = balanced.groupBy("gloss").agg(F.count("*").alias("after"), F.count_if(F.col("technique").isNotNull()).alias("added"))
    return before.join(after, "gloss").withColumn("achieved", F.col("after") == target)


#: Techniques in the order of the configuration, with their weights.
TECHNIQUES = (
    ("geometric", 3.0), ("noise", 2.0), ("translation", 2.0), ("scaling", 2.0), ("speed", 2.0), ("flip", 1.0),
    ("occlusion", 1.0), ("hand_drop", 1.0), ("temporal_warp", 1.0), ("proportion", 1.0), ("viewpoint", 1.0), ("combined", 1.0),
)


def augmentation_sequence(sizes: DataFrame, techniques: tuple[tuple[str, float], ...] = TECHNIQUES) -> DataFrame:
    """Technique of each augmentation ``0 .. n-1`` of ``sizes(key, n)``, in the order of the table.

    Each technique gets its truncated share, at least one, until ``n`` is reached; what is left over is geometric.
    """
    total = sum(w for _, w in techniques)
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(name).alias("technique"), F.lit(w).alias("w")) for i, (name, w) in enumerate(techniques)])
    each = sizes.where("n > 0").select("key", F.col("n").cast("long").alias("n"), F.explode(table).alias("t")).select("key", "n", "t.*")
    each = each.withColumn("uses", F.greatest(F.lit(1), (F.col("n") * F.col("w") / total).cast("long")))
    order = Window.partitionBy("key").orderBy("i")
    each = each.withColumn("stop", F.sum("uses").over(order)).withColumn("start", F.col("stop") - F.col("uses"))
    rest = each.where((F.col("i") == len(techniques) - 1) & (F.col("stop") < F.col("n")))
    rest = rest.select("key", "n", F.col("stop").alias("start"), F.col("n").alias("stop"), F.lit("geometric").alias("technique"))
    runs = each.where("start < n").select("key", "n", "start", F.least("stop", "n").alias("stop"), "technique").unionByName(rest)
    return runs.select("key", "n", F.explode(F.sequence("start", F.col("stop") - 1)).alias("aug_no"), "technique")


def cap_class(clips: DataFrame, target: int, seed: str = "42") -> DataFrame:
    """All originals, and augmentations drawn up to ``target`` clips of a class."""
    order = Window.partitionBy("gloss").orderBy(F.col("is_augmented").cast("int"), shuffled(seed, F.col("clip_id")), "clip_id")
    return clips.withColumn("rn", F.row_number().over(order)).where((F.col("rn") <= target) | ~F.col("is_augmented")).drop("rn")


def targeted_manifest(clips: DataFrame, targeted: DataFrame) -> DataFrame:
    """Augmentations of the classes in ``targeted(gloss)`` only, originals of all."""
    marked = clips.join(targeted.select("gloss", F.lit(True).alias("wanted")).distinct(), "gloss", "left")
    return marked.where(F.col("wanted") | ~F.col("is_augmented")).drop("wanted")


def signer_groups(videos: DataFrame, gap: int = 100) -> DataFrame:
    """Runs of numeric video ids of a class with steps of at most ``gap``, numbered from 0."""
    order = Window.partitionBy("gloss").orderBy("video_id")
    new = F.coalesce((F.col("video_id") - F.lag("video_id").over(order) > gap).cast("int"), F.lit(0))
    return videos.withColumn("new", new).withColumn("signer_group", F.sum("new").over(order)).drop("new")


def signer_aware_split(videos: DataFrame, gap: int = 100) -> DataFrame:
    """Whole signer groups go to one split, so that no signer is met in training and testing.

    One group: shares of its videos. Two groups: the larger trains, the other tests, and its first video goes to val.
    More: groups from the largest on go where most is missing of 70, 15 and 15 percent. A class with one video copies it
    to all splits, with two its second one to val as well (``is_copy``). The choice of one group depends on the earlier
    ones, so it runs in a task for each class with more than two, over one row for each group; videos only join it.
    """
    grouped = signer_groups(videos.select("gloss", "video_id").distinct(), gap)
    sizes = grouped.groupBy("gloss", "signer_group").agg(F.count("*").alias("size"))
    total = Window.partitionBy("gloss")
    sizes = sizes.withColumns({"n": F.sum("size").over(total), "groups": F.count("*").over(total)})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "signer_group"], ascending=[False, True])
        have, n, where = dict.fromkeys(("train", "val", "test"), 0), int(pdf["n"].iloc[0]), []
        want = {"train": 0.7 * n, "val": 0.15 * n, "test": 0.15 * n}
        for k, size in enumerate(pdf["size"]):
            empty = [s for s in have if not have[s]]
            split = empty[0] if len(pdf) - k <= len(empty) else max(have, key=lambda s: (want[s] - have[s], s))
            where.append(split)
            have[split] += int(size)
        return pdf.assign(chosen=where)[["gloss", "signer_group", "chosen"]]

    many = sizes.where("groups > 2 AND n > 3").groupBy("gloss").applyInPandas(run, "gloss string, signer_group long, chosen string")
    # Of two groups the larger one trains.
    second = Window.partitionBy("gloss").orderBy(F.desc("size"), "signer_group")
    sizes = sizes.withColumn("second", F.row_number().over(second) == 2).join(many, ["gloss", "signer_group"], "left")
    order = Window.partitionBy("gloss").orderBy("video_id")
    rows = grouped.withColumns({"i": F.row_number().over(order) - 1, "first": F.coalesce(F.lag("signer_group").over(order) != F.col("signer_group"), F.lit(True))})
    rows = rows.join(sizes, ["gloss", "signer_group"])

    def put(split: Column | str, copy: bool = False) -> Column:
        return F.struct((F.lit(split) if isinstance(split, str) else split).alias("split"), F.lit(copy).alias("is_copy"))

    i, n = F.col("i"), F.col("n")
    n_val = F.greatest(F.lit(1), F.floor(n * 0.15))
    n_train = F.greatest(F.lit(1), F.least(F.floor(n * 0.7), n - n_val - 1))
    by_share = F.when(i < n_train, "train").when(i < n_train + n_val, "val").otherwise("test")
    places = (
        F.when(n == 1, F.array(put("train"), put("val", True), put("test", True)))
        .when((n == 2) & (i == 0), F.array(put("train")))
        .when(n == 2, F.array(put("test"), put("val", True)))
        .when((n == 3) | (F.col("groups") == 1), F.array(put(by_share)))
        .when(F.col("groups") > 2, F.array(put(F.col("chosen"))))
        .when(~F.col("second"), F.array(put("train")))
        .when(F.col("size") == 1, F.array(put("test"), put("val", True)))
        .otherwise(F.array(put(F.when(F.col("first"), "val").otherwise("test"))))
    )
    return rows.select("gloss", "video_id", "signer_group", F.explode(places).alias("p")).select("gloss", "video_id", "signer_group", "p.*")


#: The Kolmogorov-Smirnov statistic is significant at 1 % beyond this over the root of the harmonic size.
KS_BOUND = math.sqrt(-math.log(0.005) / 2)


def verify_splits(assigned: DataFrame) -> DataFrame:
    """One row for each check: leaks, balance, ratios; ``passed`` and a figure.

    If ``assigned`` has ``n_frames``, train is held against test by the Kolmogorov-Smirnov statistic, which passes unless it
    is significant at 1 % (its large-sample bound); splits with fewer than ten clips pass without a figure. The columns
    that the checks need are written once.
    """
    needed = ["split", "gloss", "video_id"] + ["n_frames"] * ("n_frames" in assigned.columns)
    assigned = written(assigned.select(*needed), "assigned")  # five checks read it
    leaks = leaky_overlap(assigned).agg(F.coalesce(F.sum("shared"), F.lit(0)).cast("double").alias("figure"))
    balance = written(class_balance(assigned), "balance").agg(F.count_if(F.col("missing_val") | F.col("missing_test")).cast("double").alias("figure"), F.max("train_cv").alias("cv"))
    ratio = sample_ratio_check(assigned)
    rows = leaks.select(F.lit("no_leak").alias("check"), "figure", (F.col("figure") == 0).alias("passed"))
    rows = rows.unionByName(balance.select(F.lit("classes_present").alias("check"), "figure", (F.col("figure") == 0).alias("passed")))
    rows = rows.unionByName(balance.select(F.lit("balanced").alias("check"), F.col("cv").alias("figure"), (F.col("cv") <= 0.5).alias("passed")))
    rows = rows.unionByName(ratio.select(F.lit("ratio").alias("check"), F.col("train_ratio").alias("figure"), "passed"))
    if "n_frames" in assigned.columns:
        frames = assigned.select(F.col("split").alias("part"), F.col("n_frames").alias("value"))
        bound = KS_BOUND * F.sqrt(1 / F.col("na") + 1 / F.col("nb"))
        ks = ks_two_sample(frames, "train", "test").agg(F.max("statistic").alias("figure"), F.max(bound).alias("bound"))
        rows = rows.unionByName(ks.select(F.lit("frames").alias("check"), "figure", F.coalesce(F.col("figure") <= F.col("bound"), F.lit(True)).alias("passed")))
    return rows


def design_dataset(glosses: DataFrame, recipe: dict[str, int], n: int, seed: str = "42") -> DataFrame:
    """``n`` distinct combinations of classes with so many of each difficulty: ``(combo_no, glosses)``.

    ``glosses(gloss, difficulty)``. Candidate draws order the classes of a difficulty by a hash of draw and class; there
    are four for each combination, and more while too many of them are equal. Fewer than ``n`` possible ones are an error.
    """
    held = {r["difficulty"]: r["c"] for r in glosses.groupBy("difficulty").agg(F.count_distinct("gloss").alias("c")).collect()}
    possible = math.prod(math.comb(held.get(d, 0), k) for d, k in recipe.items())
    if possible < n:
        raise ValueError(f"there are only {possible} such combinations, not {n}")
    want = F.coalesce(*[F.when(F.col("difficulty") == d, k) for d, k in recipe.items()])
    pool = glosses.select("gloss", want.alias("k"), "difficulty").where("k > 0").distinct()

    def combos(draws: int) -> DataFrame:
        each = pool.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
        order = Window.partitionBy("draw", "difficulty").orderBy(shuffled(seed, F.col("draw"), F.col("gloss")), "gloss")
        picked = each.withColumn("r", F.row_number().over(order)).where("r <= k")
        return picked.groupBy("draw").agg(F.array_sort(F.collect_list("gloss")).alias("glosses")).groupBy("glosses").agg(F.min("draw").alias("draw"))

    draws = 4 * n
    while (once := combos(draws)).count() < n:  # too many draws were equal
        draws *= 4
    return once.withColumn("combo_no", F.row_number().over(Window.orderBy("draw"))).where(F.col("combo_no") <= n).select("combo_no", "glosses")
