"""Vocabulary, category, signer and coverage bookkeeping on metadata tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def class_frequencies(clips: DataFrame) -> DataFrame:
    """Videos of each class."""
    return clips.groupBy("gloss").agg(F.count_distinct("video_id").alias("videos"))


def min_length(clips: DataFrame, n: int = 5) -> DataFrame:
    """Clips of at least ``n`` frames."""
    return clips.where(F.col("n_frames") >= n)


def label_clips(clips: DataFrame, mapping: DataFrame) -> DataFrame:
    """Clips with the class of their video; clips without one are left out."""
    return clips.join(mapping, "video_id")


def filter_glosses(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose class is in ``wanted(gloss)``, whatever the case of either."""
    names = wanted.select(F.lower("gloss").alias("_g")).distinct()
    return df.join(names, F.lower("gloss") == F.col("_g"), "left_semi")


def attach_category(df: DataFrame, categories: DataFrame) -> DataFrame:
    """Category of each row's class, ``Other`` for classes without one."""
    return df.join(categories, "gloss", "left").withColumn("category", F.coalesce("category", F.lit("Other")))


def category_stats(df: DataFrame) -> DataFrame:
    """Classes of each category, and of all (null)."""
    return df.rollup("category").agg(F.count_distinct("gloss").alias("glosses"))


def missing_coverage(a: DataFrame, b: DataFrame) -> DataFrame:
    """Classes in only one of two tables: ``missing`` from the second, ``extra`` in it."""
    one, two = a.select("gloss").distinct(), b.select("gloss").distinct()
    missing = one.join(two, "gloss", "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(two.join(one, "gloss", "left_anti").withColumn("side", F.lit("extra")))


def exclude(df: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose class is not in ``gone(gloss)``."""
    return df.join(gone.select("gloss").distinct(), "gloss", "left_anti")


def incremental_classes(frequencies: DataFrame, base: DataFrame, n: int) -> DataFrame:
    """The classes of ``base(gloss, class_idx)`` in their order, then the commonest others up to ``n`` in all."""
    others = frequencies.join(base, "gloss", "left_anti").select("gloss", F.lit(1).alias("part"), (-F.col("videos")).alias("key"))
    rows = base.select("gloss", F.lit(0).alias("part"), F.col("class_idx").cast("long").alias("key")).unionByName(others)
    rank = F.row_number().over(Window.orderBy("part", "key", "gloss"))
    return rows.withColumn("class_idx", rank - 1).where(F.col("class_idx") < n).select("class_idx", "gloss")


def class_mapping(glosses: DataFrame) -> DataFrame:
    """Dense index of the sorted classes."""
    return glosses.select("gloss").distinct().withColumn("class_idx", F.row_number().over(Window.orderBy("gloss")) - 1)


def signer_coverage(instances: DataFrame) -> DataFrame:
    """Classes that each signer has, and the rank of signers by that."""
    out = instances.groupBy("signer_id").agg(F.count_distinct("gloss").alias("glosses"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("glosses"), "signer_id")))


def signer_missing(instances: DataFrame, signer: int) -> DataFrame:
    """Classes that a signer lacks with the smallest signer id that has them, and how many others do."""
    own = instances.where(F.col("signer_id") == signer).select("gloss").distinct()
    rest = instances.join(own, "gloss", "left_anti").groupBy("gloss")
    return rest.agg(F.min("signer_id").alias("alternative"), (F.count_distinct("signer_id") - 1).alias("others"))


def dedupe_scan(clips: DataFrame) -> DataFrame:
    """Originals only, one row for each class and video: that with the smallest clip_id."""
    return clips.where(~F.col("is_augmented")).groupBy("gloss", "video_id").agg(F.min("clip_id").alias("clip_id"))


def pool_index(files: DataFrame, size: int = 1000) -> DataFrame:
    """Sorted files of each class, in parts of at most ``size``: ``(gloss, part, files)``."""
    part = F.floor((F.row_number().over(Window.partitionBy("gloss").orderBy("file")) - 1) / size)
    return files.withColumn("part", part).groupBy("gloss", "part").agg(F.array_sort(F.collect_list("file")).alias("files"))


def domain_overlap(domains: DataFrame) -> DataFrame:
    """From ``domains(domain, gloss)``: classes of each domain that others share, and those of its own."""
    each = domains.distinct()
    held = each.groupBy("gloss").agg(F.count("*").alias("n"))
    out = each.join(held, "gloss").groupBy("domain")
    return out.agg(F.count_if(F.col("n") > 1).alias("shared"), F.count_if(F.col("n") == 1).alias("unique_glosses"))


def pick_sample(wanted: DataFrame, clips: DataFrame, seed: str | None = None) -> DataFrame:
    """One clip for each of ``wanted(pos, gloss)``: the first by id, or drawn by a seed; null where there is none."""
    key: Column = F.col("clip_id") if seed is None else F.md5(F.concat_ws("|", F.lit(seed), "clip_id"))
    once = clips.groupBy("gloss").agg(F.min_by("clip_id", F.struct(key, F.col("clip_id"))).alias("clip_id"))
    return wanted.join(once, "gloss", "left")


def search_filter(candidates: DataFrame, shortest: float, longest: float, preferred: list[str]) -> DataFrame:
    """Candidate videos once each, of an allowed duration, ranked for each word: preferred channels, then views."""
    once = candidates.groupBy("word", "video").agg(F.max_by(F.struct("duration", "channel", "views"), F.struct("views", "channel", "duration")).alias("v"))
    kept = once.select("word", "video", "v.*").where(F.col("duration").between(shortest, longest))
    order = Window.partitionBy("word").orderBy(F.col("channel").isin(preferred).cast("int").desc(), F.desc("views"), "video")
    return kept.withColumn("rank", F.row_number().over(order))
