"""Tolerant readers for the library's inputs; each gives a fixed schema, whatever the shape of the file."""

from __future__ import annotations

import io
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossmill.functions.geometry import even_points

CANDIDATE = "struct<gloss:string,confidence:double>"
PREDICTION = (
    "sample_id string, entry_id long, position int, true_gloss string, is_augmented boolean, n_frames int, "
    f"top_k array<{CANDIDATE}>"
)
MANIFEST = (
    "split string, pickle_pool string, total_samples long, total_families long, num_classes long, "
    "classes map<string,array<struct<video_id:string,frame_bucket:string,files:array<string>>>>"
)
GLOSS_EVENT = f"session_id string, event_id long, ts timestamp, gloss string, confidence double, top_k array<{CANDIDATE}>"


def read_clips(spark: SparkSession, path: str, points: int = 83, dims: int = 3) -> DataFrame:
    """Frames ``(clip_id, frame_idx, kp)`` from Parquet; layouts of 75, 83, 543 and 576 points become one (:func:`even_points`)."""
    frames = spark.read.parquet(path)
    return frames.withColumn("kp", even_points(F.col("kp"), points, dims))


def read_clip_blobs(spark: SparkSession, path: str, points: int = 83, dims: int = 3) -> DataFrame:
    """Frames from ``.npy`` files, one clip each; the clip_id is the file's name. Pickled objects are refused.

    Two-dimensional arrays are one frame, of four-dimensional ones the first person counts. A task reads a file at a time.
    """

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                x = np.load(io.BytesIO(content), allow_pickle=False).astype(float)
                x = x[None] if x.ndim == 2 else x[:, 0] if x.ndim == 4 else x
                x = np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)
                clip = name.rsplit("/", 1)[-1].removesuffix(".npy")
                yield pd.DataFrame({"clip_id": clip, "frame_idx": range(len(x)), "kp": [f.tolist() for f in x]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    frames = files.mapInPandas(run, "clip_id string, frame_idx long, kp array<array<double>>")
    return frames.withColumn("kp", even_points(F.col("kp"), points, dims))


def read_manifest(spark: SparkSession, path: str, flat_pool: bool = True) -> DataFrame:
    """Nested split manifests as rows ``(split, gloss, video_id, frame_bucket, file)``.

    In a flat pool files lie in one folder, else in one for each class (lower case).
    """
    raw = spark.read.schema(MANIFEST).json(path)
    classes = raw.select("split", "pickle_pool", F.explode("classes").alias("gloss", "families"))
    files = classes.select("split", "pickle_pool", "gloss", F.explode("families").alias("f")).select("split", "pickle_pool", "gloss", "f.video_id", "f.frame_bucket", F.explode("f.files").alias("name"))
    parts = ["pickle_pool", "name"] if flat_pool else ["pickle_pool", F.lower("gloss"), "name"]
    return files.select("split", "gloss", "video_id", "frame_bucket", F.concat_ws("/", *parts).alias("file"))


def read_video_mapping(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object of video id -> {gloss} (or -> gloss) as ``(video_id, gloss)``."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("video_id", "v"))
    return pairs.select("video_id", F.coalesce(F.get_json_object("v", "$.gloss"), "v").alias("gloss"))


def read_gloss_instances(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of ``{gloss, instances[{video_id, signer_id}]}`` as one row for each instance."""
    schema = "gloss string, instances array<struct<video_id:string,signer_id:int>>"
    return spark.read.schema(schema).json(path, multiLine=True).select("gloss", F.explode("instances").alias("i")).select("gloss", "i.*")


def read_split_json(spark: SparkSession, path: str, class_list: str) -> DataFrame:
    """Video id -> {subset, action[]} with the class name of the first action: ``(video_id, subset, class_idx, gloss)``."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", "map<string,struct<subset:string,action:array<int>>>")).alias("video_id", "v"))
    rows = rows.select("video_id", "v.subset", F.get("v.action", F.lit(0)).alias("class_idx"))
    classes = spark.read.schema("class_idx int, gloss string").csv(class_list, sep="\t")
    return rows.join(classes, "class_idx", "left").select("video_id", "subset", "class_idx", "gloss")


def read_annotations(spark: SparkSession, path: str, row_tag: str = "ANNOTATION_DOCUMENT") -> DataFrame:
    """Intervals of tier XML: ``(video_id, tier, annotation_id, text, start_ms, end_ms)``.

    Time slots are resolved by two joins; empty texts become ``SIGN``; only positive durations stay, each
    interval of a video once.
    """
    slot = "struct<_TIME_SLOT_ID:string,_TIME_VALUE:long>"
    alignable = "struct<_ANNOTATION_ID:string,_TIME_SLOT_REF1:string,_TIME_SLOT_REF2:string,ANNOTATION_VALUE:string>"
    schema = (
        f"TIME_ORDER struct<TIME_SLOT:array<{slot}>>, "
        f"TIER array<struct<_TIER_ID:string,ANNOTATION:array<struct<ALIGNABLE_ANNOTATION:{alignable}>>>>"
    )
    docs = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path).withColumn("video_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1))
    slots = docs.select("video_id", F.explode("TIME_ORDER.TIME_SLOT").alias("s")).select("video_id", F.col("s._TIME_SLOT_ID").alias("slot"), F.col("s._TIME_VALUE").alias("ms"))
    rows = docs.select("video_id", F.explode("TIER").alias("t")).select("video_id", F.col("t._TIER_ID").alias("tier"), F.explode("t.ANNOTATION.ALIGNABLE_ANNOTATION").alias("a"))
    rows = rows.select("video_id", "tier", F.col("a._ANNOTATION_ID").alias("annotation_id"), F.coalesce(F.nullif(F.trim("a.ANNOTATION_VALUE"), F.lit("")), F.lit("SIGN")).alias("text"), F.col("a._TIME_SLOT_REF1").alias("r1"), F.col("a._TIME_SLOT_REF2").alias("r2"))
    for ref, name in (("r1", "start_ms"), ("r2", "end_ms")):
        rows = rows.join(slots.select("video_id", F.col("slot").alias(ref), F.col("ms").alias(name)), ["video_id", ref]).drop(ref)
    once = Window.partitionBy("video_id", "start_ms", "end_ms").orderBy("tier", "annotation_id")
    return rows.where("end_ms > start_ms").withColumn("k", F.row_number().over(once)).where("k = 1").drop("k")


def read_survey(spark: SparkSession, path: str, first: int = 4, n: int = 53) -> DataFrame:
    """Ratings from a wide CSV, a row for each rater: ``(rater, sentence_id, rating)``; cells that are no number are left out."""
    wide = spark.read.csv(path, header=True)
    names = wide.columns[first : first + n]
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("sentence_id"), F.col(f"`{c}`").alias("cell")) for i, c in enumerate(names)]))
    rows = wide.select(F.col(f"`{wide.columns[0]}`").alias("rater"), cells.alias("x")).select("rater", "x.*")
    return rows.select("rater", "sentence_id", F.col("cell").try_cast("int").alias("rating")).where("rating IS NOT NULL")


def _is_lines(spark: SparkSession, path: str) -> bool:
    """Whether the JSON under ``path`` has one object a line; else it is one array or object over many lines."""
    first = spark.read.text(path).where(F.trim("value") != "").first()
    if first is None:
        return True
    text = first[0].strip()
    return text.startswith("{") and text.endswith("}")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions from JSON: one object a line, or one array in a file. All files under ``path`` have one of the forms."""
    return spark.read.schema(PREDICTION).json(path, multiLine=not _is_lines(spark, path))


_SCORES = [f"{side}_{name}" for side in ("baseline", "model") for name in (
    "bleu", "bertscore", "quality", "plausibility", "composite", "composite_v2", "coverage_recall", "coverage_precision", "coverage_f1", "ptr",
)]
EVAL_ENTRY = (
    "entry_id long, glosses array<string>, reference_sentence string, predicted_sentence string, predicted_response_raw string, "
    f"predicted_glosses array<struct<top_prediction:string,confidence:double,top_k:array<{CANDIDATE}>>>, "
    + ", ".join(f"{x} double" for x in _SCORES)
    + ", gloss_accuracy double, gloss_correct long, gloss_total long, "
    "gloss_mismatches array<struct<position:int,predicted:string,original:string>>, effective_glosses array<string>, "
    "missing_words array<string>, hallucinated_words array<string>, status string"
)


def read_eval_entries(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation entries from JSON: one object a line, one array, or one object whose ``entries`` or ``results`` is the array."""
    listed = f"array<struct<{_fields(EVAL_ENTRY)}>>"
    nested = spark.read.schema(f"entries {listed}, results {listed}, {EVAL_ENTRY}").json(path, multiLine=not _is_lines(spark, path))
    names = [x for x in nested.columns if x not in ("entries", "results")]
    inner = F.coalesce("entries", "results")
    return nested.select(F.explode(F.coalesce(inner, F.array(F.struct(*names)))).alias("e")).select("e.*")


def _fields(schema: str) -> str:
    """A flat column list as the fields of a struct."""
    return re.sub(r"(^|, )(\w+) ", r"\1\2:", schema)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``(class_idx, gloss)`` from any of three shapes: index -> gloss, gloss -> index, or {"classes": [...]}."""
    text = spark.read.text(path, wholetext=True)
    listed = text.select(F.posexplode(F.from_json(F.get_json_object("value", "$.classes"), "array<string>")).alias("class_idx", "gloss"))
    pairs = text.where(F.get_json_object("value", "$.classes").isNull()).select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "v"))
    by_index = F.col("k").try_cast("int").isNotNull()
    mapped = pairs.select(F.when(by_index, F.col("k").try_cast("int")).otherwise(F.col("v").try_cast("int")).alias("class_idx"), F.when(by_index, F.col("v")).otherwise(F.col("k")).alias("gloss"))
    return listed.unionByName(mapped)


def read_gloss_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of gloss events from JSON lines; lines that cannot be read are left out."""
    return spark.readStream.schema(GLOSS_EVENT).option("mode", "DROPMALFORMED").json(path)
