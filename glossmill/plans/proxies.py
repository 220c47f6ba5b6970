"""The library's inputs, derived from the driver's tables, and the SQL that derives the same rows.

Each has a function giving a DataFrame and a constant ``*_SQL`` with common table expressions to put after ``WITH``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Predictions: a line item is a clip; its class is the part's number, its signer the supplier's.
_P1 = "CASE WHEN l_suppkey % 4 = 0 THEN (l_partkey + {div}) % 20 ELSE l_partkey % 20 END"
_COMMON = """
    l_orderkey AS video_id, l_linenumber AS aug_id, l_suppkey AS signer_id, l_linenumber > 1 AS is_augmented,
    CAST(l_quantity * 3 AS INT) AS n_frames, l_partkey % 20 AS t,
    round(1 - l_discount * 5, 4) AS c1, round(l_discount * 3, 4) AS c2, round(l_discount, 4) AS c3
"""
_TOPS = """
    SELECT video_id, aug_id, signer_id, is_augmented, n_frames, c1, c2, c3,
           concat('G', lpad(CAST(t AS VARCHAR(9)), 2, '0')) AS true_gloss,
           concat('G', lpad(CAST(a AS VARCHAR(9)), 2, '0')) AS g1,
           concat('G', lpad(CAST(CASE WHEN a <> t AND aug_id % 2 = 0 THEN t ELSE (a + 1) % 20 END AS VARCHAR(9)), 2, '0')) AS g2,
           concat('G', lpad(CAST((a + 7) % 20 AS VARCHAR(9)), 2, '0')) AS g3
"""
PREDICTIONS_SQL = f"tops AS (SELECT {_COMMON}, {_P1.format(div='l_suppkey // 4')} AS a FROM lineitem), predictions AS ({_TOPS} FROM tops)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(video_id, aug_id, signer_id, is_augmented, n_frames, true_gloss, top_k)``, candidates best first."""
    tops = spark.sql(
        f"{_TOPS} FROM (SELECT {_COMMON}, {_P1.format(div='l_suppkey div 4')} AS a FROM {{lineitem}})",
        lineitem=table(spark, sf_dir, "lineitem"),
    )
    pairs = [F.struct(F.col(f"g{k}").alias("gloss"), F.col(f"c{k}").alias("confidence")) for k in (1, 2, 3)]
    return tops.withColumn("top_k", F.array(*pairs)).drop("g1", "g2", "g3", "c1", "c2", "c3")


# Clips: families are orders, classes are brands.
CLIPS_SQL = """
clips AS (
  SELECT concat(l_orderkey, '_', l_linenumber, '_', l_partkey, '_', l_suppkey) AS clip_id, p_brand AS gloss, l_orderkey AS video_id,
         l_linenumber AS aug_id, l_linenumber > 1 AS is_augmented, l_suppkey % 10 AS signer_id, CAST(l_quantity * 3 AS INT) AS n_frames
  FROM lineitem JOIN part ON l_partkey = p_partkey
)
"""


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(clip_id, gloss, video_id, aug_id, is_augmented, signer_id, n_frames)``."""
    return spark.sql(
        """
        SELECT concat(l_orderkey, '_', l_linenumber, '_', l_partkey, '_', l_suppkey) AS clip_id, p_brand AS gloss, l_orderkey AS video_id,
               l_linenumber AS aug_id, l_linenumber > 1 AS is_augmented, l_suppkey % 10 AS signer_id, CAST(l_quantity * 3 AS INT) AS n_frames
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
        """,
        lineitem=table(spark, sf_dir, "lineitem"),
        part=table(spark, sf_dir, "part"),
    )


# Evaluation entries: a user turn is the reference, the assistant's next turn the translation.
ENTRIES_SQL = """
entries AS (
  SELECT u.conv_id * 1000 + u.turn AS entry_id, u.text AS reference, a.text AS output, (u.conv_id * 7 + u.turn) % 101 AS plausibility,
         [x for x in regexp_split_to_array(trim(lower(u.text)), '\\s+') if x <> ''] AS glosses,
         [x for x in regexp_split_to_array(trim(lower(a.text)), '\\s+') if x <> ''] AS predicted
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'
)
"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(entry_id, reference, output, plausibility, glosses, predicted)``."""
    from glossmill.functions.text import words

    turns = table(spark, sf_dir, "conversations")
    user = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("reference"))
    answer = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return user.join(answer, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("entry_id"),
        "reference",
        "output",
        ((F.col("conv_id") * 7 + F.col("turn")) % 101).alias("plausibility"),
        words(F.lower("reference")).alias("glosses"),
        words(F.lower("output")).alias("predicted"),
    )


# Motion: the events of a user are the frames of a clip, their values the motion scores.
MOTION_SQL = """
motion AS (
  SELECT user_id AS clip_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, value AS v FROM events
)
"""


def motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(clip_id, frame_idx, v)``."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("clip_id").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "clip_id")
    return events.select("clip_id", (F.row_number().over(order) - 1).alias("frame_idx"), F.col("value").alias("v"))


# Intervals: an event is an annotation that begins at its time and lasts for its value in hundreds of seconds.
INTERVALS_SQL = """
annotations AS (
  SELECT user_id AS video_id, event_id AS annotation_id, event_type AS text,
         epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + CAST(floor(value * 100000) AS BIGINT) AS end_ms
  FROM events
)
"""


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(video_id, annotation_id, text, start_ms, end_ms)``."""
    start = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("video_id"),
        F.col("event_id").alias("annotation_id"),
        F.col("event_type").alias("text"),
        start.alias("start_ms"),
        (start + F.floor(F.col("value") * 100000)).alias("end_ms"),
    )


# Frames: an embedding is a frame of 21 points in three dimensions; 16 in a row are a clip, its class the first's label.
FRAMES_SQL = """
frames AS (
  SELECT vec_id // 16 AS clip_id, vec_id % 16 AS frame_idx, label,
         [[CAST(embedding[3 * i + 1] AS DOUBLE), CAST(embedding[3 * i + 2] AS DOUBLE), CAST(embedding[3 * i + 3] AS DOUBLE)] for i in range(21)] AS kp
  FROM embeddings
)
"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(clip_id, frame_idx, label, kp)``, ``kp`` a list of points."""
    kp = "transform(sequence(0, 20), i -> transform(slice(embedding, 3 * i + 1, 3), x -> CAST(x AS DOUBLE)))"
    return table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 16").alias("clip_id"), (F.col("vec_id") % 16).alias("frame_idx"), "label", F.expr(kp).alias("kp")
    )


# Two scores of the same sentences: what an item costs with its discount and without, by order.
SCORES_SQL = """
scores AS (
  SELECT l_orderkey AS entry_id, l_returnflag AS metric, sum(l_extendedprice * (1 - l_discount)) AS baseline,
         sum(l_extendedprice * (1 - l_tax * 0.9)) AS model
  FROM lineitem GROUP BY l_orderkey, l_returnflag
)
"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(entry_id, metric, baseline, model)``."""
    items = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice")
    return items.groupBy(F.col("l_orderkey").alias("entry_id"), F.col("l_returnflag").alias("metric")).agg(
        F.sum(price * (1 - F.col("l_discount"))).alias("baseline"), F.sum(price * (1 - F.col("l_tax") * 0.9)).alias("model")
    )


# Ratings: a user rates the sentence of an event.
RATINGS_SQL = """
ratings AS (
  SELECT user_id % 5 AS rater, event_id % 53 AS sentence_id, 1 + CAST(floor(value) AS INT) % 5 AS rating FROM events
)
"""


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(rater, sentence_id, rating)``."""
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).alias("rater"),
        (F.col("event_id") % 53).alias("sentence_id"),
        (1 + F.floor("value").cast("int") % 5).alias("rating"),
    )
