"""Queries for readers of nested files: the tables are written in the files' form, in blocks of bounded size, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossmill.plans import proxies as P
from glossmill.plans.registry import query
from glossmill.sources import readers
from glossmill.sources.scratch import scratch_path


def _files(rows, name):
    """Each of the one-column ``rows`` as a text file of its own."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.option("maxRecordsPerFile", 1).text(path)
    return path


def _object(key, value):
    """JSON text of one object over the rows of a group."""
    return F.to_json(F.map_from_entries(F.collect_list(F.struct(key.cast("string").alias("k"), value.alias("v"))))).alias("value")


@query("video_mapping_round_trip", "SELECT CAST(p_partkey AS VARCHAR) AS video_id, p_brand AS gloss FROM part")
def video_mapping_round_trip(spark, sf_dir):
    """Objects of two forms: the gloss itself, or an object that holds it."""
    part = P.table(spark, sf_dir, "part").withColumn("block", F.expr("p_partkey div 500"))
    plain = part.where("block % 2 = 0").groupBy("block").agg(_object(F.col("p_partkey"), F.col("p_brand")))
    deep = part.where("block % 2 = 1").groupBy("block").agg(_object(F.col("p_partkey"), F.struct(F.col("p_brand").alias("gloss"))))
    return readers.read_video_mapping(spark, _files(plain.unionByName(deep).select("value"), "mapping"))


@query("gloss_instances_round_trip", "SELECT c_mktsegment AS gloss, CAST(c_custkey AS VARCHAR) AS video_id, CAST(c_nationkey AS INT) AS signer_id FROM customer")
def gloss_instances_round_trip(spark, sf_dir):
    one = F.struct(F.col("c_custkey").cast("string").alias("video_id"), F.col("c_nationkey").cast("int").alias("signer_id"))
    customers = P.table(spark, sf_dir, "customer").groupBy(F.expr("c_custkey div 1000").alias("block"), F.col("c_mktsegment").alias("gloss"))
    lists = customers.agg(F.collect_list(one).alias("instances")).groupBy("block").agg(F.to_json(F.collect_list(F.struct("gloss", "instances"))).alias("value"))
    return readers.read_gloss_instances(spark, _files(lists.select("value"), "instances"))


@query(
    "split_json_round_trip",
    """SELECT CAST(o_orderkey AS VARCHAR) AS video_id, ['train', 'val', 'test'][CAST(o_orderkey % 3 + 1 AS INT)] AS subset, CASE WHEN o_orderkey % 11 > 0 THEN CAST(o_custkey % 40 AS INT) END AS class_idx, n_name AS gloss
FROM orders LEFT JOIN nation ON o_orderkey % 11 > 0 AND n_nationkey = o_custkey % 40""",
)
def split_json_round_trip(spark, sf_dir):
    """Videos with a subset and actions, of which some have none and some no class name."""
    classes = scratch_path(spark, "classes")
    P.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int"), "n_name").write.csv(classes, sep="\t")
    subset = F.element_at(F.array(*map(F.lit, ("train", "val", "test"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    action = F.when(F.col("o_orderkey") % 11 > 0, F.array((F.col("o_custkey") % 40).cast("int"), F.lit(5))).otherwise(F.array().cast("array<int>"))
    videos = P.table(spark, sf_dir, "orders").groupBy(F.expr("o_orderkey div 1000").alias("block"))
    objects = videos.agg(_object(F.col("o_orderkey"), F.struct(subset.alias("subset"), action.alias("action"))))
    return readers.read_split_json(spark, _files(objects.select("value"), "split"), classes)


@query(
    "annotations_round_trip",
    """WITH a AS (SELECT event_id // 200 AS block, 'T' || CAST(event_id % 2 AS VARCHAR) AS tier, 'a' || CAST(event_id AS VARCHAR) AS annotation_id,
  CASE WHEN value > 50 THEN event_type ELSE 'SIGN' END AS text, event_id % 50 * 1000 AS start_ms, event_id % 50 * 1000 + CAST(floor(value / 100) AS BIGINT) * 500 AS end_ms FROM events)
SELECT tier, annotation_id, text, start_ms, end_ms FROM a WHERE end_ms > start_ms QUALIFY row_number() OVER (PARTITION BY block, start_ms, end_ms ORDER BY tier, annotation_id) = 1""",
)
def annotations_round_trip(spark, sf_dir):
    """Documents of tiers with up to 200 annotations; some have no text, no duration or the interval of another."""
    text = F.when(F.col("value") > 50, F.col("event_type")).otherwise(F.lit(" "))
    start = F.col("event_id") % 50 * 1000
    slots = F.format_string('<TIME_SLOT TIME_SLOT_ID="b%d" TIME_VALUE="%d"/><TIME_SLOT TIME_SLOT_ID="e%d" TIME_VALUE="%d"/>', "event_id", start, "event_id", start + F.floor(F.col("value") / 100) * 500)
    body = '<ANNOTATION><ALIGNABLE_ANNOTATION ANNOTATION_ID="a%d" TIME_SLOT_REF1="b%d" TIME_SLOT_REF2="e%d"><ANNOTATION_VALUE>%s</ANNOTATION_VALUE></ALIGNABLE_ANNOTATION></ANNOTATION>'
    rows = P.table(spark, sf_dir, "events").select(F.expr("event_id div 200").alias("block"), (F.col("event_id") % 2).alias("tier"), slots.alias("slots"), F.format_string(body, "event_id", "event_id", "event_id", text).alias("body"))
    tiers = rows.groupBy("block", "tier").agg(F.array_join(F.collect_list("slots"), "").alias("slots"), F.array_join(F.collect_list("body"), "").alias("body"))
    named = tiers.select("block", "slots", F.format_string('<TIER TIER_ID="T%d">%s</TIER>', "tier", "body").alias("body"))
    joined = named.groupBy("block").agg(F.array_join(F.collect_list("slots"), "").alias("slots"), F.array_join(F.collect_list("body"), "").alias("body"))
    docs = joined.select(F.format_string("<ANNOTATION_DOCUMENT><TIME_ORDER>%s</TIME_ORDER>%s</ANNOTATION_DOCUMENT>", "slots", "body").alias("value"))
    return readers.read_annotations(spark, _files(docs, "tiers")).drop("video_id")
