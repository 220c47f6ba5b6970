"""Sinks: manifests, indexes and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest(assigned: DataFrame, pool: str) -> DataFrame:
    """A row for each family, with the totals of its split, from ``(split, gloss, video_id, frame_bucket, file)``.

    ``classes`` holds the family's class with its files, so no row grows with the corpus; readers join the rows.
    """
    fams = assigned.groupBy("split", "gloss", "video_id", "frame_bucket").agg(F.array_sort(F.collect_list("file")).alias("files"))
    classes = fams.groupBy("split", "gloss").agg(F.count("*").alias("n_families"), F.sum(F.size("files")).alias("n_files"))
    totals = classes.groupBy("split").agg(F.sum("n_files").alias("total_samples"), F.sum("n_families").alias("total_families"), F.count("*").alias("num_classes"))
    family = F.struct(F.col("video_id").cast("string").alias("video_id"), "frame_bucket", "files")
    out = fams.select("split", F.lit(pool).alias("pickle_pool"), F.create_map("gloss", F.array(family)).alias("classes"))
    return out.join(totals, "split").select("split", "pickle_pool", "total_samples", "total_families", "num_classes", "classes")


def write_manifest(assigned: DataFrame, path: str, pool: str) -> None:
    """Manifest rows as JSON lines in any number of files."""
    manifest(assigned, pool).write.json(path)


def write_assignment(assigned: DataFrame, path: str) -> None:
    assigned.write.partitionBy("split").parquet(path)


def write_report(report: DataFrame, path: str, kind: str = "json") -> None:
    report.write.format(kind).save(path)


def write_bucketed(rows: DataFrame, table: str, path: str, buckets: int, by: str = "clip_id") -> DataFrame:
    """``rows`` as a table of ``buckets`` sorted buckets of ``by`` under ``path``; returns the table.

    Tables with equal numbers of buckets are joined and grouped on ``by`` where they lie: keypoints are not moved again.
    Rows are brought to their bucket first, so a bucket is one file.
    """
    spread = rows.repartition(buckets, by).sortWithinPartitions(by)
    spread.write.mode("overwrite").bucketBy(buckets, by).sortBy(by).option("path", path).format("parquet").saveAsTable(table)
    return rows.sparkSession.table(table)
