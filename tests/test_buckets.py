"""Streams keep the state of many sessions in one row of a bucket, and give the rows of the table."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from glossmill.streaming import captions as C
from glossmill.streaming import context as X

START = datetime.datetime(2024, 5, 1, tzinfo=datetime.timezone.utc)
ROW = "session_id string, event_id long, ts timestamp, gloss string, confidence double"


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def sessions(files):
    """Rows of 90 sessions over files; words come now and then after long silences."""
    rng = random.Random(3)
    rows = [(f"s{rng.randrange(90)}", k, at(2 * k + (9000 if k > 1500 else 0)), rng.choice(["GO", "WHERE", "DONE", "EAT"]), k / 2400) for k in range(2400)]
    late = sorted(rows, key=lambda r: (r[2] - START).total_seconds() + rng.uniform(0, 50))
    return [late[k : k + 2400 // files] for k in range(0, 2400, 2400 // files)], at(2 * 2399 + 9000 - 60)


def walked(spark, stream, path):
    """What the stream gives, and the most rows of state that any batch wrote or kept."""
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/state").format("parquet").option("path", f"{path}/out").start()
    query.awaitTermination()
    states = [s for p in query.recentProgress for s in p["stateOperators"]]
    rows = spark.read.schema(stream.schema).parquet(f"{path}/out").collect()
    return sorted(map(repr, rows)), max(max(s["numRowsTotal"], s["numRowsUpdated"]) for s in states)


@pytest.mark.parametrize("name", ["trigger_captions", "count_batches", "last_glosses", "sentence_context", "whole_context", "latency_means"])
def test_state_is_by_bucket(spark, tmp_path, name):
    files, until = sessions(4)
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, ROW).coalesce(1).write.parquet(f"{tmp_path}/in/b={k}")
    table = spark.read.schema(ROW).parquet(f"{tmp_path}/in/*")
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    stream_only = {"watermark": "60 seconds"}
    run = {
        "trigger_captions": lambda df, **s: (C.trigger_caption_stream if df.isStreaming else C.trigger_captions)(df, pause=40.0, timeout=90.0, **s),
        "count_batches": lambda df, **s: (C.count_batch_stream if df.isStreaming else C.count_batches)(df, n=3, gap=50.0, session_end=400.0, **s),
        "last_glosses": lambda df, **s: X.last_glosses(df, 4, smart=True, words=("where",), session_end=400.0, **s),
        "sentence_context": lambda df, **s: X.sentence_context(df.withColumnRenamed("gloss", "sentence"), 2, session_end=400.0, **s),
        "whole_context": lambda df, **s: X.sentence_context(df.withColumnRenamed("gloss", "sentence"), None, session_end=400.0, **s),
        "latency_means": lambda df, **s: X.latency_means(df.withColumn("latency", F.col("confidence")), 5, session_end=400.0, **s),
    }[name]
    want = sorted(map(repr, run(table, until=until).collect()))
    with X.rocksdb(spark):
        got, kept = walked(spark, run(stream, buckets=7, **stream_only), tmp_path)
    assert got == want and len(want) > 100
    assert kept <= 7


def test_word_at_the_watermark_counts(spark, tmp_path):
    """Nothing but the timer brings the end word of session a, which is as old as the watermark."""
    spark.createDataFrame([("a", 1, at(940), "DONE", 0.5), ("b", 2, at(1000), "GO", 0.5)], ROW).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = C.trigger_caption_stream(spark.readStream.schema(ROW).parquet(f"{tmp_path}/in"), "60 seconds")
    C.run_available(stream, f"{tmp_path}/out")
    want = C.trigger_captions(spark.read.parquet(f"{tmp_path}/in"), at(940)).collect()
    assert spark.read.schema(C.CAPTION).parquet(f"{tmp_path}/out").collect() == want and len(want) == 1
