"""Streams of what came before in a session: equal to the tables' rows, in any order of arrival, late rows dropped."""

import datetime

import pytest
from pyspark.sql import functions as F

from glossmill.streaming import captions as C
from glossmill.streaming import context as X

ROW = "session_id string, event_id long, ts timestamp, gloss string, top_k array<struct<gloss:string,confidence:double>>"


def at(seconds):
    return datetime.datetime(2024, 5, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(seconds=seconds)


def event(session, i, seconds, gloss, *candidates):
    return (session, i, at(seconds), gloss, [(c, 0.5) for c in candidates])


def stream_of(spark, path, *batches, schema=ROW):
    """A stream that reads each list of rows as a micro-batch of its own."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/in/b={k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")


def collected(spark, stream, path):
    with X.rocksdb(spark):
        C.run_available(stream, f"{path}/out")
    return sorted(map(repr, spark.read.schema(stream.schema).parquet(f"{path}/out").collect()))


def test_batches_out_of_order(spark, tmp_path):
    """Rows that come before the watermark in any order give the table's rows; a later one is dropped."""
    first = [event("a", 2, 20, "B"), event("a", 1, 10, "A"), event("b", 3, 15, "X")]
    second = [event("a", 4, 18, "C", "u", "v", "WHO"), event("a", 5, 90, "D"), event("b", 6, 80, "Y", "u", "v", "w", "who")]
    third = [event("a", 8, 5000, "E"), event("b", 9, 5000, "Z")]
    last = [event("a", 7, 12, "late"), event("c", 10, 9000, "end")]
    settings = {"session_end": 1800.0}
    stream = X.last_glosses(stream_of(spark, tmp_path, first, second, third, last), 3, smart=True, watermark="30 seconds", **settings)
    rows = [r for r in first + second + third + last if r[3] != "late"]
    want = X.last_glosses(spark.createDataFrame(rows, ROW), 3, smart=True, until=at(9000 - 30), **settings)
    got = collected(spark, stream, tmp_path)
    assert got == sorted(map(repr, want.collect()))
    glosses = {r.event_id: (r.glosses, r.rebuild) for r in want.collect()}
    assert glosses == {
        1: (["A"], False), 4: (["A", "C"], True), 2: (["B"], False), 5: (["D"], False), 8: (["E"], False),
        3: (["X"], False), 6: (["Y"], False), 9: (["Z"], False),
    }


def test_sessions_end(spark):
    rows = [("a", 1, at(0), "one"), ("a", 2, at(10), "two"), ("a", 3, at(20), "three"), ("a", 4, at(4000), "four"), ("a", 5, at(4000), "five")]
    captions = spark.createDataFrame(rows, "session_id string, event_id long, ts timestamp, sentence string")
    got = {r.event_id: r.context for r in X.sentence_context(captions, 1).collect()}
    assert got == {1: [], 2: ["one"], 3: ["two"], 4: [], 5: ["four"]}
    whole = {r.event_id: r.context for r in X.sentence_context(captions, None).collect()}
    assert whole == {1: [], 2: ["one"], 3: ["one", "two"], 4: [], 5: ["four"]}


def test_state_outlives_batches(spark, tmp_path):
    """Means over rows of many micro-batches, with more rows than the tail holds, and a session that ends in between."""
    schema = "session_id string, event_id long, ts timestamp, latency double"
    batches = [[("a", 10 * k + j, at(100 * k + 7 * j + (10_000 if k > 3 else 0)), float(k * j)) for j in range(6)] for k in range(6)]
    batches.append([("z", 999, at(50_000), 1.0)])
    stream = X.latency_means(stream_of(spark, tmp_path, *batches, schema=schema), 20, watermark="50 seconds")
    want = X.latency_means(spark.createDataFrame(sum(batches, []), schema), 20, until=at(50_000 - 50))
    assert collected(spark, stream, tmp_path) == sorted(map(repr, want.collect()))
    assert want.count() == 36


def test_odd_rows(spark):
    rows = [event("a", 1, 1, None), (None, 2, at(2), "B", None), ("a", 3, None, "C", None), ("a", 4, at(4), "D", None), ("a", 5, at(4), "D", None)]
    out = X.last_glosses(spark.createDataFrame(rows, ROW), 6, smart=True).collect()
    assert sorted((r.event_id, r.glosses, r.rebuild) for r in out) == [(4, ["D"], False), (5, ["D"], False)]
    assert X.last_glosses(spark.createDataFrame([], ROW)).collect() == []


def test_clarifying(spark):
    rows = [event("a", 1, 1, "Who"), event("a", 2, 2, "x", "a", "b", "NOT"), event("a", 3, 3, "x", "a", "b", "c", "not"), event("a", 4, 4, "x")]
    out = spark.createDataFrame(rows, ROW).select("event_id", X.clarifies(F.col("gloss"), F.col("top_k")).alias("c"))
    assert {r.event_id: r.c for r in out.collect()} == {1: True, 2: True, 3: False, 4: False}


@pytest.mark.parametrize("streamed", [False, True])
def test_settled(spark, tmp_path, streamed):
    g = "session_id string, gloss_id long, ts timestamp, gloss string"
    c = "session_id string, since timestamp, ts timestamp, selections array<string>"
    glosses = [("a", 1, at(1), "Home"), ("a", 2, at(2), "GO"), ("a", 3, at(30), "go"), ("a", 4, at(40), "late"), ("b", 5, at(1), "home"), ("z", 6, at(900), "end")]
    calls = [("a", None, at(10), ["home", None]), ("a", at(10), at(35), ["Go"]), ("a", at(35), at(200), ["late"]), ("z", at(800), at(800), [])]
    if streamed:
        path = str(tmp_path / "g")
        x = stream_of(spark, path, glosses, schema=g)
        y = stream_of(spark, str(tmp_path / "c"), calls, schema=c)
        C.run_available(X.settled_glosses(x, y), f"{path}/out")
        out = spark.read.parquet(f"{path}/out")
    else:
        out = X.settled_glosses(spark.createDataFrame(glosses, g), spark.createDataFrame(calls, c), until=at(790))
    got = {r.gloss_id: (r.settled, bool(r.used)) for r in out.collect()}
    assert got == {1: (True, True), 2: (True, False), 3: (True, True), 4: (False, False), 5: (False, False)}
