"""A stream's walk gives runs of rows with their values once, and each row gets its own values from them."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glossmill.streaming import captions as C
from glossmill.streaming import context as X

START = datetime.datetime(2024, 5, 1, tzinfo=datetime.timezone.utc)
ROW = "session_id string, event_id long, ts timestamp, gloss string, confidence double"


class State:
    """A group's state as a walk sees it."""

    exists, hasTimedOut, get = False, False, None

    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkMs(self):
        return self.watermark

    def update(self, value):
        self.exists, self.get = True, value

    def remove(self):
        self.exists, self.get = False, None

    def setTimeoutTimestamp(self, due):
        self.due = due


def bucket(rows):
    """Rows of three sessions, one a second."""
    k = np.arange(rows)
    return pd.DataFrame({"session_id": [f"s{i % 3}" for i in k], "event_id": k, "t": (k + 1) * 1_000_000, "value": k / 2, "mark": False})


@pytest.mark.parametrize(("n", "most"), [(3, 1.2), (20, 2)])
def test_values_come_once(n, most):
    """What leaves the walk is about one row for ``RUN`` events; a list of its own for each event was ``n`` times the values."""
    given = pd.concat(X._tails(n, 1800.0)((0,), iter([bucket(3000)]), State(10_000_000)))
    assert len(given) < 3000 / 20
    assert sum(map(len, given["event_id"])) == 3000
    assert sum(map(len, given["values"])) < most * 3000


def test_waiting_rows_are_not_ordered(monkeypatch):
    """Before the watermark is there, rows are only kept; the timer brings the first of them."""
    monkeypatch.setattr(X.B, "in_order", None)
    state = State(0)
    assert list(X._tails(3, 1800.0)((0,), iter([bucket(50), bucket(20)]), state)) == []
    assert len(X.B.unpack_rows(state.get[0])[0]) == 70 and state.due == 1000


@pytest.mark.parametrize("n", [1, 3, 50, None])
def test_runs_of_long_sessions(spark, tmp_path, n):
    """Sessions of some hundred rows, longer than a run, with silences in and between the files, and equal times."""
    rng = random.Random(7)
    rows = [("abb"[rng.randrange(3)], k, 5 * (k // 2) + (3000 if k > 700 else 0), rng.choice(["GO", "WHERE", "EAT"]), k / 1000) for k in range(1000)]
    rows = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 40))
    rows = [(s, k, START + datetime.timedelta(seconds=t), *rest) for s, k, t, *rest in rows]
    for b in range(3):
        spark.createDataFrame(rows[b * 334 : (b + 1) * 334], ROW).coalesce(1).write.parquet(f"{tmp_path}/in/b={b}")
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    settings = {"smart": True, "words": ("where",), "session_end": 600.0}
    out = X.last_glosses(stream, n, watermark="60 seconds", buckets=2, **settings)
    with X.rocksdb(spark):
        C.run_available(out, f"{tmp_path}/out")
    until = max(r[2] for r in rows) - datetime.timedelta(seconds=60)
    want = X.last_glosses(spark.createDataFrame(rows, ROW), n, until=until, **settings)
    got = spark.read.schema(out.schema).parquet(f"{tmp_path}/out")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert got.count() > 900 and got.agg(F.max(F.size("glosses"))).first()[0] >= (n or 2 * X.RUN)


def test_odd_latencies(spark, tmp_path):
    """Latencies that are no number or infinite, and sums whose order shows, come out as from a table; null ones do not."""
    schema = "session_id string, event_id long, ts timestamp, latency double"
    odd = [1e308, 1e308, -1e308, 0.1, 0.2, 0.3, 1e16, 1.0, -0.0, float("inf"), 2.0, float("-inf"), 3.0, float("nan"), None, 4.0, 5.0, 6.0, 7.0]
    rows = [("a", k, START + datetime.timedelta(seconds=k), v) for k, v in enumerate(odd)]
    rows += [("b", 50, START, float("nan")), ("c", 51, START, None), ("d", 52, START, -0.0), ("z", 99, START + datetime.timedelta(seconds=9000), 1.0)]
    table = spark.createDataFrame(rows, schema)
    table.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = X.latency_means(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 3, watermark="60 seconds", buckets=2)
    with X.rocksdb(spark):
        C.run_available(out, f"{tmp_path}/out")
    want = X.latency_means(table, 3, until=START + datetime.timedelta(seconds=9000 - 60)).collect()
    got = spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == len(odd) - 1 + 2
