"""State of many sessions at a time: sessions are dealt to buckets, and a bucket's rows lie packed in its state.

A call for each session costs more than its few rows. A bucket is a fixed share of the sessions by the hash of their
name, so a call sorts and walks the rows of many, and the state is one value of packed columns. The number of buckets
bounds what a call holds and stays the same for the life of a checkpoint. A task has one core, so packing starts no threads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
ROWS = 10_000  # rows of a frame that a call gives


def bucketed(rows: DataFrame, buckets: int, session: Column | str = "session_id"):
    return rows.withColumn("bucket", F.pmod(F.xxhash64(session), F.lit(buckets))).groupBy("bucket")


def pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4", use_threads=False)) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(packed), options=pa.ipc.IpcReadOptions(use_threads=False)).read_all()


def pack_rows(rows: pd.DataFrame) -> bytes | None:
    return pack(pa.Table.from_pandas(rows, preserve_index=False, nthreads=1)) if len(rows) else None


def unpack_rows(packed: bytes | None) -> list[pd.DataFrame]:
    return [] if packed is None else [unpack(packed).to_pandas(use_threads=False)]


def in_order(frames: list[pd.DataFrame]) -> tuple[pd.DataFrame, np.ndarray]:
    """All rows session by session, in order of time and id, and a number for each row's session."""
    rows = pd.concat(frames, ignore_index=True)
    session = pd.factorize(rows["session_id"], use_na_sentinel=False)[0]
    order = np.lexsort((rows["event_id"], rows["t"], session))
    return rows.iloc[order].reset_index(drop=True), session[order]


def parts(rows: list, size: int = ROWS) -> Iterator[list]:
    for k in range(0, len(rows), size):
        yield rows[k : k + size]
