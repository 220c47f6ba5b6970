"""Helpers shared by the text operators: the shared scratch folder, cut lineage, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of the words ``[^\x20\x09-\x0D]+``; ``bytes.split()`` uses the same set.
WORD = r"[^ \t-\r]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver can reach: ``spark.checkpoint.dir``.

    Where the session names none, a folder of our own is set if the master is local (tests on one machine); on a
    cluster that is an error, since executors would each write to their own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-glossmill-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch on its way to Python; a batch exists several times over there.
BATCH_BYTES = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ``BATCH_BYTES``, so that very long texts do not fill a Python worker.

    Plans read the setting when they run, so it stays for the session; a smaller one of the session's own is kept.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]*)\s*", spark.conf.get(name).lower()).groups()
    scale = dict(zip(("", "b", "k", "m", "g", "t", "p"), (1, 1, 1 << 10, 1 << 20, 1 << 30, 1 << 40, 1 << 50), strict=True))
    now = int(number) * scale[unit.removesuffix("b") if len(unit) > 1 else unit]
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Later plans start from the files, so a lost executor costs one task's read and not the whole lineage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`cut` that no later plan reads."""
    path = getattr(df, "scratch", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every node of ``edges(src, dst)`` with the smallest node it can reach.

    Large-star / small-star contraction: each round points every node at the smallest neighbour seen, with
    ``groupBy(...).min`` (combined before the shuffle) and equi-joins. The minima are written before they are joined,
    so both sides of a join come straight from an exchange and AQE can split a node that holds many edges. No
    neighbour list is ever gathered. Rounds grow with the logarithm of the longest path; a graph that has not settled
    after ``max_rounds`` is an error. Null ends and loops are ignored; an empty input gives an empty result. Returns
    ``(node, component)``.
    """
    here = cut(
        edges.where(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct(),
        "edges",
    )
    seen = None
    for _ in range(max_rounds):
        both = here.unionByName(here.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        for old in (here, low, least):
            release(old)
        here = after
        state = here.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    labels = here.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels.unionByName(labels.select("component", "component").toDF("node", "component").distinct())


def boxed(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct: a plan may then add columns of any name beside it."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns])
