"""A training-data pipeline over ``documents`` made of the text operators; each stage is written and read again.

All stages but the last keep every column of ``documents``, whatever its name, and give an empty table for an empty one.
Null texts count as empty. Ties and repeated rows are settled as each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossmill.llm import decontam, linededup, mixing, simhash, toxicity
from glossmill.llm.common import cut, release


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go. Empty texts have the prior's score; repeated rows go or stay together."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def drop_copied_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line runs of at least 50 words that copy an earlier run go, and documents of which nothing is left.

    Earlier is by doc_id (null last), then a hash of the text; documents that had no words stay.
    """
    return linededup.drop_copied_runs(docs, min_words=50)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a five-word Jaccard similarity of 0.8 stays, the one with the smallest doc_id.

    Ties (and nulls, which come last) fall to a hash of the text; of rows repeated in full one stays. Documents without
    words are one group.
    """
    return simhash.drop_near_copies(docs, width=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item go; null items have no words."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; a row for each document, in which ``taken`` may be 0."""
    return mixing.mix_sources(docs, weights=(5, 2, 1), share=1.5, max_epochs=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_copied_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: The classifier and the fingerprints are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to ``documents``; between stages the rows are written to the shared folder.

    A copy goes once the next one is written; the last one stays, since the result reads it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        after = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        release(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
