"""Small operators on sequences and pairs of runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions import text as T


def join_by_position(entries: DataFrame) -> DataFrame:
    """``entries(entry_id, predicted, truth)`` as a row for each position, ``[NONE]`` where one list is shorter."""
    pairs = F.zip_with("predicted", "truth", lambda p, t: F.struct(F.coalesce(p, F.lit("[NONE]")).alias("predicted"), F.coalesce(t, F.lit("[NONE]")).alias("truth")))
    rows = entries.select("entry_id", F.posexplode(pairs).alias("position", "x")).select("entry_id", "position", "x.*")
    return rows.withColumn("matches", T.norm_gloss(F.col("predicted")) == T.norm_gloss(F.col("truth")))


def baseline_vs_model(runs: DataFrame, value: str) -> DataFrame:
    """``runs(entry_id, run, value)`` with both runs of an entry in one row."""
    return runs.groupBy("entry_id").pivot("run", ["baseline", "model"]).agg(F.avg(value)).withColumn("change", F.col("model") - F.col("baseline"))


# Patterns of what is said, and the answer to each, in order.
REPLIES = (
    (r"(?i)\b(hello|hi|hey)\b", "Hello!"),
    (r"(?i)\b(thanks|thank you)\b", "You are welcome."),
    (r"(?i)\bhow are you\b", "I am fine, and you?"),
    (r"(?i)\b(bye|goodbye)\b", "Goodbye!"),
)


def quick_reply(text: Column, replies: tuple[tuple[str, str], ...] = REPLIES) -> Column:
    """The answer of the first pattern that fits, null if none does."""
    out = F.lit(None).cast("string")
    for pattern, answer in reversed(replies):
        out = F.when(text.rlike(pattern), answer).otherwise(out)
    return out


def caption_trigger(gloss: Column, n: Column, since_word: Column, since_call: Column, questions: tuple[str, ...], ends: tuple[str, ...]) -> Column:
    """Why a buffer of ``n`` words closes now, null if it stays open: the rules in order."""
    word = T.norm_gloss(gloss)
    return (
        F.when((since_word > 1.8) & (n >= 2), "pause")
        .when(n >= 3, "full")
        .when(word.isin(*questions) & (n >= 2), "question")
        .when(word.isin(*ends), "end")
        .when(since_call > 10, "timeout")
    )


def compare_versions(entries: DataFrame) -> DataFrame:
    """Two versions of a score on the same pairs: effect size of each, their rank correlation, and disagreements.

    ``entries(entry_id, a_base, a_model, b_base, b_model)``; a disagreement is an entry that one version sees improve and
    the other does not.
    """
    from glossmill.operators.statistics import average_rank

    da, db = F.col("a_model") - F.col("a_base"), F.col("b_model") - F.col("b_base")
    sizes = entries.agg(
        F.count("*").alias("n"), (F.avg(da) / F.stddev_samp(da)).alias("d_a"), (F.avg(db) / F.stddev_samp(db)).alias("d_b"),
        F.count_if((da > 0) != (db > 0)).alias("disagreements"),
    )
    ranked = average_rank(average_rank(entries.select("entry_id", "a_model", "b_model"), "a_model", [], "ra"), "b_model", [], "rb")
    return sizes.join(F.broadcast(ranked.agg(F.corr("ra", "rb").alias("rank_correlation"))))


def union_glosses(*lists: DataFrame) -> DataFrame:
    """Distinct classes of several lists, sorted."""
    out = lists[0].select("gloss")
    for other in lists[1:]:
        out = out.unionByName(other.select("gloss"))
    return out.distinct().orderBy("gloss")


def shared_glosses(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("gloss").intersect(b.select("gloss"))


def average_features_mixed(features: DataFrame, by: str) -> DataFrame:
    """Mean of each number and commonest value (the smaller of equals) of anything else, for each class."""
    numbers = ("double", "float", "bigint", "int")
    aggs = [F.avg(c).alias(c) if kind in numbers else F.mode(c, True).alias(c) for c, kind in features.dtypes if c != by]
    return features.groupBy(by).agg(*aggs)


def predict(clips: DataFrame, model: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Scores of a user's model for each row of ``clips(clip_id, clip)``: ``(clip_id, scores)``.

    The model gets one clip of shape (frames, points, coordinates) at a time and returns a score for each class.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scores = [np.asarray(model(np.array([[np.asarray(p, float) for p in frame] for frame in clip])), float).tolist() for clip in pdf["clip"]]
            yield pd.DataFrame({"clip_id": pdf["clip_id"], "scores": scores})

    return clips.select("clip_id", "clip").mapInPandas(run, f"clip_id {dict(clips.dtypes)['clip_id']}, scores array<double>")
