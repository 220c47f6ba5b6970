"""Reports over evaluation entries: sentence metrics, summaries, selection of candidates, plug-in scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossmill.functions import text as T


def all_metrics(entries: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """``entries(reference, output, glosses, predicted, plausibility)`` with accuracy, coverage and the indices."""
    cover = T.coverage(F.col("ref_words"), F.col("out_words"))
    scored = (
        entries.withColumn("ref_words", T.content_words(F.col("reference"), stop))
        .withColumn("out_words", T.content_words(F.col("output"), stop))
        .withColumn("cover", cover)
        .withColumn("ga", T.gloss_accuracy(F.col("predicted"), F.col("glosses")))
    )
    accuracy, f1, quality = F.col("ga.accuracy"), F.col("cover.f1"), F.col("plausibility").cast("double")
    perfect = T.perfect_translation(F.col("predicted"), F.col("glosses"))
    return scored.select(
        *[c for c in entries.columns],
        accuracy.alias("gloss_accuracy"),
        F.col("ga.correct").alias("correct"),
        F.col("ga.total").alias("total"),
        F.size("ga.mismatches").alias("mismatches"),
        perfect.alias("perfect"),
        F.col("cover.recall").alias("recall"),
        F.col("cover.precision").alias("precision"),
        f1.alias("f1"),
        F.size("cover.missing_words").alias("missing"),
        F.size("cover.hallucinated_words").alias("hallucinated"),
        T.ctqi_v1(accuracy, quality, perfect).alias("ctqi_v1"),
        T.ctqi_geometric(accuracy, quality, f1).alias("ctqi_geometric"),
        T.ctqi_v2(accuracy, f1, quality).alias("ctqi_v2"),
        T.ctqi_v3(accuracy, f1, quality).alias("ctqi_v3"),
    )


def eval_summary(metrics: DataFrame) -> DataFrame:
    """One row over all entries: means that leave nulls out, micro and macro accuracy, perfect entries, word totals."""
    means = ["gloss_accuracy", "recall", "precision", "f1", "ctqi_v1", "ctqi_geometric", "ctqi_v2", "ctqi_v3"]
    return metrics.agg(
        F.count("*").alias("entries"),
        *[F.avg(c).alias(f"avg_{c}") for c in means],
        (F.sum("correct") / F.sum("total") * 100).alias("micro_accuracy"),
        F.count_if(F.col("perfect") == 100).alias("perfect_entries"),
        F.sum("missing").alias("missing_words"),
        F.sum("hallucinated").alias("hallucinated_words"),
    )


def mismatch_breakdown(predictions: DataFrame, k: int = 3) -> DataFrame:
    """Wrong top-1 predictions by cause: the truth was among the top ``k`` (selection) or was not (model)."""
    wrong = predictions.where(F.col("top_k")[0]["gloss"] != F.col("true_gloss"))
    among = F.exists(F.slice("top_k", 1, k), lambda c: c["gloss"] == F.col("true_gloss"))
    cause = F.when(among, "selection").otherwise("model").alias("cause")
    return wrong.groupBy(cause).agg(F.count("*").alias("n"))


def _selection_aggs() -> list[Column]:
    top1 = (F.col("top_k")[0]["gloss"] == F.col("true_gloss")).cast("double")
    top3 = F.exists(F.slice("top_k", 1, 3), lambda c: c["gloss"] == F.col("true_gloss")).cast("double")
    chosen = (F.col("selected") == F.col("true_gloss")).cast("double")
    return [
        F.count("*").alias("n"),
        (F.avg(top1) * 100).alias("top1_accuracy"),
        (F.avg(top3) * 100).alias("top3_recall"),
        (F.avg(chosen) * 100).alias("selection_accuracy"),
        ((F.avg(chosen) - F.avg(top1)) * 100).alias("lift"),
    ]


def selection_accuracy(predictions: DataFrame) -> DataFrame:
    """Accuracy of the best candidate, recall of the top three, accuracy of ``selected`` and its lift over the best."""
    return predictions.agg(*_selection_aggs())


def selection_by_confidence(predictions: DataFrame, edges: tuple[float, ...] = (0.0, 0.5, 0.8, 1.0001)) -> DataFrame:
    """The same for each confidence bucket of the best candidate; empty buckets are kept."""
    confidence = F.col("top_k")[0]["confidence"]
    spark = predictions.sparkSession
    buckets = spark.createDataFrame([(i, lo) for i, lo in enumerate(edges[:-1])], "bucket int, low double")
    number = sum(((confidence >= e).cast("int") for e in edges[1:-1]), F.lit(0))
    found = predictions.withColumn("bucket", number).groupBy("bucket").agg(*_selection_aggs())
    return buckets.join(found, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def alternatives_used(entries: DataFrame) -> DataFrame:
    """Positions where a lower-ranked candidate is said in the sentence and the best one is not.

    ``entries(entry_id, position, top_k, sentence)``; returns rank (from 2), the alternative and both confidences.
    """
    said = T.words(F.lower(F.regexp_replace("sentence", T.PUNCTUATION, "")))
    ranked = F.transform("top_k", lambda c, i: F.struct((i + 1).alias("rank"), c["gloss"].alias("gloss"), c["confidence"].alias("confidence")))
    used = F.filter(ranked, lambda c: F.array_contains(said, F.lower(c["gloss"])))
    first = F.get(used, F.lit(0))
    return (
        entries.select("entry_id", "position", first.alias("used"), F.col("top_k")[0]["confidence"].alias("top_confidence"))
        .where("used.rank > 1")
        .select("entry_id", "position", "used.rank", "used.gloss", "used.confidence", "top_confidence")
    )


def score_distribution(scored: DataFrame, value: str, by: str) -> DataFrame:
    """Entries in the bands 90-100, 70-90, 50-70, 30-50 and 0-30 of ``value``, a column for each ``by``."""
    v = F.col(value)
    band = F.when(v >= 90, "90-100").when(v >= 70, "70-90").when(v >= 50, "50-70").when(v >= 30, "30-50").otherwise("0-30")
    return scored.groupBy(band.alias("band"), by).agg(F.count("*").alias("n"))


def missing_scores(entries: DataFrame, score: str, sentence: str) -> DataFrame:
    """Entries with a sentence but no score, to be scored again."""
    return entries.where((F.coalesce(score, F.lit(0)) == 0) & (F.length(sentence) > 0))


def attach_reference(predictions: DataFrame, sentences: DataFrame) -> DataFrame:
    """Reference sentence by equal gloss sequence; of several the one with the smallest id; ``found`` tells if any.

    ``predictions(id, glosses)``, ``sentences(sentence_id, glosses, sentence)``.
    """
    key = F.concat_ws("\u0001", F.transform("glosses", T.norm_gloss))
    once = sentences.groupBy(key.alias("key")).agg(F.min_by("sentence", "sentence_id").alias("reference"))
    out = predictions.withColumn("key", key).join(once, "key", "left").drop("key")
    return out.withColumn("found", F.col("reference").isNotNull())


def validate_sentences(sentences: DataFrame, vocabulary: DataFrame, least: int = 3, most: int = 8) -> DataFrame:
    """Sentences of ``least`` to ``most`` glosses that are all in ``vocabulary(gloss)``, compared in canonical form.

    The vocabulary is joined gloss by gloss, so it may be of any size.
    """
    known = vocabulary.select(T.norm_gloss(F.col("gloss")).alias("g")).distinct()
    sized = sentences.where(F.size("glosses").between(least, most))
    each = sized.select("sentence_id", F.explode(F.transform("glosses", T.norm_gloss)).alias("g"))
    unknown = each.join(known, "g", "left_anti").select("sentence_id").distinct()
    return sized.join(unknown, "sentence_id", "left_anti")


def scorer(score: Callable[[pd.Series], pd.Series], fallback: Callable[[pd.Series], pd.Series] | None = None) -> Callable[[Column], Column]:
    """Column function from a user's function over batches of sentences; where it gives nothing the fallback counts."""

    def column(of: Callable[[pd.Series], pd.Series]) -> Callable[[Column], Column]:
        @F.pandas_udf("double")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield of(batch).astype("float64")

        return run

    first = column(score)
    if fallback is None:
        return first
    second = column(fallback)
    return lambda sentence: F.coalesce(first(sentence), second(sentence))


def rolling_context(captions: DataFrame, n: int = 2) -> DataFrame:
    """The last ``n`` sentences before each of ``captions(session_id, seq, sentence)``, oldest first."""
    before = Window.partitionBy("session_id").orderBy("seq").rowsBetween(-n, -1)
    return captions.withColumn("context", F.collect_list("sentence").over(before))


def gloss_usage(pending: DataFrame) -> DataFrame:
    """Marks the glosses of ``pending(glosses, selections)`` that the caption used."""
    picked = F.transform("selections", F.lower)
    marked = F.transform("glosses", lambda g: F.struct(g.alias("gloss"), F.array_contains(picked, F.lower(g)).alias("used")))
    return pending.withColumn("usage", marked)


def latency_average(calls: DataFrame, n: int = 20) -> DataFrame:
    """Mean of the last ``n`` values of ``calls(session_id, seq, latency)``."""
    last = Window.partitionBy("session_id").orderBy("seq").rowsBetween(1 - n, 0)
    return calls.withColumn("avg_latency", F.avg("latency").over(last))
