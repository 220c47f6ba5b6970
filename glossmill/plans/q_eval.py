"""Queries over evaluation entries and top-k predictions, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions import text as T
from glossmill.operators import evalreport as E
from glossmill.plans import proxies as P
from glossmill.plans.registry import query

_STOPS = ", ".join(f"'{w}'" for w in T.FUNCTION_WORDS)
_CLEAN = "regexp_replace(lower({}), '[!-/:-@\\[-`{{-~]', '', 'g')"
_WORDS = "[x for x in regexp_split_to_array(trim(" + _CLEAN + "), '\\s+') if x <> '' and not list_contains([" + _STOPS + "], x)]"
_NEAR = (
    "(contains(b, a) OR contains(a, b) OR (len(a) >= 4 AND starts_with(b, substr(a, 1, 4)))"
    " OR (len(b) >= 4 AND starts_with(a, substr(b, 1, 4))))"
)

METRICS_SQL = f"""
WITH {P.ENTRIES_SQL}, worded AS (
  SELECT *, {_WORDS.format("reference")} AS r, {_WORDS.format("output")} AS o FROM entries
), rw AS (SELECT entry_id, unnest(r) AS a, generate_subscripts(r, 1) AS i FROM worded),
ow AS (SELECT entry_id, unnest(o) AS b, generate_subscripts(o, 1) AS j FROM worded),
rhit AS (SELECT entry_id, count(*) AS n FROM (SELECT DISTINCT rw.entry_id, i FROM rw JOIN ow ON rw.entry_id = ow.entry_id AND {_NEAR}) GROUP BY 1),
ohit AS (SELECT entry_id, count(*) AS n FROM (SELECT DISTINCT rw.entry_id, j FROM rw JOIN ow ON rw.entry_id = ow.entry_id AND {_NEAR}) GROUP BY 1),
counted AS (
  SELECT w.*, len(r) AS nr, len(o) AS no, coalesce(rhit.n, 0) AS hr, coalesce(ohit.n, 0) AS ho,
         least(len(glosses), len(predicted)) AS total,
         len([k for k in range(1, least(len(glosses), len(predicted)) + 1) if glosses[k] = predicted[k]]) AS correct
  FROM worded w LEFT JOIN rhit USING (entry_id) LEFT JOIN ohit USING (entry_id)
), shares AS (
  SELECT *, CASE WHEN nr > 0 THEN hr / nr * 100 ELSE 0 END AS recall, CASE WHEN no > 0 THEN ho / no * 100 ELSE 0 END AS precision,
         CASE WHEN total > 0 THEN correct / total * 100 ELSE 0 END AS ga,
         CASE WHEN len(predicted) > 0 AND predicted = glosses THEN 100.0 ELSE 0.0 END AS perfect,
         CAST(plausibility AS DOUBLE) AS p
  FROM counted
), f AS (
  SELECT *, CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0 END AS f1 FROM shares
), metrics AS (
  SELECT entry_id, ga AS gloss_accuracy, correct, total, greatest(len(glosses), len(predicted)) - correct AS mismatches, perfect, recall, precision, f1,
         nr - hr AS missing, no - ho AS hallucinated,
         (ga * 0.4 + p * 0.4 + perfect * 0.2) AS ctqi_v1,
         exp((ln(greatest(ga, 1) / 100) + ln(greatest(p, 1) / 100) + ln(greatest(f1, 1) / 100)) / 3) * 100 AS ctqi_geometric,
         ga / 100 * (f1 / 100) * (0.5 + 0.5 * (p / 100)) * 100 AS ctqi_v2,
         ga / 100 * (f1 / 100) * (0.5 + 0.5 * (p / 100) * (ga / 100)) * 100 AS ctqi_v3
  FROM f
)
"""
_SCORES = ("gloss_accuracy", "recall", "precision", "f1", "ctqi_v1", "ctqi_geometric", "ctqi_v2", "ctqi_v3")
_ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in _SCORES)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Doubles to six places, so that the order of a sum does not show."""
    return df.withColumns({c: F.round(c, 6) for c in names})


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.all_metrics(P.entries(spark, sf_dir))


@query("all_metrics", METRICS_SQL + f"SELECT entry_id, correct, total, mismatches, perfect, missing, hallucinated, {_ROUND} FROM metrics")
def all_metrics(spark, sf_dir):
    counts = ["correct", "total", "mismatches", "perfect", "missing", "hallucinated"]
    return rounded(_metrics(spark, sf_dir), *_SCORES).select("entry_id", *counts, *_SCORES)


@query(
    "eval_summary",
    METRICS_SQL
    + "SELECT count(*) AS entries, "
    + ", ".join(f"round(avg({c}), 6) AS avg_{c}" for c in _SCORES)
    + ", round(sum(correct) / sum(total) * 100, 6) AS micro_accuracy, count(*) FILTER (perfect = 100) AS perfect_entries,"
    " CAST(sum(missing) AS BIGINT) AS missing_words, CAST(sum(hallucinated) AS BIGINT) AS hallucinated_words FROM metrics",
)
def eval_summary(spark, sf_dir):
    return rounded(E.eval_summary(_metrics(spark, sf_dir)), *[f"avg_{c}" for c in _SCORES], "micro_accuracy")


@query(
    "score_distribution",
    METRICS_SQL
    + """, bands AS (
  SELECT 'v2' AS version, ctqi_v2 AS v FROM metrics UNION ALL SELECT 'v3', ctqi_v3 FROM metrics
) SELECT CASE WHEN v >= 90 THEN '90-100' WHEN v >= 70 THEN '70-90' WHEN v >= 50 THEN '50-70' WHEN v >= 30 THEN '30-50' ELSE '0-30' END AS band,
         version, count(*) AS n FROM bands GROUP BY 1, 2""",
)
def score_distribution(spark, sf_dir):
    scored = _metrics(spark, sf_dir).select("ctqi_v2", "ctqi_v3")
    long = scored.select(F.expr("stack(2, 'v2', ctqi_v2, 'v3', ctqi_v3) AS (version, v)"))
    return E.score_distribution(long, "v", "version")


@query(
    "perplexity_scores",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN x < 50 THEN 100 WHEN x < 100 THEN 90 + (100 - x) / 50 * 10
  WHEN x < 500 THEN 60 + (500 - x) / 400 * 30 WHEN x < 2000 THEN 30 + (2000 - x) / 1500 * 30
  WHEN x < 5000 THEN 10 + (5000 - x) / 3000 * 20 ELSE greatest(0, 10 - (x - 5000) / 1000) END, 6) AS score
FROM (SELECT *, l_extendedprice / 7 AS x FROM lineitem)""",
)
def perplexity_scores(spark, sf_dir):
    score = T.perplexity_to_score(F.col("l_extendedprice") / 7)
    return P.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(score, 6).alias("score"))


@query(
    "attach_reference",
    """WITH s AS (SELECT doc_id, [trim(upper(x)) for x in regexp_split_to_array(trim(text), '\\s+') if x <> ''] AS g, text FROM documents),
once AS (SELECT g, min(doc_id) AS sentence_id FROM s GROUP BY g)
SELECT s.doc_id, once.sentence_id AS reference_id, once.sentence_id IS NOT NULL AS found
FROM s LEFT JOIN (SELECT * FROM once WHERE sentence_id % 2 = 0) once USING (g)""",
)
def attach_reference(spark, sf_dir):
    docs = P.table(spark, sf_dir, "documents").withColumn("glosses", T.words(F.col("text")))
    first = docs.groupBy(F.transform("glosses", T.norm_gloss).alias("glosses")).agg(F.min("doc_id").alias("sentence_id")).where("sentence_id % 2 = 0")
    out = E.attach_reference(docs.select("doc_id", "glosses"), first.withColumn("sentence", F.col("sentence_id")))
    return out.select("doc_id", F.col("reference").alias("reference_id"), "found")


@query(
    "parse_props",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS score, least(greatest(CAST(json_extract_string(props, '$.k') AS DOUBLE) * 3, 0), 100) AS clamped
FROM events""",
)
def parse_props(spark, sf_dir):
    answer = F.concat(F.lit('```json\n{"overall": '), (F.get_json_object("props", "$.k").cast("double") * 3).cast("string"), F.lit("}\n```"))
    return P.table(spark, sf_dir, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("double").alias("score"), T.parse_score(answer).alias("clamped")
    )


@query(
    "validate_sentences",
    """WITH s AS (SELECT doc_id AS sentence_id, [x for x in regexp_split_to_array(trim(text), '\\s+') if x <> ''] AS g FROM documents),
vocab AS (SELECT DISTINCT upper(unnest(g)) AS w FROM s WHERE sentence_id % 5 = 0),
bad AS (SELECT DISTINCT sentence_id FROM (SELECT sentence_id, upper(unnest(g)) AS w FROM s) WHERE w NOT IN (SELECT w FROM vocab))
SELECT sentence_id, len(g) AS n FROM s WHERE len(g) BETWEEN 3 AND 60 AND sentence_id NOT IN (SELECT sentence_id FROM bad)""",
)
def validate_sentences(spark, sf_dir):
    said = P.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sentence_id"), T.words(F.col("text")).alias("glosses"))
    vocabulary = said.where("sentence_id % 5 = 0").select(F.explode("glosses").alias("gloss"))
    return E.validate_sentences(said, vocabulary, 3, 60).select("sentence_id", F.size("glosses").alias("n"))


@query(
    "wrapped_lines",
    """WITH RECURSIVE w AS (SELECT item_id, [x for x in regexp_split_to_array(trim(coalesce(text, '')), '\\s+') if x <> ''] AS g FROM benchmark),
step AS (
  SELECT item_id, g, 1 AS i, '' AS done, coalesce(g[1], '') AS line FROM w
  UNION ALL
  SELECT item_id, g, i + 1, CASE WHEN length(line) + 1 + length(g[i + 1]) <= 50 THEN done WHEN done = '' THEN line ELSE done || chr(10) || line END,
         CASE WHEN length(line) + 1 + length(g[i + 1]) <= 50 THEN line || ' ' || g[i + 1] ELSE g[i + 1] END
  FROM step WHERE i < len(g)
), said AS (SELECT item_id, CASE WHEN done = '' THEN line ELSE done || chr(10) || line END AS wrapped FROM step WHERE i >= len(g))
SELECT item_id, len(string_split(wrapped, chr(10))) AS lines, wrapped FROM said""",
)
def wrapped_lines(spark, sf_dir):
    wrapped = T.wrap_text(F.col("text"), 50)
    return P.table(spark, sf_dir, "benchmark").select("item_id", F.size(F.split(wrapped, "\n")).alias("lines"), wrapped.alias("wrapped"))


@query(
    "format_prompt",
    f"""WITH {P.PREDICTIONS_SQL}
SELECT video_id, aug_id, signer_id, true_gloss, concat('Position 1: ''', g1, ''' (', printf('%.1f', round(c1 * 100, 1)), '%), ''', g2, ''' (', printf('%.1f', round(c2 * 100, 1)), '%)') AS prompt
FROM predictions""",
)
def format_prompt(spark, sf_dir):
    two = F.array(F.slice("top_k", 1, 2))
    return P.predictions(spark, sf_dir).select("video_id", "aug_id", "signer_id", "true_gloss", T.format_prompt(two).alias("prompt"))


@query(
    "mismatch_breakdown",
    f"WITH {P.PREDICTIONS_SQL} SELECT CASE WHEN true_gloss IN (g1, g2, g3) THEN 'selection' ELSE 'model' END AS cause, count(*) AS n FROM predictions WHERE g1 <> true_gloss GROUP BY 1",
)
def mismatch_breakdown(spark, sf_dir):
    return E.mismatch_breakdown(P.predictions(spark, sf_dir))


_SELECTED = "CASE WHEN aug_id % 3 = 0 THEN g2 ELSE g1 END"
_SEL_AGGS = f"""count(*) AS n, round(avg(CAST(g1 = true_gloss AS INT)) * 100, 6) AS top1_accuracy,
  round(avg(CAST(true_gloss IN (g1, g2, g3) AS INT)) * 100, 6) AS top3_recall, round(avg(CAST({_SELECTED} = true_gloss AS INT)) * 100, 6) AS selection_accuracy,
  round((avg(CAST({_SELECTED} = true_gloss AS INT)) - avg(CAST(g1 = true_gloss AS INT))) * 100, 6) AS lift"""
_SEL_COLS = ("top1_accuracy", "top3_recall", "selection_accuracy", "lift")


def _selected(spark, sf_dir):
    pick = F.when(F.col("aug_id") % 3 == 0, F.col("top_k")[1]["gloss"]).otherwise(F.col("top_k")[0]["gloss"])
    return P.predictions(spark, sf_dir).withColumn("selected", pick)


@query("selection_accuracy", f"WITH {P.PREDICTIONS_SQL} SELECT {_SEL_AGGS} FROM predictions")
def selection_accuracy(spark, sf_dir):
    return rounded(E.selection_accuracy(_selected(spark, sf_dir)), *_SEL_COLS)


@query(
    "selection_by_confidence",
    f"""WITH {P.PREDICTIONS_SQL}, b(bucket, low) AS (VALUES (0, 0.0), (1, 0.5), (2, 0.8)),
agg AS (SELECT CAST(c1 >= 0.5 AS INT) + CAST(c1 >= 0.8 AS INT) AS bucket, {_SEL_AGGS} FROM predictions GROUP BY 1)
SELECT b.bucket, CAST(low AS DOUBLE) AS low, coalesce(n, 0) AS n, top1_accuracy, top3_recall, selection_accuracy, lift FROM b LEFT JOIN agg USING (bucket)""",
)
def selection_by_confidence(spark, sf_dir):
    return rounded(E.selection_by_confidence(_selected(spark, sf_dir)), *_SEL_COLS)


@query(
    "alternatives_used",
    f"""WITH {P.PREDICTIONS_SQL}
SELECT video_id AS entry_id, aug_id AS position, signer_id, 2 AS rank, g2 AS gloss, c2 AS confidence, c1 AS top_confidence
FROM predictions WHERE g1 <> true_gloss AND g2 = true_gloss
UNION ALL
SELECT video_id, aug_id, signer_id, 3, g3, c3, c1 FROM predictions WHERE g1 <> true_gloss AND g2 <> true_gloss AND g3 = true_gloss""",
)
def alternatives_used(spark, sf_dir):
    said = P.predictions(spark, sf_dir).select(
        F.struct("video_id", "signer_id").alias("entry_id"), F.col("aug_id").alias("position"), "top_k", F.col("true_gloss").alias("sentence")
    )
    return E.alternatives_used(said).select("entry_id.video_id", "entry_id.signer_id", "position", "rank", "gloss", "confidence", "top_confidence").withColumnRenamed(
        "video_id", "entry_id"
    )


@query(
    "missing_scores",
    "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality, 0) = 0 AND length(text) > 0",
)
def missing_scores(spark, sf_dir):
    docs = P.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = P.table(spark, sf_dir, "labels").select("doc_id", "quality")
    return E.missing_scores(docs.join(labels, "doc_id", "left"), "quality", "text").select("doc_id", "quality")


@query(
    "latency_average",
    "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS avg_latency FROM events",
)
def latency_average(spark, sf_dir):
    calls = P.table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("session_id"), F.struct("ts", "event_id").alias("seq"), F.col("value").alias("latency")
    )
    return rounded(E.latency_average(calls), "avg_latency").select("event_id", "avg_latency")


@query(
    "rolling_context",
    """SELECT conv_id, turn, coalesce(lag(text, 2) OVER w || chr(10), '') || coalesce(lag(text, 1) OVER w, '') AS context
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
)
def rolling_context(spark, sf_dir):
    turns = P.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.col("text").alias("sentence"))
    out = E.rolling_context(turns)
    return out.select(F.col("session_id").alias("conv_id"), F.col("seq").alias("turn"), F.array_join("context", "\n").alias("context"))
