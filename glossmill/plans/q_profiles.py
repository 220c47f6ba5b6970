"""Queries over top-k predictions: profiles, confusion, error themes, vocabulary curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossmill.operators import profiles as O
from glossmill.plans import proxies as P
from glossmill.plans.q_eval import rounded
from glossmill.plans.registry import query

_WITH = f"WITH {P.PREDICTIONS_SQL}"
_RIGHT = "CAST(g1 = true_gloss AS INT)"
_IN3 = "CAST(true_gloss IN (g1, g2, g3) AS INT)"
_MATRIX = "matrix AS (SELECT true_gloss, g1 AS pred_gloss, count(*) AS n FROM predictions GROUP BY 1, 2)"


@query("confusion_matrix", f"{_WITH}, {_MATRIX} SELECT * FROM matrix")
def confusion_matrix(spark, sf_dir):
    return O.confusion_matrix(P.predictions(spark, sf_dir))


@query(
    "confused_pairs",
    f"""{_WITH}, {_MATRIX}, totals AS (SELECT true_gloss AS g, sum(n) AS total FROM matrix GROUP BY 1),
pairs AS (
  SELECT least(true_gloss, pred_gloss) AS a, greatest(true_gloss, pred_gloss) AS b,
         sum(CASE WHEN true_gloss < pred_gloss THEN n ELSE 0 END) AS a_to_b, sum(CASE WHEN true_gloss > pred_gloss THEN n ELSE 0 END) AS b_to_a
  FROM matrix WHERE true_gloss <> pred_gloss GROUP BY 1, 2
), shares AS (
  SELECT a, b, a_to_b, b_to_a, coalesce(a_to_b / x.total * 100, 0) AS share_a, coalesce(b_to_a / y.total * 100, 0) AS share_b
  FROM pairs LEFT JOIN totals x ON a = x.g LEFT JOIN totals y ON b = y.g
)
SELECT a, b, CAST(a_to_b AS BIGINT) AS a_to_b, CAST(b_to_a AS BIGINT) AS b_to_a, round(share_a, 6) AS share_a, round(share_b, 6) AS share_b,
       greatest(share_a, share_b) > 20 AS systematic, greatest(a_to_b, b_to_a) > 3 * least(a_to_b, b_to_a) AS one_sided FROM shares""",
)
def confused_pairs(spark, sf_dir):
    return rounded(O.confused_pairs(O.confusion_matrix(P.predictions(spark, sf_dir))), "share_a", "share_b")


_CLASS_SQL = f"""classes AS (
  SELECT true_gloss, count(*) AS total, count(*) FILTER (g1 = true_gloss) AS correct, avg({_RIGHT}) * 100 AS top1, avg({_IN3}) * 100 AS top3
  FROM predictions GROUP BY 1
)"""


@query(
    "per_class_accuracy",
    f"""{_WITH}, {_MATRIX}, {_CLASS_SQL}, wrong AS (
  SELECT *, row_number() OVER (PARTITION BY true_gloss ORDER BY n DESC, pred_gloss) AS k FROM matrix WHERE true_gloss <> pred_gloss
), named AS (SELECT true_gloss, string_agg(pred_gloss || ':' || n, ',' ORDER BY k) AS confusions FROM wrong WHERE k <= 3 GROUP BY 1)
SELECT true_gloss, total, correct, round(top1, 6) AS top1, round(top3, 6) AS top3, coalesce(confusions, '') AS confusions
FROM classes LEFT JOIN named USING (true_gloss)""",
)
def per_class_accuracy(spark, sf_dir):
    return rounded(O.per_class_accuracy(P.predictions(spark, sf_dir)), "top1", "top3")


@query(
    "keep_drop",
    f"{_WITH}, {_CLASS_SQL} SELECT true_gloss, CASE WHEN top1 >= 76 AND top3 >= 86 THEN 'keep' ELSE 'drop' END AS decision FROM classes",
)
def keep_drop(spark, sf_dir):
    return O.keep_drop(O.per_class_accuracy(P.predictions(spark, sf_dir)), 76, 86).select("true_gloss", "decision")


_PROFILE_SQL = f"""profiles AS (
  SELECT true_gloss AS sign, count(*) AS n_clips, count(*) FILTER (NOT is_augmented) AS n_originals, avg({_RIGHT}) * 100 AS top1_accuracy,
         avg(CAST(true_gloss IN (g1, g2) AS INT)) * 100 AS top2_hit_rate, avg({_IN3}) * 100 AS top3_hit_rate, avg(c1) * 100 AS avg_confidence,
         stddev_pop(c1) * 100 AS std_confidence,
         avg(CASE WHEN g1 = true_gloss THEN c1 WHEN g2 = true_gloss THEN c2 WHEN g3 = true_gloss THEN c3 END) * 100 AS avg_true_confidence
  FROM predictions GROUP BY 1
)"""
_PROFILE_COLS = ("top1_accuracy", "top2_hit_rate", "top3_hit_rate", "avg_confidence", "std_confidence", "avg_true_confidence")


def _profiles(spark, sf_dir):
    return O.sign_profiles(P.predictions(spark, sf_dir))


@query(
    "sign_profiles",
    f"{_WITH}, {_PROFILE_SQL} SELECT sign, n_clips, n_originals, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in _PROFILE_COLS)
    + ", CASE WHEN top3_hit_rate >= 90 AND avg_confidence >= 70 THEN 'easy' WHEN top3_hit_rate >= 75 AND avg_confidence >= 50 THEN 'medium' ELSE 'hard' END AS difficulty FROM profiles",
)
def sign_profiles(spark, sf_dir):
    return rounded(_profiles(spark, sf_dir), *_PROFILE_COLS)


@query(
    "confusion_maps",
    f"{_WITH}, {_MATRIX} SELECT true_gloss AS sign, string_agg(pred_gloss || '=' || n, ',' ORDER BY pred_gloss) AS confusions FROM matrix WHERE true_gloss <> pred_gloss GROUP BY 1",
)
def confusion_maps(spark, sf_dir):
    maps = O.confusion_maps(P.predictions(spark, sf_dir))
    each = F.transform(F.map_entries("confusions"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return maps.select("sign", F.array_join(each, ",").alias("confusions"))


@query(
    "pass_rate",
    f"{_WITH}, {_PROFILE_SQL} SELECT count(*) AS signs, count(*) FILTER (top3_hit_rate >= 86 AND avg_confidence >= 75) AS passing, round(avg(CAST(top3_hit_rate >= 86 AND avg_confidence >= 75 AS INT)) * 100, 6) AS pass_rate FROM profiles",
)
def pass_rate(spark, sf_dir):
    return rounded(O.pass_rate(_profiles(spark, sf_dir), 75, 86), "pass_rate")


@query(
    "per_gloss_performance",
    f"""{_WITH}, acc AS (SELECT true_gloss, count(*) AS n, avg({_RIGHT}) AS accuracy,
  array_to_string(list_slice(list_sort(list_distinct(list(video_id) FILTER (g1 <> true_gloss))), 1, 10), ',') AS errors FROM predictions GROUP BY 1)
SELECT true_gloss, n, round(accuracy, 6) AS accuracy, coalesce(errors, '') AS errors,
       CASE WHEN accuracy < 0.25 THEN '0-25' WHEN accuracy < 0.5 THEN '25-50' WHEN accuracy < 0.75 THEN '50-75' ELSE '75-100' END AS band,
       accuracy < 0.5 AND n >= 5 AS poor FROM acc""",
)
def per_gloss_performance(spark, sf_dir):
    out = rounded(O.per_gloss_performance(P.predictions(spark, sf_dir)), "accuracy")
    return out.withColumn("errors", F.array_join(F.transform("errors", lambda x: x.cast("string")), ","))


@query(
    "signer_clusters",
    f"""{_WITH}, o AS (SELECT min(video_id) AS lo, max(video_id) AS hi, avg({_RIGHT}) AS overall FROM predictions),
b AS (SELECT least(CAST(floor((video_id - lo) / greatest((hi - lo) / 10, 1e-9)) AS BIGINT), 9) AS bin, {_RIGHT} AS ok, overall FROM predictions, o)
SELECT bin, count(*) AS n, round(avg(ok), 6) AS accuracy, avg(ok) < min(overall) - 0.1 AS problem FROM b GROUP BY 1 HAVING count(*) >= 5""",
)
def signer_clusters(spark, sf_dir):
    return rounded(O.signer_clusters(P.predictions(spark, sf_dir)), "accuracy")


@query(
    "length_buckets",
    f"""{_WITH} SELECT CASE WHEN n_frames < 30 THEN '0-30' WHEN n_frames < 60 THEN '30-60' WHEN n_frames < 90 THEN '60-90' WHEN n_frames < 120 THEN '90-120' ELSE '120+' END AS bucket,
count(*) AS n, round(avg({_RIGHT}), 6) AS accuracy FROM predictions GROUP BY 1 HAVING count(*) >= 10""",
)
def length_buckets(spark, sf_dir):
    return rounded(O.length_buckets(P.predictions(spark, sf_dir)), "accuracy")


@query(
    "augmentation_quality",
    f"""{_WITH}, x AS (SELECT true_gloss, count(*) FILTER (NOT is_augmented) AS n_original, count(*) FILTER (is_augmented) AS n_augmented,
  avg({_RIGHT}) FILTER (NOT is_augmented) AS a, avg({_RIGHT}) FILTER (is_augmented) AS b FROM predictions GROUP BY 1)
SELECT true_gloss, n_original, n_augmented, round(a, 6) AS acc_original, round(b, 6) AS acc_augmented, round(a - b, 6) AS gap, abs(a - b) > 0.02 AS flagged
FROM x WHERE n_original >= 3 AND n_augmented >= 3""",
)
def augmentation_quality(spark, sf_dir):
    return rounded(O.augmentation_quality(P.predictions(spark, sf_dir), gap=0.02), "acc_original", "acc_augmented", "gap")


_REPORT_SQL = f"""t AS (SELECT true_gloss AS gloss, count(*) AS support, count(*) FILTER (g1 = true_gloss) AS tp FROM predictions GROUP BY 1),
s AS (SELECT g1 AS gloss, count(*) AS predicted FROM predictions GROUP BY 1),
pr AS (SELECT gloss, coalesce(support, 0) AS support, CASE WHEN coalesce(predicted, 0) > 0 THEN coalesce(tp, 0) / predicted ELSE 0 END AS precision,
  CASE WHEN coalesce(support, 0) > 0 THEN tp / support ELSE 0 END AS recall FROM t FULL JOIN s USING (gloss)),
report AS (SELECT gloss, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, support FROM pr)"""


@query(
    "classification_report",
    f"{_WITH}, {_REPORT_SQL} SELECT gloss, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM report",
)
def classification_report(spark, sf_dir):
    return rounded(O.classification_report(P.predictions(spark, sf_dir)), "precision", "recall", "f1")


_AVERAGES = [f"{kind}_{c}" for kind in ("macro", "weighted") for c in ("precision", "recall", "f1")]


@query(
    "report_averages",
    f"{_WITH}, {_REPORT_SQL} SELECT "
    + ", ".join(f"round(avg({c}), 6) AS macro_{c}, round(sum({c} * support) / sum(support), 6) AS weighted_{c}" for c in ("precision", "recall", "f1"))
    + " FROM report",
)
def report_averages(spark, sf_dir):
    return rounded(O.report_averages(O.classification_report(P.predictions(spark, sf_dir))), *_AVERAGES)


@query(
    "confidence_by_outcome",
    f"{_WITH} SELECT g1 = true_gloss AS is_correct, count(*) AS n, round(avg(c1), 6) AS avg_confidence, round(stddev_pop(c1), 6) AS std_confidence FROM predictions GROUP BY 1",
)
def confidence_by_outcome(spark, sf_dir):
    return rounded(O.confidence_by_outcome(P.predictions(spark, sf_dir)), "avg_confidence", "std_confidence")


_TWO_SQL = f"""{_WITH}, {{}}AS (
  SELECT is_augmented AS part, true_gloss AS sign, avg({_RIGHT}) * 100 AS top1, avg({_IN3}) * 100 AS top3 FROM predictions GROUP BY 1, 2
)""".replace("{}", "p2 ")


def _both(spark, sf_dir):
    every = P.predictions(spark, sf_dir)
    return (O.sign_profiles(every.where("NOT is_augmented")), O.sign_profiles(every.where("is_augmented")))


@query(
    "compare_profiles",
    _TWO_SQL
    + """ SELECT a.sign, round(a.top1, 6) AS top1_a, round(a.top3, 6) AS top3_a, round(b.top1, 6) AS top1_b, round(b.top3, 6) AS top3_b,
round(b.top1 - a.top1, 6) AS top1_change, round(b.top3 - a.top3, 6) AS top3_change FROM p2 a JOIN p2 b ON a.sign = b.sign AND NOT a.part AND b.part""",
)
def compare_profiles(spark, sf_dir):
    return rounded(O.compare_profiles(*_both(spark, sf_dir)), "top1_a", "top3_a", "top1_b", "top3_b", "top1_change", "top3_change")


@query(
    "merge_profiles",
    _TWO_SQL
    + """ SELECT sign, round(top1, 6) AS top1_accuracy FROM p2 a WHERE (NOT part AND sign < 'G10') OR (part AND (sign >= 'G10' OR NOT EXISTS (SELECT 1 FROM p2 b WHERE b.sign = a.sign AND NOT b.part AND b.sign < 'G10')))""",
)
def merge_profiles(spark, sf_dir):
    a, b = _both(spark, sf_dir)
    return rounded(O.merge_profiles(a.where("sign < 'G10'"), b), "top1_accuracy").select("sign", "top1_accuracy")


@query(
    "curate_vocabulary",
    f"""{_WITH}, {_MATRIX}, {_PROFILE_SQL}, w AS (SELECT true_gloss AS sign, pred_gloss AS target, n, sum(n) OVER (PARTITION BY true_gloss) AS errors,
  row_number() OVER (PARTITION BY true_gloss ORDER BY n DESC, pred_gloss DESC) AS k FROM matrix WHERE true_gloss <> pred_gloss),
m AS (SELECT sign, target, n / errors AS share FROM w WHERE k = 1 AND n / errors >= 0.06),
x AS (SELECT m.*, a.top3_hit_rate AS own, b.top3_hit_rate AS other FROM m JOIN profiles a ON a.sign = m.sign JOIN profiles b ON b.sign = m.target WHERE a.top3_hit_rate < 88),
y AS (SELECT *, other >= 88 OR own < other OR (own = other AND sign > target) AS self FROM x),
z AS (SELECT CASE WHEN self THEN sign ELSE target END AS dropped, CASE WHEN self THEN target ELSE sign END AS because, share FROM y)
SELECT dropped, because, round(share, 6) AS share FROM z QUALIFY row_number() OVER (PARTITION BY dropped ORDER BY share DESC, because) = 1""",
)
def curate_vocabulary(spark, sf_dir):
    every = P.predictions(spark, sf_dir)
    return rounded(O.curate_vocabulary(O.sign_profiles(every), O.confusion_matrix(every), 88, 0.06), "share")


@query(
    "vocabulary_curve",
    f"""{_WITH}, {_PROFILE_SQL}, r AS (SELECT sign, row_number() OVER w AS size, """
    + ", ".join(f"round(avg(CAST(top3_hit_rate >= {t} AS INT)) OVER w * 100, 6) AS meets_{t}" for t in (75, 80, 85, 90))
    + " FROM profiles WINDOW w AS (ORDER BY top3_hit_rate DESC, sign ROWS UNBOUNDED PRECEDING)) SELECT * FROM r WHERE size >= 5",
)
def vocabulary_curve(spark, sf_dir):
    return rounded(O.vocabulary_curve(_profiles(spark, sf_dir)), *[f"meets_{t}" for t in (75, 80, 85, 90)])


@query(
    "rank_glosses",
    f"{_WITH}, {_PROFILE_SQL} SELECT sign, dense_rank() OVER (ORDER BY top1_accuracy DESC, top3_hit_rate DESC, avg_confidence DESC) AS rank FROM profiles",
)
def rank_glosses(spark, sf_dir):
    return O.rank_glosses(_profiles(spark, sf_dir))


@query(
    "confidence_gate",
    f"{_WITH} SELECT CASE WHEN c1 >= 0.7 THEN g1 ELSE '<LOW_CONF>' END AS gated, count(*) AS n FROM predictions GROUP BY 1",
)
def confidence_gate(spark, sf_dir):
    return O.confidence_gate(P.predictions(spark, sf_dir), 0.7).groupBy("gated").agg(F.count("*").alias("n"))


@query(
    "scaling_projection",
    f"""{_WITH}, {_PROFILE_SQL}, r AS (SELECT top3_hit_rate AS v, row_number() OVER (ORDER BY top3_hit_rate DESC, sign) AS r FROM profiles),
m AS (SELECT size, avg(v) AS top3 FROM r JOIN (VALUES (5), (10), (15), (20)) s(size) ON r <= size GROUP BY size),
f AS (SELECT regr_slope(top3, ln(size)) AS b, regr_intercept(top3, ln(size)) AS a FROM m)
SELECT size, round(top3, 6) AS top3, false AS projected FROM m
UNION ALL SELECT size, round(least(greatest(a + b * ln(size), 0), 100), 6), true FROM f, (VALUES (50), (100), (200)) s(size)""",
)
def scaling_projection(spark, sf_dir):
    return rounded(O.scaling_projection(_profiles(spark, sf_dir)), "top3")


_SWEEP_SQL = f"""sweep AS (SELECT aug_id AS n, true_gloss AS sign, avg({_RIGHT}) >= 0.8 AS passes FROM predictions GROUP BY 1, 2)"""


def _sweeps(spark, sf_dir):
    each = P.predictions(spark, sf_dir).groupBy(F.col("aug_id").alias("n"), F.col("true_gloss").alias("sign"))
    return O.scaling_analysis(each.agg((O.rate(O.correct()) >= 0.8).alias("passes")), (30.0, 50.0, 70.0))


@query(
    "scaling_targets",
    f"""{_WITH}, {_SWEEP_SQL}, r AS (SELECT n, avg(CAST(passes AS INT)) * 100 AS p FROM sweep GROUP BY 1)
SELECT target, max(n) FILTER (p >= target) AS max_above, min(n) FILTER (p < target) AS min_below
FROM r, (VALUES (30.0::DOUBLE), (50.0::DOUBLE), (70.0::DOUBLE)) t(target) GROUP BY 1""",
)
def scaling_targets(spark, sf_dir):
    return _sweeps(spark, sf_dir)[0]


@query("chronic_failures", f"{_WITH}, {_SWEEP_SQL} SELECT sign, count(*) AS failures FROM sweep WHERE NOT passes GROUP BY 1 HAVING count(*) >= 2")
def chronic_failures(spark, sf_dir):
    return _sweeps(spark, sf_dir)[1]


@query(
    "worst_best",
    f"""{_WITH}, a AS (SELECT true_gloss, avg({_RIGHT}) AS accuracy FROM predictions GROUP BY 1)
SELECT true_gloss, round(accuracy, 6) AS accuracy, side FROM (
  (SELECT *, 'worst' AS side FROM a ORDER BY accuracy, true_gloss LIMIT 5) UNION ALL (SELECT *, 'best' FROM a ORDER BY accuracy DESC, true_gloss LIMIT 5))""",
)
def worst_best(spark, sf_dir):
    report = P.predictions(spark, sf_dir).groupBy("true_gloss").agg(O.rate(O.correct()).alias("accuracy"))
    return rounded(O.worst_best(report, 5), "accuracy")
