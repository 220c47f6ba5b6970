"""Queries for plug-in functions, version comparison, sets and labels."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossmill.functions import bleu as B
from glossmill.functions import vectors as V
from glossmill.operators import evalreport as E
from glossmill.operators import extras as X
from glossmill.operators import landmarks as L
from glossmill.operators import profiles as PR
from glossmill.plans import proxies as P
from glossmill.plans.q_eval import rounded
from glossmill.plans.registry import query

_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2"


@query(
    "compare_versions",
    f"""WITH e AS (SELECT o_orderkey, o_totalprice * 0.9 AS a_base, o_totalprice + o_custkey % 5000 * 10 - 20000 AS a_model, CAST(o_custkey AS DOUBLE) AS b_base, o_custkey + o_orderkey % 100 - 40.0::DOUBLE AS b_model FROM orders),
r AS (SELECT {_RANK.format("a_model")} AS ra, {_RANK.format("b_model")} AS rb FROM e)
SELECT count(*) AS n, round(avg(a_model - a_base) / stddev_samp(a_model - a_base), 6) AS d_a, round(avg(b_model - b_base) / stddev_samp(b_model - b_base), 6) AS d_b,
count(*) FILTER ((a_model > a_base) <> (b_model > b_base)) AS disagreements, round((SELECT corr(ra, rb) FROM r), 6) AS rank_correlation FROM e""",
)
def compare_versions(spark, sf_dir):
    rows = P.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS entry_id", "o_totalprice * 0.9D AS a_base", "o_totalprice + o_custkey % 5000 * 10 - 20000 AS a_model",
        "CAST(o_custkey AS DOUBLE) AS b_base", "o_custkey + o_orderkey % 100 - 40.0D AS b_model",
    )
    return rounded(X.compare_versions(rows), "d_a", "d_b", "rank_correlation")


def _halves(spark, sf_dir):
    """Brands with types, of small and of large parts."""
    part = P.table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_brand", "p_type").alias("gloss"), (F.col("p_size") <= 25).alias("small"))
    return part.where("small"), part.where("NOT small")


@query("union_glosses", "SELECT DISTINCT concat(p_brand, ' ', p_type) AS gloss FROM part ORDER BY 1")
def union_glosses(spark, sf_dir):
    return X.union_glosses(*_halves(spark, sf_dir))


@query("shared_glosses", "SELECT concat(p_brand, ' ', p_type) AS gloss FROM part WHERE p_size <= 25 INTERSECT SELECT concat(p_brand, ' ', p_type) FROM part WHERE p_size > 25")
def shared_glosses(spark, sf_dir):
    return X.shared_glosses(*_halves(spark, sf_dir))


@query(
    "motion_complexity",
    f"""WITH {P.MOTION_SQL}, m AS (SELECT clip_id, abs(v - lag(v) OVER (PARTITION BY clip_id ORDER BY frame_idx)) AS move FROM motion),
s AS (SELECT clip_id, stddev_pop(move) AS spread FROM m GROUP BY 1 HAVING stddev_pop(move) IS NOT NULL), b AS (SELECT quantile_cont(spread, 0.33) AS lo, quantile_cont(spread, 0.66) AS hi FROM s)
SELECT CASE WHEN spread <= lo THEN 'low' WHEN spread <= hi THEN 'medium' ELSE 'high' END AS complexity, count(*) AS clips, round(avg(CAST(clip_id % 3 > 0 AS INT)), 6) AS accuracy, round(avg(spread), 6) AS spread FROM s, b GROUP BY 1""",
)
def motion_complexity(spark, sf_dir):
    rows = P.motion(spark, sf_dir)
    step = F.abs(F.col("v") - F.lag("v").over(Window.partitionBy("clip_id").orderBy("frame_idx")))
    right = rows.select("clip_id", (F.col("clip_id") % 3 > 0).alias("correct")).distinct()
    return rounded(PR.motion_complexity(rows.withColumn("move", step), right), "accuracy", "spread")


@query(
    "average_features_mixed",
    """WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2), m AS (SELECT c_nationkey, c_mktsegment FROM c QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) = 1)
SELECT c_nationkey, round(avg(c_acctbal), 6) AS c_acctbal, min(m.c_mktsegment) AS c_mktsegment FROM customer JOIN m USING (c_nationkey) GROUP BY 1""",
)
def average_features_mixed(spark, sf_dir):
    rows = P.table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal", "c_mktsegment")
    return rounded(X.average_features_mixed(rows, "c_nationkey"), "c_acctbal")


@query("user_scorer", "SELECT conv_id, turn, CASE WHEN length(text) > 300 THEN CAST(length(text) AS DOUBLE) ELSE 0.5 END AS score FROM conversations")
def user_scorer(spark, sf_dir):
    """A user's scorer that gives nothing for short texts, and a fallback."""
    score = E.scorer(lambda s: s.str.len().where(s.str.len() > 300), lambda s: s.str.len() * 0.0 + 0.5)
    return P.table(spark, sf_dir, "conversations").select("conv_id", "turn", score(F.col("text")).alias("score"))


@query(
    "user_predictor",
    f"""WITH {P.FRAMES_SQL}, s AS (SELECT clip_id, avg(kp[1][1]) AS a, avg(kp[2][1]) AS b, avg(kp[3][1]) AS c FROM frames GROUP BY 1)
SELECT clip_id, CASE WHEN a >= b AND a >= c THEN 'G0' WHEN b >= c THEN 'G1' ELSE 'G2' END AS gloss FROM s""",
)
def user_predictor(spark, sf_dir):
    """A user's model, here the mean of x of three points, and the best class of its scores."""
    scores = X.predict(L.clip_arrays(P.frames(spark, sf_dir)), lambda clip: clip[:, :3, 0].mean(0))
    best = V.top_k(F.col("scores"), F.array(*map(F.lit, ("G0", "G1", "G2"))), 1)
    return scores.select("clip_id", best[0]["gloss"].alias("gloss"))


@query(
    "gloss_usage",
    """SELECT user_id, CAST(count(*) AS BIGINT) AS pending, count(*) FILTER (event_type IN ('click', 'view')) AS used FROM events GROUP BY 1""",
)
def gloss_usage(spark, sf_dir):
    pending = P.table(spark, sf_dir, "events").select("user_id", F.array("event_type").alias("glosses"))
    marked = E.gloss_usage(pending.withColumn("selections", F.array(F.lit("CLICK"), F.lit("View"))))
    used = F.size(F.filter("usage", lambda u: u["used"]))
    return marked.groupBy("user_id").agg(F.sum(F.size("usage").cast("long")).alias("pending"), F.sum(used.cast("long")).alias("used"))


@query(
    "severity",
    f"""WITH {P.PREDICTIONS_SQL}, e AS (SELECT true_gloss, 1 - avg(CAST(g1 = true_gloss AS INT)) AS errors FROM predictions GROUP BY 1)
SELECT true_gloss, round(errors, 6) AS errors, CASE WHEN errors >= 0.5 THEN 'critical' WHEN errors >= 0.25 THEN 'high' WHEN errors >= 0.2 THEN 'medium' ELSE 'low' END AS severity FROM e""",
)
def severity(spark, sf_dir):
    errors = P.predictions(spark, sf_dir).groupBy("true_gloss").agg((1 - PR.rate(PR.correct())).alias("errors"))
    return rounded(errors.withColumn("severity", PR.severity(F.col("errors"), (0.5, 0.25, 0.2))), "errors")


@query(
    "bleu",
    f"""WITH {P.ENTRIES_SQL}, said AS (
  SELECT entry_id, [x for x in regexp_split_to_array(trim(lower(regexp_replace(output, '[!-/:-@\\[-`{{-~]', '', 'g'))), '\\s+') if x <> ''] AS o,
         [x for x in regexp_split_to_array(trim(lower(regexp_replace(reference, '[!-/:-@\\[-`{{-~]', '', 'g'))), '\\s+') if x <> ''] AS r
  FROM entries WHERE output IS NOT NULL AND reference IS NOT NULL
), orders AS (SELECT entry_id, n, len(o) - n + 1 AS total FROM said, range(1, 5) t(n) WHERE len(o) >= n),
grams AS (
  SELECT entry_id, n, side, gram, count(*) AS c FROM (
    SELECT entry_id, n, 'o' AS side, unnest([array_to_string(o[k:k + n - 1], ' ') for k in range(1, len(o) - n + 2)]) AS gram FROM said, range(1, 5) t(n)
    UNION ALL SELECT entry_id, n, 'r', unnest([array_to_string(r[k:k + n - 1], ' ') for k in range(1, len(r) - n + 2)]) FROM said, range(1, 5) t(n)
  ) GROUP BY ALL
), matched AS (
  SELECT a.entry_id, a.n, sum(least(a.c, b.c)) AS m FROM grams a JOIN grams b ON a.entry_id = b.entry_id AND a.n = b.n AND a.gram = b.gram
  WHERE a.side = 'o' AND b.side = 'r' GROUP BY 1, 2
), logs AS (
  SELECT entry_id, m, CASE WHEN m > 0 THEN ln(m / total)
           ELSE -ln(total * 2::DOUBLE ** count(*) FILTER (m IS NULL) OVER (PARTITION BY entry_id ORDER BY n ROWS UNBOUNDED PRECEDING)) END AS precision
  FROM orders LEFT JOIN matched USING (entry_id, n)
), scores AS (SELECT entry_id, max(m) AS m, exp(avg(precision)) AS score FROM logs GROUP BY 1)
SELECT entry_id, round(CASE WHEN m > 0 THEN 100 * exp(least(0, 1 - len(r) / len(o))) * score WHEN output IS NOT NULL AND reference IS NOT NULL THEN 0 END, 6) AS bleu
FROM entries LEFT JOIN said USING (entry_id) LEFT JOIN scores USING (entry_id)""",
)
def bleu(spark, sf_dir):
    return rounded(P.entries(spark, sf_dir).select("entry_id", B.bleu(F.col("output"), F.col("reference")).alias("bleu")), "bleu")
