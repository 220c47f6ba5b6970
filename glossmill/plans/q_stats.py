"""Queries for paired statistics, correlations, ratings and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossmill.operators import profiles as PR
from glossmill.operators import statistics as S
from glossmill.plans import proxies as P
from glossmill.plans.q_eval import METRICS_SQL, _metrics, rounded
from glossmill.plans.registry import query

_WITH = f"WITH {P.SCORES_SQL}"
_PAIR = """d AS (SELECT *, model - baseline AS d FROM scores), g AS (SELECT metric, count(*) AS n, avg(baseline) AS mean_baseline, avg(model) AS mean_model, avg(d) AS mean_diff, stddev_samp(d) AS sd_diff,
  count(*) FILTER (d > 0) AS improved FROM d GROUP BY 1), pair AS (SELECT *, mean_diff / (sd_diff / sqrt(n)) AS t, mean_diff / sd_diff AS cohens_d FROM g)"""
_PAIR_COLS = ("mean_baseline", "mean_model", "mean_diff", "sd_diff", "t", "cohens_d", "ci_low", "ci_high")


@query(
    "paired_stats",
    f"""{_WITH}, {_PAIR} SELECT metric, n, improved, round(mean_baseline, 3) AS mean_baseline, round(mean_model, 3) AS mean_model, round(mean_diff, 3) AS mean_diff, round(sd_diff, 3) AS sd_diff,
round(t, 3) AS t, round(cohens_d, 3) AS cohens_d, round(mean_diff - 1.96 * sd_diff / sqrt(n), 3) AS ci_low, round(mean_diff + 1.96 * sd_diff / sqrt(n), 3) AS ci_high,
CASE WHEN abs(cohens_d) < 0.2 THEN 'negligible' WHEN abs(cohens_d) < 0.5 THEN 'small' WHEN abs(cohens_d) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM pair""",
)
def paired_stats(spark, sf_dir):
    return S.paired_stats(P.scores(spark, sf_dir)).withColumns({c: F.round(c, 3) for c in _PAIR_COLS})


_RANK = "rank() OVER (PARTITION BY {0} ORDER BY {1}) + (count(*) OVER (PARTITION BY {0}, {1}) - 1) / 2"


@query(
    "wilcoxon",
    f"""{_WITH}, d AS (SELECT metric, round(model - baseline, 2) AS d FROM scores WHERE round(model - baseline, 2) <> 0), a AS (SELECT metric, d, abs(d) AS s FROM d),
r AS (SELECT metric, d, {_RANK.format("metric", "s")} AS r FROM a), t AS (SELECT metric, sum(c * c * c - c) AS ties FROM (SELECT metric, s, count(*) AS c FROM a GROUP BY 1, 2) GROUP BY 1)
SELECT metric, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus, CAST(min(ties) AS BIGINT) AS ties,
least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w FROM r JOIN t USING (metric) GROUP BY 1""",
)
def wilcoxon(spark, sf_dir):
    return S.wilcoxon(_cents(spark, sf_dir))


def _cents(spark, sf_dir):
    """Differences in cents, so that equal ones are equal; half cents go as in the SQL, by the binary product with 100."""
    cents = F.round((F.col("model") - F.col("baseline")) * 100) / 100
    return P.scores(spark, sf_dir).select("metric", cents.alias("model"), F.lit(0.0).alias("baseline"))


@query("p_values", None)
def p_values(spark, sf_dir):
    return S.p_values(_cents(spark, sf_dir))


@query(
    "one_sample_t",
    """WITH v AS (SELECT event_type AS metric, value - 50 AS v FROM events), s AS (SELECT metric, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd FROM v GROUP BY 1),
t AS (SELECT metric, n, mean, mean / (sd / sqrt(n)) AS t, n - 1 AS df FROM s),
x AS (SELECT metric, sum((CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * (1 + (t * i / 4000) ** 2 / df) ** (-(df + 1) / 2::DOUBLE)) * abs(t) / 12000 * exp(lgamma((df + 1) / 2::DOUBLE) - lgamma(df / 2::DOUBLE)) / sqrt(df * pi()) AS half FROM t, range(4001) r(i) GROUP BY metric, t, df)
SELECT metric, n, round(mean, 6) AS mean, round(t, 6) AS t, round(1 - 2 * half, 6) AS p FROM t JOIN x USING (metric)""",
)
def one_sample_t(spark, sf_dir):
    rows = P.table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), (F.col("value") - 50).alias("value"))
    return rounded(S.one_sample_t(rows), "mean", "t", "p")


@query(
    "mcnemar",
    """WITH c AS (SELECT o_orderpriority AS metric, o_totalprice > 200000 AS a, o_custkey % 3 = 0 AS b FROM orders),
s AS (SELECT metric, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b FROM c GROUP BY 1),
t AS (SELECT metric, only_a, only_b, least(only_a, only_b) AS k, only_a + only_b AS n FROM s),
x AS (SELECT metric, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) AS tail FROM (SELECT metric, n, unnest(range(k + 1)) AS i FROM t) GROUP BY 1)
SELECT metric, only_a, only_b, round(least(1, 2 * tail), 6) AS p FROM t JOIN x USING (metric)""",
)
def mcnemar(spark, sf_dir):
    pairs = P.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("metric"), (F.col("o_totalprice") > 200000).alias("a"), (F.col("o_custkey") % 3 == 0).alias("b"))
    return rounded(S.mcnemar(pairs), "p")


@query("power_sample_size", f"{_WITH}, {_PAIR} SELECT metric, CAST(ceil((2.801585218 * sd_diff / mean_diff) ** 2) AS BIGINT) AS needed FROM pair")
def power_sample_size(spark, sf_dir):
    return S.power_sample_size(S.paired_stats(P.scores(spark, sf_dir))).select("metric", "needed")


_COR_SQL = "c AS (SELECT o_orderkey, o_totalprice AS human, o_custkey AS a, o_totalprice * (o_custkey % 7) AS b FROM orders)"


def _cor(spark, sf_dir):
    return P.table(spark, sf_dir, "orders").select(
        F.col("o_totalprice").alias("human"), F.col("o_custkey").cast("double").alias("a"), (F.col("o_totalprice") * (F.col("o_custkey") % 7)).alias("b")
    )


@query(
    "correlations",
    f"""WITH {_COR_SQL}, l AS (SELECT 'a' AS metric, human, CAST(a AS DOUBLE) AS score FROM c UNION ALL SELECT 'b', human, b FROM c),
r AS (SELECT *, {_RANK.format("metric", "score")} AS ra, {_RANK.format("metric", "human")} AS rb FROM l)
SELECT metric, round(corr(human, score), 6) AS pearson, round(corr(ra, rb), 6) AS spearman,
CASE WHEN abs(corr(human, score)) >= 0.9 THEN 'very strong' WHEN abs(corr(human, score)) >= 0.7 THEN 'strong' WHEN abs(corr(human, score)) >= 0.5 THEN 'moderate' WHEN abs(corr(human, score)) >= 0.3 THEN 'weak' ELSE 'none' END AS strength FROM r GROUP BY 1""",
)
def correlations(spark, sf_dir):
    return rounded(S.correlations(_cor(spark, sf_dir), "human", ["a", "b"]), "pearson", "spearman")


@query("average_rank", f"SELECT c_custkey, {_RANK.format('c_nationkey', 'c_acctbal')} AS rank FROM customer")
def average_rank(spark, sf_dir):
    rows = P.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return S.average_rank(rows, "c_acctbal", ["c_nationkey"]).select("c_custkey", "rank")


_RT = f"WITH {P.RATINGS_SQL}"


@query("human_scores", f"{_RT} SELECT sentence_id, round(avg(rating), 6) AS human, round(avg(rating) * 20, 6) AS human_100 FROM ratings GROUP BY 1")
def human_scores(spark, sf_dir):
    return rounded(S.human_scores(P.ratings(spark, sf_dir)), "human", "human_100")


@query("rater_summary", f"{_RT} SELECT rater, count(*) AS n, round(avg(rating), 6) AS mean, quantile_cont(rating, 0.25) AS q25, quantile_cont(rating, 0.5) AS q50, quantile_cont(rating, 0.75) AS q75 FROM ratings GROUP BY 1")
def rater_summary(spark, sf_dir):
    return rounded(S.rater_summary(P.ratings(spark, sf_dir)), "mean")


_ONCE = "o AS (SELECT rater, sentence_id, avg(rating) AS r FROM ratings GROUP BY 1, 2)"


@query(
    "rater_agreement",
    f"{_RT}, {_ONCE} SELECT x.rater AS a, y.rater AS b, count(*) AS sentences, round(avg(CAST(abs(x.r - y.r) < 0.5 AS INT)), 6) AS exact, round(avg(CAST(abs(x.r - y.r) <= 1 AS INT)), 6) AS within_one FROM o x JOIN o y ON x.sentence_id = y.sentence_id AND x.rater < y.rater GROUP BY 1, 2",
)
def rater_agreement(spark, sf_dir):
    return rounded(S.rater_agreement(P.ratings(spark, sf_dir)), "exact", "within_one")


@query(
    "icc",
    f"""{_RT}, {_ONCE}, kk AS (SELECT count(DISTINCT rater) AS k FROM o), f AS (SELECT * FROM o WHERE sentence_id IN (SELECT sentence_id FROM o GROUP BY 1 HAVING count(*) = (SELECT k FROM kk))),
t AS (SELECT sum(r) AS s, sum(r * r) AS ss, count(DISTINCT rater) AS k, count(DISTINCT sentence_id) AS n FROM f),
u AS (SELECT t.*, (SELECT sum(x * x) FROM (SELECT sum(r) AS x FROM f GROUP BY sentence_id)) / k - s * s / (k * n) AS ssr, (SELECT sum(x * x) FROM (SELECT sum(r) AS x FROM f GROUP BY rater)) / n - s * s / (k * n) AS ssc FROM t),
v AS (SELECT *, ssr / (n - 1) AS msr, ssc / (k - 1) AS msc, (ss - s * s / (k * n) - ssr - ssc) / ((n - 1) * (k - 1)) AS mse FROM u)
SELECT n AS sentences, k AS raters, round((msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n), 6) AS icc FROM v""",
)
def icc(spark, sf_dir):
    return rounded(S.icc(P.ratings(spark, sf_dir)), "icc")


def _components(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    return m.select("entry_id", F.col("recall").alias("ga"), F.col("f1").alias("cf1"), F.col("plausibility").cast("double").alias("p"), (F.col("precision") * 0.7 + F.col("plausibility") * 0.3).alias("human"))


_COMP = METRICS_SQL + ", comp AS (SELECT entry_id, recall AS ga, f1 AS cf1, CAST(plausibility AS DOUBLE) AS p, precision * 0.7 + plausibility * 0.3 AS human FROM f)"
_V3 = "ga / 100 * (cf1 / 100) * ({0} + (1 - {0}) * (p / 100) * (ga / 100)) * 100"
_V2 = "ga / 100 * (cf1 / 100) * (0.5 + 0.5 * (p / 100)) * 100"


@query("alpha_sweep", f"{_COMP}, g AS (SELECT comp.*, i * 0.05::DOUBLE AS alpha FROM comp, range(21) t(i)) SELECT round(alpha, 6) AS alpha, round(corr({_V3.format('alpha')}, human), 6) AS pearson FROM g GROUP BY 1")
def alpha_sweep(spark, sf_dir):
    return rounded(S.alpha_sweep(_components(spark, sf_dir), "human", 0.05), "alpha", "pearson")


@query(
    "formula_grid",
    f"""{_COMP}, l AS (SELECT human, 'product' AS formula, ga * cf1 / 100 AS score FROM comp UNION ALL SELECT human, 'mean', (ga + cf1 + p) / 3 FROM comp UNION ALL SELECT human, 'v2', {_V2} FROM comp UNION ALL SELECT human, 'v3', {_V3.format("0.5")} FROM comp),
c AS (SELECT formula, corr(human, score) AS pearson FROM l GROUP BY 1) SELECT formula, round(pearson, 6) AS pearson, row_number() OVER (ORDER BY round(pearson, 9) DESC, formula) AS rank FROM c""",
)
def formula_grid(spark, sf_dir):
    from glossmill.functions import text as T

    ga, cf1, p = F.col("ga"), F.col("cf1"), F.col("p")
    formulas = {"product": ga * cf1 / 100, "mean": (ga + cf1 + p) / 3, "v2": T.ctqi_v2(ga, cf1, p), "v3": T.ctqi_v3(ga, cf1, p)}
    return rounded(S.formula_grid(_components(spark, sf_dir), "human", formulas), "pearson")


@query(
    "divergence",
    f"""{_COMP}, e AS (SELECT *, (ga + cf1 + p) / 3 - human AS e1, {_V2} - human AS e2 FROM comp)
SELECT CASE WHEN abs(e1) < abs(e2) THEN 'v1' WHEN abs(e2) < abs(e1) THEN 'v2' ELSE 'tie' END AS nearer, CASE WHEN ga = least(ga, cf1, p) THEN 'ga' WHEN cf1 = least(ga, cf1, p) THEN 'cf1' ELSE 'p' END AS weak_link,
CASE WHEN e2 > 10 THEN 'over' WHEN e2 < -10 THEN 'under' ELSE 'near' END AS side, count(*) AS n, round(avg(e2), 6) AS avg_residual FROM e GROUP BY 1, 2, 3""",
)
def divergence(spark, sf_dir):
    from glossmill.functions import text as T

    c = _components(spark, sf_dir)
    ga, cf1, p = F.col("ga"), F.col("cf1"), F.col("p")
    return rounded(S.divergence(c.withColumn("v1", (ga + cf1 + p) / 3).withColumn("v2", T.ctqi_v2(ga, cf1, p))), "avg_residual")


_BAND = "CASE WHEN baseline < 20000 THEN 'low' WHEN baseline < 60000 THEN 'middle' ELSE 'high' END"


@query(
    "band_significance",
    f"""{_WITH}, b AS (SELECT {_BAND} AS band, count(*) AS n, avg(model - baseline) AS mean_diff, stddev_samp(model - baseline) AS sd, stddev_samp(baseline) AS sdb FROM scores GROUP BY 1 HAVING count(*) >= 2)
SELECT band, n, round(mean_diff, 3) AS mean_diff, round(mean_diff / (sd / sqrt(n)), 3) AS t, round(mean_diff / sdb, 6) AS d FROM b""",
)
def band_significance(spark, sf_dir):
    out = S.band_stats(P.scores(spark, sf_dir), F.expr(_BAND))
    return out.withColumns({"mean_diff": F.round("mean_diff", 3), "t": F.round("t", 3), "d": F.round("d", 6)})


@query(
    "threshold_sweep",
    """WITH r AS (SELECT CAST(l_quantity AS DOUBLE) AS x, l_extendedprice AS value, CAST(t AS DOUBLE) AS threshold FROM lineitem, range(5, 50, 5) g(t))
SELECT threshold, count(*) FILTER (x >= threshold) AS n_above, round(avg(value) FILTER (x >= threshold), 3) AS above, count(*) FILTER (x < threshold) AS n_below, round(avg(value) FILTER (x < threshold), 3) AS below,
count(*) FILTER (x >= threshold AND x < threshold + 10) AS n_bin, round(avg(value) FILTER (x >= threshold AND x < threshold + 10), 3) AS in_bin FROM r GROUP BY 1 HAVING count(*) FILTER (x >= threshold) >= 3 AND count(*) FILTER (x < threshold) >= 3""",
)
def threshold_sweep(spark, sf_dir):
    rows = P.table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("value"))
    return S.threshold_sweep(rows, [float(t) for t in range(5, 50, 5)]).withColumns({c: F.round(c, 3) for c in ("above", "below", "in_bin")})


@query(
    "threshold_buckets",
    f"""WITH {P.PREDICTIONS_SQL}, v AS (SELECT video_id, avg(CAST(true_gloss IN (g1, g2, g3) AS INT)) * 100 AS acc, avg(c1) AS model, avg(c2) AS baseline FROM predictions GROUP BY 1),
b AS (SELECT CASE WHEN acc < 50 THEN '<50' WHEN acc < 75 THEN '50-74' WHEN acc < 100 THEN '75-99' ELSE '100' END AS band, * FROM v)
SELECT band, count(*) AS n, round(avg(model - baseline), 6) AS mean_diff FROM b GROUP BY 1""",
)
def threshold_buckets(spark, sf_dir):
    per = P.predictions(spark, sf_dir).groupBy("video_id").agg(
        (PR.rate(PR.hit(3)) * 100).alias("acc"), F.avg(PR.confidence()).alias("model"), F.avg(F.col("top_k")[1]["confidence"]).alias("baseline")
    )
    acc = F.col("acc")
    band = F.when(acc < 50, "<50").when(acc < 75, "50-74").when(acc < 100, "75-99").otherwise("100")
    return rounded(S.band_stats(per, band, least=1).select("band", "n", "mean_diff"), "mean_diff")


@query(
    "ablation",
    f"""{_COMP}, r AS (SELECT entry_id, (ga + cf1 + p) / 3 - (human + cf1 + p / 2) / 3 AS f, (cf1 + p) / 2 - (cf1 + p / 2) / 2 AS a, (ga + p) / 2 - (human + p / 2) / 2 AS b, (ga + cf1) / 2 - (human + cf1) / 2 AS c FROM comp),
d AS (SELECT avg(f) / stddev_samp(f) AS f, avg(a) / stddev_samp(a) AS a, avg(b) / stddev_samp(b) AS b, avg(c) / stddev_samp(c) AS c FROM r)
SELECT 'full' AS variant, round(f, 6) AS cohens_d, 0.0 AS loss FROM d UNION ALL SELECT 'without_ga', round(a, 6), round(f - a, 6) FROM d UNION ALL SELECT 'without_cf1', round(b, 6), round(f - b, 6) FROM d UNION ALL SELECT 'without_p', round(c, 6), round(f - c, 6) FROM d""",
)
def ablation(spark, sf_dir):
    c = _components(spark, sf_dir)
    model = c.select("entry_id", F.lit("model").alias("run"), "ga", "cf1", "p")
    base = c.select("entry_id", F.lit("baseline").alias("run"), F.col("human").alias("ga"), "cf1", (F.col("p") / 2).alias("p"))
    return rounded(S.ablation(model.unionByName(base), ["ga", "cf1", "p"]), "cohens_d", "loss")


@query("pca_weights", None)
def pca_weights(spark, sf_dir):
    return spark.createDataFrame(S.pca_weights(_components(spark, sf_dir), ["ga", "cf1", "p", "human"]))


@query("bootstrap_bca", None)
def bootstrap_bca(spark, sf_dir):
    supplier = P.table(spark, sf_dir, "supplier").join(P.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return S.bootstrap_bca(supplier.select(F.col("n_regionkey").cast("string").alias("metric"), F.col("s_acctbal").alias("value"), F.col("s_suppkey").alias("id")), 1000)


@query("bleu_failures", f"{_COMP} SELECT entry_id, round(cf1 - human, 6) AS error, CASE WHEN cf1 - human < -30 THEN 'valid wording punished' WHEN cf1 - human > 30 THEN 'overlap without meaning' ELSE 'moderate' END AS reason FROM comp ORDER BY abs(cf1 - human) DESC, entry_id LIMIT 6")
def bleu_failures(spark, sf_dir):
    c = _components(spark, sf_dir).select("entry_id", F.col("cf1").alias("bleu"), "human")
    return rounded(S.bleu_failures(c), "error").select("entry_id", "error", "reason")


@query(
    "accuracy_bands",
    f"""WITH {P.PREDICTIONS_SQL}, s AS (SELECT true_gloss, avg(CAST(true_gloss IN (g1, g2, g3) AS INT)) * 100 AS top3 FROM predictions WHERE true_gloss <> 'G07' GROUP BY 1),
e AS (SELECT video_id, avg(coalesce(top3, 50)) AS m FROM predictions LEFT JOIN s USING (true_gloss) GROUP BY 1),
b(band, lo, hi) AS (VALUES ('0-70', 0, 70), ('70-80', 70, 80), ('80-85', 80, 85), ('85-90', 85, 90), ('90-100', 90, 101))
SELECT band, count(m) AS n, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS std FROM b LEFT JOIN e ON m >= lo AND m < hi GROUP BY 1""",
)
def accuracy_bands(spark, sf_dir):
    from glossmill.operators.vocab import accuracy_bands as bands

    every = P.predictions(spark, sf_dir)
    profiles = PR.sign_profiles(every.where("true_gloss != 'G07'"))
    return rounded(bands(every.select(F.col("video_id").alias("sentence_id"), F.col("true_gloss").alias("sign")), profiles), "mean", "std")


_PERCENTS = (0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0)


@query(
    "percentiles",
    "SELECT l_returnflag, count(*) AS n, " + ", ".join(f"round(quantile_cont(CAST(l_extendedprice AS DOUBLE), {p}), 6) AS p{round(p * 100)}" for p in _PERCENTS) + " FROM lineitem GROUP BY 1",
)
def percentiles(spark, sf_dir):
    out = S.percentiles(P.table(spark, sf_dir, "lineitem"), "l_extendedprice", list(_PERCENTS), ["l_returnflag"])
    names = [f"p{round(p * 100)}" for p in _PERCENTS]
    return rounded(out.select("l_returnflag", "n", *[F.col("percentiles")[i].alias(c) for i, c in enumerate(names)]), *names)
