"""Queries for class vectors, distances and the choice of vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossmill.functions import vectors as V
from glossmill.operators import vocab as O
from glossmill.plans import proxies as P
from glossmill.plans.q_eval import rounded
from glossmill.plans.registry import query

_NAME = "concat('C', label, '_', vec_id % 3)"
_CENT = f"""e AS (SELECT {_NAME} AS gloss, vec_id // 16 AS clip_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
c AS (SELECT gloss, clip_id, dim, avg(x) AS x FROM e GROUP BY 1, 2, 3), m AS (SELECT gloss, dim, avg(x) AS x, count(*) AS n FROM c GROUP BY 1, 2),
cents AS (SELECT gloss, min(n) AS clips, list(x ORDER BY dim) AS vec FROM m GROUP BY 1),
dist AS (SELECT p.gloss AS a, q.gloss AS b, 1 - list_cosine_similarity(p.vec, q.vec) AS distance FROM cents p JOIN cents q ON p.gloss < q.gloss)"""


def _centroids(spark, sf_dir):
    rows = P.table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("C"), "label", F.lit("_"), F.col("vec_id") % 3).alias("gloss"), F.expr("vec_id div 16").alias("clip_id"), (F.col("vec_id") % 16).alias("frame_idx"), F.col("embedding").alias("vec")
    )
    return O.gloss_centroids(rows)


@query("gloss_centroids", f"WITH {_CENT} SELECT gloss, clips, round(list_sum(vec), 6) AS s, round(vec[1], 6) AS first, round(vec[64], 6) AS last FROM cents")
def gloss_centroids(spark, sf_dir):
    c = _centroids(spark, sf_dir)
    return rounded(c.select("gloss", "clips", V.total(F.col("vec")).alias("s"), F.col("vec")[0].alias("first"), F.col("vec")[63].alias("last")), "s", "first", "last")


@query("pairwise_cosine", f"WITH {_CENT} SELECT a, b, round(distance, 6) AS distance FROM dist")
def pairwise_cosine(spark, sf_dir):
    return rounded(O.pairwise_distance(_centroids(spark, sf_dir), blocks=3), "distance")


@query("pairwise_euclidean", f"WITH {_CENT} SELECT p.gloss AS a, q.gloss AS b, round(list_distance(p.vec, q.vec), 6) AS distance FROM cents p JOIN cents q ON p.gloss < q.gloss")
def pairwise_euclidean(spark, sf_dir):
    return rounded(O.pairwise_distance(_centroids(spark, sf_dir), "euclidean", blocks=2), "distance")


@query(
    "pairwise_weighted",
    f"""WITH {_CENT}, u AS (SELECT gloss, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM cents), z AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM u GROUP BY 1),
v AS (SELECT gloss, list((x - m) / CASE WHEN s < 1e-6 THEN 1 ELSE s END * CASE WHEN i BETWEEN 31 AND 60 THEN 2 ELSE 1 END ORDER BY i) AS vec FROM u JOIN z USING (i) GROUP BY 1)
SELECT p.gloss AS a, q.gloss AS b, round(list_distance(p.vec, q.vec), 6) AS distance FROM v p JOIN v q ON p.gloss < q.gloss""",
)
def pairwise_weighted(spark, sf_dir):
    return rounded(O.pairwise_distance(O.standardized(_centroids(spark, sf_dir), (30, 60)), "euclidean", blocks=2), "distance")


@query(
    "nearest_classes",
    f"""WITH {_CENT}, d AS (SELECT p.gloss, q.gloss AS other, list_distance(p.vec, q.vec) AS distance FROM cents p JOIN cents q ON p.gloss <> q.gloss),
r AS (SELECT *, row_number() OVER (PARTITION BY gloss ORDER BY round(distance, 9), other) AS rank FROM d)
SELECT gloss, CAST(rank AS INT) AS rank, other, round(distance, 6) AS distance FROM r WHERE rank <= 5""",
)
def nearest_classes(spark, sf_dir):
    return rounded(O.nearest_classes(_centroids(spark, sf_dir), 5, cells=4), "distance")


_SOFT = """s AS (SELECT vec_id, label, [CAST(x AS DOUBLE) * 20 for x in embedding] AS z FROM embeddings), x AS (SELECT *, [exp(v - list_max(z)) for v in z] AS e FROM s),
soft AS (SELECT vec_id, label, [v / list_sum(e) for v in e] AS p FROM x)"""


def _soft(spark, sf_dir):
    scores = F.transform("embedding", lambda x: x.cast("double") * 20)
    return P.table(spark, sf_dir, "embeddings").select("vec_id", "label", V.softmax(scores).alias("p"), scores.alias("z"))


@query(
    "top_k",
    f"""WITH {_SOFT}, u AS (SELECT vec_id, unnest(p) AS v, generate_subscripts(p, 1) - 1 AS i FROM soft), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS k FROM u)
SELECT vec_id, k, CASE WHEN i < 8 THEN 'G' || i ELSE 'UNKNOWN' END AS gloss, round(v, 6) AS confidence FROM r WHERE k <= 3""",
)
def top_k(spark, sf_dir):
    names = F.array(*[F.lit(f"G{i}") for i in range(8)])
    best = _soft(spark, sf_dir).select("vec_id", F.posexplode(V.top_k(F.col("z"), names, 3)).alias("k", "c"))
    return rounded(best.select("vec_id", (F.col("k") + 1).alias("k"), "c.*"), "confidence")


@query("mask_classes", f"WITH {_SOFT}, m AS (SELECT vec_id, [CASE WHEN i IN (2, 5) THEN 0 ELSE p[i + 1] END for i in range(64)] AS q FROM soft) SELECT vec_id, round(list_max(q) / list_sum(q), 6) AS top, round(q[1] / list_sum(q), 6) AS first FROM m")
def mask_classes(spark, sf_dir):
    q = V.mask_classes(F.col("p"), [2, 5])
    return rounded(_soft(spark, sf_dir).select("vec_id", F.array_max(q).alias("top"), q[0].alias("first")), "top", "first")


@query("entropy", f"WITH {_SOFT} SELECT vec_id, round(-list_sum([v * ln(v + 1e-10) for v in p]) / ln(64), 6) AS entropy FROM soft")
def entropy(spark, sf_dir):
    return rounded(_soft(spark, sf_dir).select("vec_id", V.entropy(F.col("p")).alias("entropy")), "entropy")


@query(
    "entropy_distinctiveness",
    f"""WITH {_SOFT}, u AS (SELECT label, unnest(p) AS v, generate_subscripts(p, 1) AS i FROM soft), m AS (SELECT label, i, avg(v) AS v FROM u GROUP BY 1, 2),
h AS (SELECT label, -sum(v * ln(v + 1e-10)) / ln(count(*)) AS entropy FROM m GROUP BY 1), c AS (SELECT label, avg(list_max(p)) AS confidence FROM soft GROUP BY 1)
SELECT CAST(label AS VARCHAR) AS gloss, round(entropy, 6) AS entropy, round(confidence, 6) AS confidence, round(0.6 * entropy + 0.4 * (1 - confidence), 6) AS score FROM h JOIN c USING (label)""",
)
def entropy_distinctiveness(spark, sf_dir):
    rows = _soft(spark, sf_dir).select(F.col("label").cast("string").alias("gloss"), "p")
    return rounded(O.entropy_distinctiveness(rows), "entropy", "confidence", "score")


_RANKED = f"""{_CENT}, n AS (SELECT p.gloss, q.gloss AS other, list_cosine_similarity(p.vec, q.vec) AS sim, p.clips AS n FROM cents p JOIN cents q ON p.gloss LIKE '%_1' AND q.gloss LIKE '%_0'),
b AS (SELECT gloss, max(sim) AS similarity, arg_max(other, (round(sim, 9), other)) AS nearest, min(n) AS n FROM n GROUP BY 1),
ranked AS (SELECT *, 0.7 * (1 - similarity) + 0.3 * least(log10(n + 1) / 2, 1) AS score FROM b)"""
_ADVICE = "CASE WHEN score >= 0.6 THEN 'YES' WHEN score >= 0.4 THEN 'MAYBE' ELSE 'NO' END"


def _ranked(spark, sf_dir):
    c = _centroids(spark, sf_dir)
    return O.rank_candidates(c.where("gloss LIKE '%_1'").withColumnRenamed("clips", "n"), c.where("gloss LIKE '%_0'"))


@query("rank_candidates", f"WITH {_RANKED} SELECT gloss, nearest, n, round(similarity, 6) AS similarity, round(score, 6) AS score, {_ADVICE} AS advice FROM ranked")
def rank_candidates(spark, sf_dir):
    return rounded(_ranked(spark, sf_dir), "similarity", "score").select("gloss", "nearest", "n", "similarity", "score", "advice")


@query("select_next", f"WITH {_RANKED} SELECT gloss, round(score, 6) AS score FROM ranked WHERE {_ADVICE} <> 'NO' ORDER BY CASE WHEN {_ADVICE} = 'YES' THEN 0 ELSE 1 END, round(score, 9) DESC, gloss LIMIT 5")
def select_next(spark, sf_dir):
    return rounded(O.select_next(_ranked(spark, sf_dir), 5), "score").select("gloss", "score")


def _domains(spark, sf_dir):
    return _centroids(spark, sf_dir).select(F.substring_index("gloss", "_", -1).alias("domain"), "gloss", "vec")


_PAIRS = f"""{_CENT}, p AS (SELECT split_part(a, '_', 2) AS dom, a, b, distance AS x FROM dist WHERE split_part(a, '_', 2) = split_part(b, '_', 2)),
d AS (SELECT dom, a, b, x FROM p UNION ALL SELECT dom, b, a, x FROM p)"""


def _chain_sql(first: str, k: int) -> str:
    """Farthest points as recursion: each step takes the class whose nearest chosen one is farthest."""
    return f"""{_PAIRS}, z AS ({first}), ch AS (SELECT * FROM z
  UNION ALL SELECT dom, list_append(names, pick) FROM (SELECT dom, names, arg_min(a, (-round(near, 9), a)) AS pick FROM (
    SELECT ch.dom, ch.names, d.a, min(d.x) AS near FROM ch JOIN d ON d.dom = ch.dom AND list_contains(ch.names, d.b) AND NOT list_contains(ch.names, d.a) WHERE len(ch.names) < {k} GROUP BY 1, 2, 3) GROUP BY 1, 2)),
best AS (SELECT dom, arg_max(names, len(names)) AS names FROM ch GROUP BY 1),
picked AS (SELECT dom AS domain, unnest(names) AS gloss, generate_subscripts(names, 1) AS rank FROM best)"""


_CENTER = "SELECT dom, [arg_min(a, (round(m, 9), a))] AS names FROM (SELECT dom, a, sum(x) / count(*) AS m FROM d GROUP BY 1, 2) GROUP BY 1"
_FARTHEST = "SELECT dom, arg_min([a, b], (-round(x, 9), a, b)) AS names FROM p GROUP BY 1"


@query("farthest_point", f"WITH RECURSIVE {_chain_sql(_CENTER, 5)} SELECT domain, rank, gloss FROM picked")
def farthest_point(spark, sf_dir):
    return O.farthest_point(_domains(spark, sf_dir), 5)


@query("max_dispersion", f"WITH RECURSIVE {_chain_sql(_FARTHEST, 5)} SELECT domain, rank, gloss FROM picked")
def max_dispersion(spark, sf_dir):
    return O.farthest_point(_domains(spark, sf_dir), 5, seed="dispersion")


@query(
    "domain_lists",
    f"""WITH RECURSIVE {_chain_sql(_CENTER, 6)}, own AS (SELECT DISTINCT dom AS domain, a AS gloss FROM d),
o AS (SELECT domain, gloss, row_number() OVER (PARTITION BY domain ORDER BY CASE WHEN gloss LIKE 'C1%' THEN 0 ELSE 1 END, rank NULLS LAST, gloss) AS pos FROM own LEFT JOIN picked USING (domain, gloss) WHERE gloss NOT LIKE 'C2%')
SELECT domain, pos, gloss FROM o WHERE pos <= 5""",
)
def domain_lists(spark, sf_dir):
    d = _domains(spark, sf_dir)
    candidates = d.select("domain", "gloss")
    return O.domain_lists(candidates, O.farthest_point(d, 6), candidates.where("gloss LIKE 'C1%'"), candidates.where("gloss LIKE 'C2%'"), 5)


@query(
    "chosen_set_distances",
    f"""WITH {_CENT}, i AS (SELECT * FROM dist WHERE a LIKE '%_0' AND b LIKE '%_0') SELECT count(*) AS pairs, round(min(distance), 6) AS least, round(avg(distance), 6) AS mean, round(max(distance), 6) AS most,
arg_min(a || '/' || b, (round(distance, 9), a, b)) AS closest FROM i""",
)
def chosen_set_distances(spark, sf_dir):
    c = _centroids(spark, sf_dir)
    return rounded(O.chosen_set_distances(O.pairwise_distance(c, blocks=2), c.where("gloss LIKE '%_0'")), "least", "mean", "most")


@query(
    "expected_top3",
    f"""WITH {P.PREDICTIONS_SQL}, s AS (SELECT true_gloss, avg(CAST(true_gloss IN (g1, g2, g3) AS INT)) * 100 AS top3 FROM predictions WHERE true_gloss <> 'G07' GROUP BY 1)
SELECT video_id AS sentence_id, round(avg(coalesce(top3, 50)), 6) AS expected FROM predictions LEFT JOIN s USING (true_gloss) GROUP BY 1""",
)
def expected_top3(spark, sf_dir):
    from glossmill.operators import profiles as PR

    every = P.predictions(spark, sf_dir)
    said = every.select(F.col("video_id").alias("sentence_id"), F.col("true_gloss").alias("sign"))
    return rounded(O.expected_top3(said, PR.sign_profiles(every.where("true_gloss != 'G07'"))), "expected")
