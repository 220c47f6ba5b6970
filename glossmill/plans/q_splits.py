"""Queries for splits, plans and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossmill.operators import metadata as M
from glossmill.operators import splits as S
from glossmill.plans import proxies as P
from glossmill.plans.q_eval import rounded
from glossmill.plans.registry import query

_WITH = f"WITH {P.CLIPS_SQL}"
_BUCKET = "CASE WHEN {0} < 50 THEN 'short' WHEN {0} < 80 THEN 'medium' ELSE 'long' END"
_FAMS = f"""fams AS (
  SELECT gloss, video_id, count(*) AS n_clips, count(*) FILTER (NOT is_augmented) AS n_originals, max(n_frames) FILTER (NOT is_augmented) AS n_frames
  FROM clips GROUP BY 1, 2 HAVING count(*) FILTER (NOT is_augmented) > 0
), families AS (SELECT *, {_BUCKET.format("n_frames")} AS bucket FROM fams)"""
_SPLIT = """ordered AS (
  SELECT *, row_number() OVER (PARTITION BY gloss ORDER BY md5('42|' || gloss || '|' || video_id), video_id) AS rn, count(*) OVER (PARTITION BY gloss) AS n FROM families
), dealt AS (
  SELECT *, n >= 3 AND rn > 3 AS rest, row_number() OVER (PARTITION BY gloss, bucket, n >= 3 AND rn > 3 ORDER BY rn) AS brn,
         count(*) OVER (PARTITION BY gloss, bucket, n >= 3 AND rn > 3) AS bn FROM ordered
), split AS (
  SELECT gloss, video_id, bucket, CASE WHEN rest AND brn <= trunc(bn * 0.15::DOUBLE) THEN 'val' WHEN rest AND brn <= trunc(bn * 0.15::DOUBLE) + trunc(bn * 0.15::DOUBLE) THEN 'test'
    WHEN rest THEN 'train' WHEN rn = 1 THEN 'train' WHEN rn = 2 THEN 'val' ELSE 'test' END AS split FROM dealt
), assigned AS (SELECT clips.*, split.split FROM clips JOIN split USING (gloss, video_id))"""
_ALL = f"{_WITH}, {_FAMS}, {_SPLIT}"


def _assigned(spark, sf_dir):
    clips = P.clips(spark, sf_dir)
    return S.assign(clips, S.stratified_family_split(S.families(clips)))


@query("families", f"{_WITH}, {_FAMS} SELECT * FROM families")
def families(spark, sf_dir):
    return S.families(P.clips(spark, sf_dir))


@query("stratified_family_split", f"{_ALL} SELECT * FROM split")
def stratified_family_split(spark, sf_dir):
    return S.stratified_family_split(S.families(P.clips(spark, sf_dir))).select("gloss", "video_id", "bucket", "split")


_VIDEOS = "videos AS (SELECT DISTINCT gloss, video_id FROM clips), r AS (SELECT *, row_number() OVER (PARTITION BY gloss ORDER BY md5('42|' || gloss || '|' || video_id), video_id) AS rn, count(*) OVER (PARTITION BY gloss) AS n FROM videos)"


def _videos(spark, sf_dir):
    return P.clips(spark, sf_dir).select("gloss", "video_id").distinct()


@query(
    "rounded_split",
    f"""{_WITH}, {_VIDEOS}, k AS (SELECT *, greatest(CAST(round_even(n * 0.15::DOUBLE, 0) AS INT), 1) AS k0 FROM r),
kk AS (SELECT *, CASE WHEN 2 * k0 < n THEN k0 ELSE 1 END AS k FROM k)
SELECT gloss, video_id, CASE WHEN n < 3 THEN 'train' WHEN rn <= k THEN 'val' WHEN rn <= 2 * k THEN 'test' ELSE 'train' END AS split FROM kk""",
)
def rounded_split(spark, sf_dir):
    return S.rounded_split(_videos(spark, sf_dir))


@query(
    "simple_split",
    f"""{_WITH}, {_VIDEOS}, v AS (SELECT *, greatest(trunc(n * 0.15::DOUBLE), 1) AS nv FROM r),
t AS (SELECT *, greatest(least(greatest(trunc(n * 0.7::DOUBLE), 1), n - nv - 1), 1) AS nt FROM v)
SELECT gloss, video_id, CASE WHEN rn <= nt THEN 'train' WHEN rn <= nt + nv THEN 'val' ELSE 'test' END AS split FROM t""",
)
def simple_split(spark, sf_dir):
    return S.simple_split(_videos(spark, sf_dir))


_LEAKY = """lr AS (SELECT *, row_number() OVER (PARTITION BY gloss ORDER BY md5('42|' || clip_id), clip_id) AS rn, count(*) OVER (PARTITION BY gloss) AS n FROM clips),
leaky AS (SELECT clip_id, gloss, video_id, CASE WHEN rn <= trunc(n * 0.7::DOUBLE) THEN 'train' WHEN rn <= trunc(n * 0.7::DOUBLE) + trunc(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM lr)"""


@query("leaky_split", f"{_WITH}, {_LEAKY} SELECT gloss, split, count(*) AS n FROM leaky GROUP BY 1, 2")
def leaky_split(spark, sf_dir):
    return S.leaky_split(P.clips(spark, sf_dir)).groupBy("gloss", "split").agg(F.count("*").alias("n"))


@query(
    "leaky_overlap",
    f"""{_WITH}, {_LEAKY}, k AS (SELECT DISTINCT split, gloss, video_id FROM leaky), z AS (SELECT split AS a, count(*) AS families FROM k GROUP BY 1)
SELECT x.split AS a, y.split AS b, count(*) AS shared, round(count(*) / min(z.families) * 100, 6) AS share
FROM k x JOIN k y ON x.gloss = y.gloss AND x.video_id = y.video_id AND x.split < y.split JOIN z ON z.a = x.split GROUP BY 1, 2""",
)
def leaky_overlap(spark, sf_dir):
    return rounded(S.leaky_overlap(S.leaky_split(P.clips(spark, sf_dir))), "share")


@query(
    "random_stratified_split",
    f"""{_WITH}, {_LEAKY} SELECT gloss, CASE WHEN rn <= round_even(n * 0.8::DOUBLE, 0) THEN 'train' ELSE 'val' END AS split, count(*) AS n FROM lr GROUP BY 1, 2""",
)
def random_stratified_split(spark, sf_dir):
    return S.random_stratified_split(P.clips(spark, sf_dir)).groupBy("gloss", "split").agg(F.count("*").alias("n"))


@query(
    "split_summary",
    f"{_ALL} SELECT split, gloss, count(DISTINCT video_id) AS families, count(*) AS clips, count(*) FILTER (NOT is_augmented) AS originals FROM assigned GROUP BY ROLLUP (split, gloss)",
)
def split_summary(spark, sf_dir):
    return S.split_summary(_assigned(spark, sf_dir))


_BALANCE = """cb AS (SELECT gloss, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test, count(*) AS total FROM assigned GROUP BY 1),
balance AS (SELECT *, stddev_pop(train) OVER () / avg(train) OVER () AS train_cv, val = 0 AND total >= 3 AS missing_val, test = 0 AND total >= 5 AS missing_test FROM cb)"""


@query("class_balance", f"{_ALL}, {_BALANCE} SELECT * REPLACE (round(train_cv, 6) AS train_cv) FROM balance")
def class_balance(spark, sf_dir):
    return rounded(S.class_balance(_assigned(spark, sf_dir)), "train_cv")


_RATIO = "SELECT count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test, count(*) FILTER (split = 'train') / count(*) AS train_ratio FROM assigned"


@query("sample_ratio_check", f"{_ALL}, x AS ({_RATIO}) SELECT train, val, test, round(train_ratio, 6) AS train_ratio, train_ratio BETWEEN 0.5 AND 0.9 AND val > 0 AND test > 0 AS passed FROM x")
def sample_ratio_check(spark, sf_dir):
    return rounded(S.sample_ratio_check(_assigned(spark, sf_dir)), "train_ratio")


_KS = """SELECT 'frames', round(max(gap), 6), coalesce(max(gap) <= sqrt(-ln(0.005) / 2) * sqrt(1 / max(na) + 1 / max(nb)), true) FROM (
SELECT abs(sum(a) OVER w / sum(a) OVER () - sum(b) OVER w / sum(b) OVER ()) AS gap, sum(a) OVER () AS na, sum(b) OVER () AS nb
FROM (SELECT n_frames, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'test') AS b FROM assigned GROUP BY 1) WINDOW w AS (ORDER BY n_frames ROWS UNBOUNDED PRECEDING)) WHERE na >= 10 AND nb >= 10"""


@query(
    "verify_splits",
    f"""{_ALL}, {_BALANCE}, k AS (SELECT DISTINCT split, gloss, video_id FROM assigned),
l AS (SELECT count(*) AS f FROM k x JOIN k y ON x.gloss = y.gloss AND x.video_id = y.video_id AND x.split < y.split), q AS ({_RATIO})
SELECT 'no_leak' AS "check", CAST(f AS DOUBLE) AS figure, f = 0 AS passed FROM l
UNION ALL SELECT 'classes_present', CAST(count(*) FILTER (missing_val OR missing_test) AS DOUBLE), count(*) FILTER (missing_val OR missing_test) = 0 FROM balance
UNION ALL SELECT 'balanced', round(max(train_cv), 6), max(train_cv) <= 0.5 FROM balance
UNION ALL SELECT 'ratio', round(train_ratio, 6), train_ratio BETWEEN 0.5 AND 0.9 AND val > 0 AND test > 0 FROM q
UNION ALL {_KS}""",
)
def verify_splits(spark, sf_dir):
    return rounded(S.verify_splits(_assigned(spark, sf_dir)), "figure")


@query(
    "ks_two_sample",
    f"""{_ALL}, c AS (SELECT n_frames, count(*) FILTER (split = 'train') AS na, count(*) FILTER (split = 'test') AS nb FROM assigned GROUP BY 1),
g AS (SELECT abs(sum(na) OVER w / sum(na) OVER () - sum(nb) OVER w / sum(nb) OVER ()) AS gap, sum(na) OVER () AS na, sum(nb) OVER () AS nb FROM c WINDOW w AS (ORDER BY n_frames ROWS UNBOUNDED PRECEDING))
SELECT CAST(min(na) AS BIGINT) AS na, CAST(min(nb) AS BIGINT) AS nb, round(max(gap), 6) AS statistic FROM g""",
)
def ks_two_sample(spark, sf_dir):
    values = _assigned(spark, sf_dir).select(F.col("split").alias("part"), F.col("n_frames").alias("value"))
    return rounded(S.ks_two_sample(values, "train", "test"), "statistic")


@query(
    "augmentation_plan",
    f"""{_WITH}, c AS (SELECT gloss, count(DISTINCT video_id) AS n FROM clips GROUP BY 1), m AS (SELECT *, greatest(5000 - n, 0) AS missing FROM c)
SELECT gloss, n, missing, CASE WHEN missing = 0 THEN 0 ELSE least(greatest(missing // n, 1), 60) END AS per_video FROM m""",
)
def augmentation_plan(spark, sf_dir):
    counts = M.class_frequencies(P.clips(spark, sf_dir)).withColumnRenamed("videos", "n")
    return S.augmentation_plan(counts, target=5000)


_PLAN = """f AS (SELECT gloss, video_id, count(*) AS size, max(aug_id) AS last FROM clips GROUP BY 1, 2),
p AS (SELECT gloss, sum(size) AS n, count(*) AS families, max(size) AS largest FROM f GROUP BY 1), t AS (SELECT *, max(n) OVER () AS target FROM p),
e AS (SELECT *, target - n AS needed, least((target - n) // families, greatest(largest - 1, 0)) AS per_family FROM t)"""


@query(
    "balancing_plan",
    f"""{_WITH}, {_PLAN} SELECT gloss, CAST(n AS BIGINT) AS n, families, largest, CAST(target AS BIGINT) AS target, CAST(needed AS BIGINT) AS needed, CAST(per_family AS BIGINT) AS per_family,
CAST(n + per_family * families AS BIGINT) AS after, CASE WHEN needed = 0 THEN 'already_balanced' WHEN n + per_family * families = target THEN 'balanced' ELSE 'partial' END AS status FROM e""",
)
def balancing_plan(spark, sf_dir):
    return S.balancing_plan(P.clips(spark, sf_dir))


@query("balance_rows", f"{_WITH}, {_PLAN} SELECT f.gloss, f.video_id, unnest(range(f.last + 1, CAST(f.last + per_family + 1 AS BIGINT))) AS aug_id FROM f JOIN e USING (gloss) WHERE per_family > 0")
def balance_rows(spark, sf_dir):
    return S.balance_rows(P.clips(spark, sf_dir))


@query(
    "balance_train",
    f"""{_WITH}, f AS (SELECT gloss, video_id, count(*) AS size, max(aug_id) AS last FROM clips GROUP BY 1, 2),
p AS (SELECT gloss, sum(size) AS n, count(*) AS families, max(size) AS largest FROM f GROUP BY 1),
e AS (SELECT *, least(greatest(300 - n, 0) // families, greatest(largest - 1, 0)) AS per_family FROM p),
every AS (SELECT clip_id, gloss, is_augmented, false AS new FROM clips
  UNION ALL SELECT concat_ws('_', video_id, 'balance', unnest(range(last + 1, CAST(last + per_family + 1 AS BIGINT)))), gloss, true, true FROM f JOIN e USING (gloss) WHERE per_family > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY gloss ORDER BY CAST(is_augmented AS INT), md5('42|' || clip_id), clip_id) AS rn FROM every),
k AS (SELECT * FROM r WHERE rn <= 300 OR NOT is_augmented)
SELECT gloss, count(*) FILTER (NOT new) AS kept, (SELECT count(*) FROM clips c WHERE c.gloss = k.gloss) AS before, count(*) AS after, count(*) FILTER (new) AS added, count(*) = 300 AS achieved FROM k GROUP BY gloss""",
)
def balance_train(spark, sf_dir):
    train = P.clips(spark, sf_dir)
    out = S.balance_summary(train, S.balance_train(train, 300), 300)
    return out.withColumn("kept", F.col("after") - F.col("added"))


def _sequence_sql() -> str:
    total = sum(w for _, w in S.TECHNIQUES)
    counts = [f"greatest(1, CAST(trunc(n * {w}::DOUBLE / {total}::DOUBLE) AS BIGINT))" for _, w in S.TECHNIQUES]
    cases = " ".join(f"WHEN i < {' + '.join(counts[: k + 1])} THEN '{name}'" for k, (name, _) in enumerate(S.TECHNIQUES))
    return f"CASE {cases} ELSE 'geometric' END"


@query(
    "augmentation_sequence",
    f"""WITH s AS (SELECT c_nationkey AS key, count(*) AS n FROM customer GROUP BY 1), x AS (SELECT key, n, unnest(range(n)) AS i FROM s)
SELECT key, technique, count(*) AS uses, min(i) AS first_no FROM (SELECT key, i, {_sequence_sql()} AS technique FROM x) GROUP BY 1, 2""",
)
def augmentation_sequence(spark, sf_dir):
    sizes = P.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.count("*").alias("n"))
    return S.augmentation_sequence(sizes).groupBy("key", "technique").agg(F.count("*").alias("uses"), F.min("aug_no").alias("first_no"))


@query(
    "cap_class",
    f"""{_WITH}, r AS (SELECT *, row_number() OVER (PARTITION BY gloss ORDER BY CAST(is_augmented AS INT), md5('42|' || clip_id), clip_id) AS rn FROM clips)
SELECT clip_id, gloss FROM r WHERE rn <= 150 OR NOT is_augmented""",
)
def cap_class(spark, sf_dir):
    return S.cap_class(P.clips(spark, sf_dir), 150).select("clip_id", "gloss")


@query("targeted_manifest", f"{_WITH} SELECT gloss, is_augmented, count(*) AS n FROM clips WHERE NOT is_augmented OR gloss IN ('Brand#1', 'Brand#7') GROUP BY 1, 2")
def targeted_manifest(spark, sf_dir):
    clips = P.clips(spark, sf_dir)
    wanted = clips.where("gloss IN ('Brand#1', 'Brand#7')").select("gloss")
    return S.targeted_manifest(clips, wanted).groupBy("gloss", "is_augmented").agg(F.count("*").alias("n"))


_GROUPS = """videos AS (SELECT DISTINCT gloss, video_id FROM clips), sg AS (
  SELECT *, coalesce(CAST(video_id - lag(video_id) OVER w > 100 AS INT), 0) AS new FROM videos WINDOW w AS (PARTITION BY gloss ORDER BY video_id)
), grouped AS (SELECT gloss, video_id, CAST(sum(new) OVER (PARTITION BY gloss ORDER BY video_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS signer_group FROM sg)"""


@query("signer_groups", f"{_WITH}, {_GROUPS} SELECT * FROM grouped")
def signer_groups(spark, sf_dir):
    return S.signer_groups(_videos(spark, sf_dir))


@query(
    "signer_aware_split",
    f"""WITH RECURSIVE {P.CLIPS_SQL}, {_GROUPS}, per AS (SELECT gloss, signer_group, count(*) AS size FROM grouped GROUP BY 1, 2), sizes AS (
  SELECT *, CAST(sum(size) OVER g AS BIGINT) AS n, count(*) OVER g AS many, row_number() OVER (PARTITION BY gloss ORDER BY size DESC, signer_group) AS k
  FROM per WINDOW g AS (PARTITION BY gloss)
), step AS (
  SELECT gloss, 0::BIGINT AS k, 0::BIGINT AS train, 0::BIGINT AS val, 0::BIGINT AS test, '' AS chosen FROM sizes WHERE k = 1 AND many > 2 AND n > 3
  UNION ALL
  SELECT gloss, k, train + CASE WHEN chosen = 'train' THEN size ELSE 0 END, val + CASE WHEN chosen = 'val' THEN size ELSE 0 END,
         test + CASE WHEN chosen = 'test' THEN size ELSE 0 END, chosen
  FROM (
    SELECT t.gloss, s.k, s.size, train, val, test, CASE
             WHEN many - s.k + 1 <= CAST(train = 0 AS INT) + CAST(val = 0 AS INT) + CAST(test = 0 AS INT)
               THEN CASE WHEN train = 0 THEN 'train' WHEN val = 0 THEN 'val' ELSE 'test' END
             WHEN 0.15::DOUBLE * n - val >= 0.7::DOUBLE * n - train AND val <= test THEN 'val'
             WHEN 0.7::DOUBLE * n - train >= 0.15::DOUBLE * n - test THEN 'train' ELSE 'test' END AS chosen
    FROM step t JOIN sizes s ON s.gloss = t.gloss AND s.k = t.k + 1
  )
), placed AS (
  SELECT v.gloss, v.video_id, v.signer_group, s.size, s.n, s.many, s.k, t.chosen, row_number() OVER o - 1 AS i,
         coalesce(lag(v.signer_group) OVER o <> v.signer_group, true) AS first,
         greatest(1, floor(s.n * 0.15::DOUBLE)) AS n_val
  FROM grouped v JOIN sizes s ON s.gloss = v.gloss AND s.signer_group = v.signer_group LEFT JOIN step t ON t.gloss = s.gloss AND t.k = s.k
  WINDOW o AS (PARTITION BY v.gloss ORDER BY v.video_id)
), shares AS (SELECT *, greatest(1, least(floor(n * 0.7::DOUBLE), n - n_val - 1)) AS n_train FROM placed), dealt AS (
  SELECT gloss, video_id, signer_group, unnest(CASE
    WHEN n = 1 THEN ['train', 'val copy', 'test copy'] WHEN n = 2 AND i = 0 THEN ['train'] WHEN n = 2 THEN ['test', 'val copy']
    WHEN n = 3 OR many = 1 THEN [CASE WHEN i < n_train THEN 'train' WHEN i < n_train + n_val THEN 'val' ELSE 'test' END]
    WHEN many > 2 THEN [chosen] WHEN k = 1 THEN ['train'] WHEN size = 1 THEN ['test', 'val copy'] WHEN first THEN ['val'] ELSE ['test'] END) AS place
  FROM shares
)
SELECT gloss, video_id, signer_group, split_part(place, ' ', 1) AS split, ends_with(place, 'copy') AS is_copy FROM dealt""",
)
def signer_aware_split(spark, sf_dir):
    return S.signer_aware_split(_videos(spark, sf_dir))


@query(
    "parse_family",
    f"{_WITH} SELECT clip_id, CAST(video_id AS VARCHAR) AS a, CAST(video_id AS VARCHAR) AS b, CAST(video_id AS VARCHAR) AS c, CAST(greatest(video_id, aug_id) AS BIGINT) AS number, is_augmented AS aug FROM clips",
)
def parse_family(spark, sf_dir):
    v, k = F.col("video_id").cast("string"), F.col("aug_id").cast("string")
    names = [
        F.concat(F.lit("pool/"), v, F.lit("_aug"), k, F.lit("_flip.pkl")),
        F.concat(F.lit("aug_"), k, F.lit("_"), v),
        F.concat(v, F.lit("_balance_"), k, F.lit(".pkl")),
    ]
    named = F.when(F.col("is_augmented"), names[0]).otherwise(F.concat(v, F.lit(".pkl")))
    return P.clips(spark, sf_dir).select(
        "clip_id", *[S.parse_family(x).alias(n) for x, n in zip(names, "abc", strict=True)], S.video_number(names[0]).alias("number"), S.is_augmented(named).alias("aug")
    )


@query(
    "design_dataset",
    f"""{_WITH}, pool AS (
  SELECT gloss, CASE WHEN gloss < 'Brand#15' THEN 'easy' WHEN gloss < 'Brand#2' THEN 'medium' ELSE 'hard' END AS difficulty FROM (SELECT DISTINCT gloss FROM clips)
), drawn AS (
  SELECT draw, gloss, difficulty, row_number() OVER (PARTITION BY draw, difficulty ORDER BY md5(concat_ws('|', '42', draw, gloss)), gloss) AS r
  FROM pool, range(80) t(draw)
), combos AS (
  SELECT draw, string_agg(gloss, ',' ORDER BY gloss) AS glosses FROM drawn WHERE r <= CASE difficulty WHEN 'easy' THEN 2 ELSE 1 END GROUP BY draw
), once AS (SELECT glosses, min(draw) AS draw FROM combos GROUP BY glosses)
SELECT CAST(row_number() OVER (ORDER BY draw) AS INT) AS combo_no, glosses FROM once ORDER BY draw LIMIT 20""",
)
def design_dataset(spark, sf_dir):
    sizes = M.class_frequencies(P.clips(spark, sf_dir))
    level = F.when(F.col("gloss") < "Brand#15", "easy").when(F.col("gloss") < "Brand#2", "medium").otherwise("hard")
    return S.design_dataset(sizes.select("gloss", level.alias("difficulty")), {"easy": 2, "medium": 1, "hard": 1}, 20).withColumn(
        "glosses", F.array_join("glosses", ",")
    )


@query("class_frequencies", f"{_WITH} SELECT gloss, count(DISTINCT video_id) AS videos FROM clips GROUP BY 1")
def class_frequencies(spark, sf_dir):
    return M.class_frequencies(P.clips(spark, sf_dir))


@query("dedupe_scan", f"{_WITH} SELECT gloss, video_id, min(clip_id) AS clip_id FROM clips WHERE NOT is_augmented GROUP BY 1, 2")
def dedupe_scan(spark, sf_dir):
    return M.dedupe_scan(P.clips(spark, sf_dir))


def _suppliers(spark, sf_dir):
    return P.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("video_id"), F.col("s_nationkey").alias("n"))


@query("label_clips", "SELECT s_suppkey AS video_id, n_name AS gloss FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def label_clips(spark, sf_dir):
    nations = P.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("gloss"))
    mapping = _suppliers(spark, sf_dir).join(F.broadcast(nations), "n").select("video_id", "gloss")
    return M.label_clips(_suppliers(spark, sf_dir).select("video_id"), mapping)


@query("filter_glosses", "SELECT p_brand AS gloss, count(*) AS n FROM part WHERE lower(p_brand) IN ('brand#3', 'brand#11') GROUP BY 1")
def filter_glosses(spark, sf_dir):
    part = P.table(spark, sf_dir, "part").select(F.col("p_brand").alias("gloss"))
    wanted = part.where("gloss IN ('Brand#3', 'Brand#11')").select(F.upper("gloss").alias("gloss"))
    return M.filter_glosses(part, wanted).groupBy("gloss").agg(F.count("*").alias("n"))


_CATS = "cats AS (SELECT n_name AS gloss, r_name AS category FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 0)"


def _categories(spark, sf_dir):
    regions = P.table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    nations = P.table(spark, sf_dir, "nation")
    return nations.select(F.col("n_name").alias("gloss"), "n_nationkey"), nations.where("n_nationkey % 5 != 0").join(regions, "n_regionkey").select(
        F.col("n_name").alias("gloss"), F.col("r_name").alias("category")
    )


@query("attach_category", f"WITH {_CATS} SELECT n_name AS gloss, n_nationkey, coalesce(category, 'Other') AS category FROM nation LEFT JOIN cats ON n_name = gloss")
def attach_category(spark, sf_dir):
    return M.attach_category(*_categories(spark, sf_dir))


@query("category_stats", f"WITH {_CATS}, a AS (SELECT n_name AS gloss, coalesce(category, 'Other') AS category FROM nation LEFT JOIN cats ON n_name = gloss) SELECT category, count(DISTINCT gloss) AS glosses FROM a GROUP BY ROLLUP (category)")
def category_stats(spark, sf_dir):
    return M.category_stats(M.attach_category(*_categories(spark, sf_dir)))


@query(
    "missing_coverage",
    """WITH g AS (SELECT concat(n_name, ' ', c_mktsegment) AS gloss, c_acctbal < 0 AS owes FROM customer JOIN nation ON c_nationkey = n_nationkey),
a AS (SELECT DISTINCT gloss FROM g WHERE owes), b AS (SELECT DISTINCT gloss FROM g WHERE NOT owes)
SELECT gloss, 'missing' AS side FROM a WHERE gloss NOT IN (SELECT gloss FROM b) UNION ALL SELECT gloss, 'extra' FROM b WHERE gloss NOT IN (SELECT gloss FROM a)""",
)
def missing_coverage(spark, sf_dir):
    nation = P.table(spark, sf_dir, "nation")
    rows = P.table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.concat_ws(" ", "n_name", "c_mktsegment").alias("gloss"), (F.col("c_acctbal") < 0).alias("owes"))
    return M.missing_coverage(rows.where("owes"), rows.where("NOT owes"))


@query("min_length", f"{_WITH} SELECT gloss, count(*) AS clips FROM clips WHERE n_frames >= 40 GROUP BY 1")
def min_length(spark, sf_dir):
    return M.min_length(P.clips(spark, sf_dir), 40).groupBy("gloss").agg(F.count("*").alias("clips"))


@query("exclude", "SELECT p_brand AS gloss, count(*) AS n FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 1 AND p_partkey % 3 = 0) GROUP BY 1")
def exclude(spark, sf_dir):
    part = P.table(spark, sf_dir, "part").withColumnRenamed("p_brand", "gloss")
    return M.exclude(part, part.where("p_size = 1 AND p_partkey % 3 = 0")).groupBy("gloss").agg(F.count("*").alias("n"))


@query(
    "incremental_classes",
    f"""{_WITH}, c AS (SELECT gloss, count(DISTINCT video_id) AS videos FROM clips GROUP BY 1), b AS (SELECT gloss, row_number() OVER (ORDER BY gloss) - 1 AS class_idx FROM c WHERE gloss LIKE '%1'),
u AS (SELECT gloss, 0 AS part, class_idx AS key FROM b UNION ALL SELECT gloss, 1, -videos FROM c WHERE gloss NOT IN (SELECT gloss FROM b)),
r AS (SELECT gloss, row_number() OVER (ORDER BY part, key, gloss) - 1 AS class_idx FROM u) SELECT class_idx, gloss FROM r WHERE class_idx < 12""",
)
def incremental_classes(spark, sf_dir):
    sizes = M.class_frequencies(P.clips(spark, sf_dir))
    base = M.class_mapping(sizes.where("gloss LIKE '%1'"))
    return M.incremental_classes(sizes, base, 12)


@query("class_mapping", "SELECT gloss, row_number() OVER (ORDER BY gloss) - 1 AS class_idx FROM (SELECT DISTINCT p_brand AS gloss FROM part)")
def class_mapping(spark, sf_dir):
    return M.class_mapping(P.table(spark, sf_dir, "part").select(F.col("p_brand").alias("gloss")))


@query("signer_coverage", f"{_WITH}, s AS (SELECT signer_id, count(DISTINCT gloss) AS glosses FROM clips GROUP BY 1) SELECT *, row_number() OVER (ORDER BY glosses DESC, signer_id) AS rank FROM s")
def signer_coverage(spark, sf_dir):
    return M.signer_coverage(P.clips(spark, sf_dir))


@query(
    "signer_missing",
    """WITH x AS (SELECT l_partkey AS gloss, l_suppkey % 10 AS signer_id FROM lineitem)
SELECT gloss, min(signer_id) AS alternative, count(DISTINCT signer_id) - 1 AS others FROM x WHERE gloss NOT IN (SELECT gloss FROM x WHERE signer_id = 3) GROUP BY 1""",
)
def signer_missing(spark, sf_dir):
    rows = P.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("gloss"), (F.col("l_suppkey") % 10).alias("signer_id"))
    return M.signer_missing(rows, 3)


@query("pool_index", f"{_WITH}, r AS (SELECT gloss, clip_id, (row_number() OVER (PARTITION BY gloss ORDER BY clip_id) - 1) // 1000 AS part FROM clips) SELECT gloss, part, string_agg(clip_id, ' ' ORDER BY clip_id) AS files FROM r GROUP BY 1, 2")
def pool_index(spark, sf_dir):
    files = P.clips(spark, sf_dir).withColumnRenamed("clip_id", "file")
    return M.pool_index(files).withColumn("files", F.array_join("files", " "))


@query(
    "domain_overlap",
    """WITH e AS (SELECT DISTINCT l_suppkey % 10 AS domain, l_partkey AS gloss FROM lineitem), h AS (SELECT gloss, count(*) AS n FROM e GROUP BY 1)
SELECT domain, count(*) FILTER (n > 1) AS shared, count(*) FILTER (n = 1) AS unique_glosses FROM e JOIN h USING (gloss) GROUP BY 1""",
)
def domain_overlap(spark, sf_dir):
    rows = P.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("domain"), F.col("l_partkey").alias("gloss"))
    return M.domain_overlap(rows)


@query("pick_sample", f"{_WITH}, o AS (SELECT gloss, min(clip_id) AS clip_id FROM clips GROUP BY 1) SELECT p_partkey AS pos, p_brand AS gloss, clip_id FROM part LEFT JOIN o ON gloss = p_brand")
def pick_sample(spark, sf_dir):
    wanted = P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("gloss"))
    return M.pick_sample(wanted, P.clips(spark, sf_dir))


@query(
    "search_filter",
    """WITH c AS (SELECT l_shipdate AS word, l_suppkey AS video, l_quantity AS duration, l_returnflag AS channel, CAST(l_extendedprice AS DOUBLE) AS views FROM lineitem),
o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY word, video ORDER BY views DESC, channel DESC, duration DESC) = 1)
SELECT word, video, duration, channel, views, row_number() OVER (PARTITION BY word ORDER BY CAST(channel = 'A' AS INT) DESC, views DESC, video) AS rank FROM o WHERE duration BETWEEN 5 AND 40""",
)
def search_filter(spark, sf_dir):
    rows = P.table(spark, sf_dir, "lineitem").selectExpr(
        "l_shipdate AS word", "l_suppkey AS video", "l_quantity AS duration", "l_returnflag AS channel", "l_extendedprice AS views"
    )
    return M.search_filter(rows, 5, 40, ["A"])
