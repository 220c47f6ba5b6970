"""Class vectors, distances and the choice of vocabularies."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossmill.functions import vectors as V
from glossmill.sources.scratch import written


def gloss_centroids(vectors: DataFrame, most: int | None = None) -> DataFrame:
    """Mean over clips of their mean over frames: ``vectors(gloss, clip_id, frame_idx, vec)`` to ``(gloss, clips, vec)``.

    With ``most``, the first clips by hash of each class count, as a sample.
    """
    each = vectors.select("gloss", "clip_id", F.posexplode("vec").alias("dim", "x"))
    clip = each.groupBy("gloss", "clip_id", "dim").agg(F.avg("x").alias("x"))
    if most is not None:
        order = Window.partitionBy("gloss", "dim").orderBy(F.md5(F.col("clip_id").cast("string")), "clip_id")
        clip = clip.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    mean = clip.groupBy("gloss", "dim").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct("dim", "x")))
    return mean.groupBy("gloss").agg(F.first("n").alias("clips"), F.transform(listed, lambda s: s["x"]).alias("vec"))


#: Classes up to which their vectors are compared as one table; beyond, they are joined in blocks.
ONE_BLOCK = 2_000


def pairwise_distance(vectors: DataFrame, metric: str = "cosine", blocks: int | None = None) -> DataFrame:
    """Distances of all pairs of classes ``a < b`` of ``vectors(gloss, vec)``; ``1 - cosine`` or Euclidean.

    The table has one vector for each class. It is cut into blocks by a hash of the class, and each pair of blocks is a
    task of its own that multiplies two matrices of bounded size.
    """
    if blocks is None:
        blocks = max(1, -(-vectors.count() // ONE_BLOCK))
    block = F.pmod(F.xxhash64("gloss"), F.lit(blocks)).cast("int")
    rows = vectors.select("gloss", F.transform("vec", lambda x: x.cast("double")).alias("vec"), block.alias("k"))
    pairs = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda j: F.struct(F.least("k", j).alias("i"), F.greatest("k", j).alias("j")))
    sent = rows.select("gloss", "vec", "k", F.explode(pairs).alias("p")).select("gloss", "vec", "k", "p.*")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, x = pdf["gloss"].to_numpy(), np.stack(pdf["vec"].to_numpy())
        left = np.flatnonzero(pdf["k"].to_numpy() == pdf["i"].iloc[0])
        right = np.flatnonzero(pdf["k"].to_numpy() == pdf["j"].iloc[0])
        if metric == "cosine":
            size = np.linalg.norm(x, axis=1, keepdims=True)
            unit = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
            d = 1 - unit[left] @ unit[right].T
        else:
            d = np.empty((len(left), len(right)))
            for k in range(0, len(left), 64):  # differences of a few rows at a time
                d[k : k + 64] = np.sqrt(((x[left[k : k + 64], None, :] - x[None, right, :]) ** 2).sum(-1))
        a, b = np.meshgrid(left, right, indexing="ij")
        a, b, d = a.ravel(), b.ravel(), d.ravel()
        keep = names[a] != names[b]
        if pdf["i"].iloc[0] == pdf["j"].iloc[0]:
            keep &= names[a] < names[b]
        one, two = names[a[keep]], names[b[keep]]
        return pd.DataFrame({"a": np.minimum(one, two), "b": np.maximum(one, two), "distance": d[keep]})

    return sent.groupBy("i", "j").applyInPandas(run, "a string, b string, distance double")


#: Most cells of :func:`nearest_classes`; their centres are the only vectors that pass through the driver.
MOST_CELLS = 1_024


def needed_cells(centers: np.ndarray, radius: np.ndarray, bound: np.ndarray) -> list[list[int]]:
    """For each cell the cells that may hold something within its ``bound``, by the triangle inequality."""
    apart = np.stack([np.linalg.norm(centers - c, axis=1) for c in centers])
    least = apart - radius[:, None] - radius[None]
    return [np.flatnonzero(row <= b + 1e-8).tolist() for row, b in zip(least, bound, strict=True)]


def nearest_classes(vectors: DataFrame, k: int = 5, cells: int | None = None) -> DataFrame:
    """The ``k`` nearest other classes of each class of ``vectors(gloss, vec)``: ``(gloss, rank, other, distance)``.

    Euclidean distance, ties (to nine places) by name; of unit vectors that is the order of the cosine. Glosses are
    distinct, vectors of one length without nulls. Fewer than ``k`` others are all there are; an empty table gives no row.

    Each class goes to the nearest of some centres (the first classes by MD5 of the name). The k nearest inside its own
    block bound how far a class has to look, so of two cells further apart than their radii and that bound nothing is
    compared. The rest are pairs of blocks of at most about ``ONE_BLOCK`` classes; a crowded cell is several blocks. The
    result is always that of all pairs. What passes through the driver is a row for each cell, ``MOST_CELLS`` at most.
    """
    spark = vectors.sparkSession
    rows = vectors.select("gloss", F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    if cells is None:
        cells = -(-rows.count() // ONE_BLOCK)
    some = rows.orderBy(F.md5("gloss"), "gloss").limit(min(max(cells, 1), MOST_CELLS)).collect()
    if not some:
        return rows.select("gloss", F.lit(1).alias("rank"), F.col("gloss").alias("other"), F.lit(0.0).alias("distance"))
    centers = np.array([r.vec for r in some])

    def place(batches):
        for pdf in batches:
            if len(pdf):
                d = np.stack([np.linalg.norm(centers - np.asarray(v), axis=1) for v in pdf["vec"]])
                yield pdf.assign(cell=d.argmin(1), far=d.min(1))

    placed = written(rows.mapInPandas(place, "gloss string, vec array<double>, cell int, far double"), "placed")
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
    radius, parts = np.full(len(centers), -np.inf), [0] * len(centers)
    for r in stats:
        radius[r.cell], parts[r.cell] = r.far, -(-r.n // ONE_BLOCK)
    sizes = F.array(*map(F.lit, parts))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("gloss"), F.get(sizes, F.col("cell"))).cast("int"))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("gloss")
        names, x, y = right["gloss"].to_numpy(), np.stack(left["vec"].to_numpy()), np.stack(right["vec"].to_numpy())
        out = []
        for cell, name, v in zip(left["cell"], left["gloss"], x, strict=True):
            d = np.linalg.norm(y - v, axis=1)
            order = np.argsort(np.round(d, 9), kind="stable")[: k + 1]
            out += [(cell, name, names[i], d[i]) for i in [i for i in order if names[i] != name][:k]]
        return pd.DataFrame(out, columns=["cell", "gloss", "other", "distance"])

    found = "cell int, gloss string, other string, distance double"
    own = written(placed.groupBy("cell", "part").applyInPandas(lambda pdf: best(pdf, pdf), found), "own")
    # A class with fewer than k others in its block has to look everywhere.
    each = own.groupBy("cell", "gloss").agg(F.count("*").alias("n"), F.max("distance").alias("d"))
    full = {r.cell: r for r in each.where(F.col("n") == k).groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("d")).collect()}
    bound = np.array([-np.inf] * len(centers))
    for r in stats:
        bound[r.cell] = full[r.cell].d if r.cell in full and full[r.cell].n == r.n else np.inf
    need = needed_cells(centers, radius, bound)
    both = [(i, j) for i, to in enumerate(need) for j in to if parts[i] and parts[j]]
    table = spark.createDataFrame(both or [(-1, -1)], "i int, j int")  # MOST_CELLS ** 2 rows at most
    each_part = lambda c: F.explode(F.sequence(F.lit(0), F.get(sizes, F.col(c)) - 1))
    out = table.groupBy("i").agg(F.collect_list("j").alias("js"))
    left = placed.join(out, placed["cell"] == out["i"]).withColumn("j", F.explode("js")).withColumn("q", each_part("j"))
    left = left.where("i != j OR part != q").select("i", F.col("part").alias("p"), "j", "q", "cell", *[F.col(c).alias(c) for c in ("gloss", "vec")])
    back = table.groupBy("j").agg(F.collect_list("i").alias("is"))
    right = placed.join(back, placed["cell"] == back["j"]).withColumn("i", F.explode("is")).withColumn("p", each_part("i"))
    right = right.where("i != j OR p != part").select("i", "p", "j", F.col("part").alias("q"), *[F.col(c).alias(c) for c in ("gloss", "vec")])

    def across(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        return best(some, others) if len(some) and len(others) else pd.DataFrame({c.split()[0]: [] for c in found.split(", ")})

    keys = ["i", "p", "j", "q"]
    near = own.unionByName(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(across, found))
    order = Window.partitionBy("gloss").orderBy(F.round("distance", 9), "other")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("gloss", "rank", "other", "distance")


def standardized(vectors: DataFrame, heavy: tuple[int, int] | None = None, weight: float = 2.0) -> DataFrame:
    """``vectors(gloss, vec)`` with each dimension brought to mean 0 and spread 1 over the classes.

    Dimensions from ``heavy[0]`` to before ``heavy[1]`` (those of the fingers) are then multiplied by ``weight``. One
    without spread is only centred. Means and spreads are one row.
    """
    each = vectors.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    one = each.agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("norms"))
    scale = F.lit(1.0) if heavy is None else None

    def norm(x, d):
        by = scale if scale is not None else F.when((d["i"] >= heavy[0]) & (d["i"] < heavy[1]), weight).otherwise(1.0)
        return (x - d["m"]) / F.when(d["s"] < 1e-6, 1.0).otherwise(d["s"]) * by

    return vectors.join(F.broadcast(one)).withColumn("vec", F.zip_with("vec", "norms", norm)).drop("norms")


def entropy_distinctiveness(scores: DataFrame) -> DataFrame:
    """From ``scores(gloss, p)``, a distribution for each clip: mean distribution's entropy and mean confidence, blended."""
    scores = written(scores.select("gloss", "p"), "scores")  # once: explode would compute a distribution for each entry
    conf = scores.groupBy("gloss").agg(F.avg(F.array_max("p")).alias("confidence"))
    each = scores.select("gloss", F.posexplode("p").alias("i", "x")).groupBy("gloss", "i").agg(F.avg("x").alias("x"))
    spread = each.groupBy("gloss").agg((-F.sum(F.col("x") * F.log(F.col("x") + 1e-10)) / F.log(F.count("*").cast("double"))).alias("entropy"))
    return spread.join(conf, "gloss").withColumn("score", 0.6 * F.col("entropy") + 0.4 * (1 - F.col("confidence")))


def rank_candidates(candidates: DataFrame, kept: DataFrame, blocks: int | None = None) -> DataFrame:
    """Candidates ``(gloss, vec, n)`` by distance from the vocabulary kept ``(gloss, vec)`` and by how many clips they have.

    Both have one row for each class and are cut into blocks by a hash of it. Each pair of blocks is a task that
    multiplies two matrices of bounded size and keeps each candidate's nearest class (of equal ones that with the larger
    name); the nearest of all blocks is an aggregate. Without any class kept there is no distance, and no row.
    """
    if blocks is None:
        blocks = max(1, -(-max(candidates.count(), kept.count()) // ONE_BLOCK))
    own = F.pmod(F.xxhash64("gloss"), F.lit(blocks)).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    vec = F.transform("vec", lambda x: x.cast("double")).alias("vec")
    left = candidates.select(F.col("gloss").alias("gloss"), vec, "n", own.alias("i"), others.alias("j"))
    right = kept.select(F.col("gloss").alias("other"), vec, own.alias("j"), others.alias("i"))

    def unit(pdf: pd.DataFrame) -> np.ndarray:
        x = np.stack(pdf["vec"].to_numpy())
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, size, out=np.zeros_like(x), where=size > 0)

    def run(some: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        if some.empty or have.empty:
            return pd.DataFrame({"gloss": [], "n": [], "sim": [], "other": []})
        have = have.sort_values("other", ascending=False)
        sims = unit(some) @ unit(have).T
        best = np.argmax(np.round(sims, 9), axis=1)
        return pd.DataFrame({"gloss": some["gloss"], "n": some["n"], "sim": sims[np.arange(len(some)), best], "other": have["other"].to_numpy()[best]})

    near = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(run, "gloss string, n long, sim double, other string")
    best = near.groupBy("gloss").agg(F.max("sim").alias("similarity"), F.max_by("other", F.struct(F.round("sim", 9), "other")).alias("nearest"), F.first("n").alias("n"))
    out = best.withColumn("distinct", 1 - F.col("similarity")).withColumn("samples", F.least(F.log10(F.col("n") + 1.0) / 2, F.lit(1.0)))
    score = 0.7 * F.col("distinct") + 0.3 * F.col("samples")
    return out.withColumn("score", score).withColumn("advice", F.when(score >= 0.6, "YES").when(score >= 0.4, "MAYBE").otherwise("NO"))


def select_next(ranked: DataFrame, n: int) -> DataFrame:
    """The best ``n`` candidates: YES first, then MAYBE."""
    order = F.when(F.col("advice") == "YES", 0).otherwise(1)
    return ranked.where("advice != 'NO'").orderBy(order, F.desc(F.round("score", 9)), "gloss").limit(n)


#: Rounds of the greedy choice after which the distances so far are written.
ROUNDS_A_TABLE = 8


def _unit(vec: Column) -> Column:
    """The vector with length 1; one without length stays."""
    x = F.transform(vec, lambda v: v.cast("double"))
    size = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(x, lambda v: F.when(size > 0, v / size).otherwise(v))


def _dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def farthest_pair(vectors: DataFrame, blocks: int | None = None) -> DataFrame:
    """The two classes of each domain that are farthest apart by cosine: ``vectors(domain, gloss, vec)`` to ``(domain, a, b)``.

    Blocks of classes are multiplied as in :func:`pairwise_distance`; a pair of blocks gives one pair for each domain, not
    its distances. Ties go to the smaller names. Domains of one class have no pair.
    """
    if blocks is None:
        blocks = max(1, -(-vectors.count() // ONE_BLOCK))
    block = F.pmod(F.xxhash64("gloss"), F.lit(blocks)).cast("int")
    rows = vectors.select("domain", "gloss", _unit(F.col("vec")).alias("vec"), block.alias("k"))
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    sent = rows.withColumn("o", others).select("domain", "gloss", "vec", "k", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("gloss")
        names, x, k = pdf["gloss"].to_numpy(), np.stack(pdf["vec"].to_numpy()), pdf["k"].to_numpy()
        left, right = np.flatnonzero(k == pdf["i"].iloc[0]), np.flatnonzero(k == pdf["j"].iloc[0])
        d = np.round(1 - x[left] @ x[right].T, 9)
        d[names[left][:, None] == names[right][None, :]] = -1
        most = d.max(initial=-1)
        if most < 0:
            return pd.DataFrame([], columns=["domain", "a", "b", "distance"])
        a, b = min(tuple(sorted((names[left[p]], names[right[q]]))) for p, q in np.argwhere(d == most))
        return pd.DataFrame({"domain": [pdf["domain"].iloc[0]], "a": [a], "b": [b], "distance": [most]})

    kind = vectors.schema["domain"].dataType.simpleString()
    best = sent.groupBy("domain", "i", "j").applyInPandas(run, f"domain {kind}, a string, b string, distance double")
    pair = F.min_by(F.struct("a", "b"), F.struct(-F.col("distance"), "a", "b")).alias("p")
    return best.groupBy("domain").agg(pair).select("domain", "p.a", "p.b")


def farthest_point(vectors: DataFrame, k: int, seed: str = "center") -> DataFrame:
    """``k`` classes of each domain, each as far as can be from those before: ``vectors(domain, gloss, vec)``, one vector a class.

    Distance is ``1 - cosine``, to nine places. The choice starts from the class nearest to all on average (``center``)
    or from the farthest pair (``dispersion``); ties go to the smaller name. Returns ``(domain, rank, gloss)``.

    Every class carries its distance to the nearest chosen one. A round is one aggregate over all domains, combined before
    the shuffle, that picks the farthest class of each, and a join of the classes with the picks (one row for each domain);
    distances to all pairs are never held. The average distance to all comes from the sum of a domain's vectors.
    """
    own = written(vectors.select("domain", "gloss", _unit(F.col("vec")).alias("vec")), "units")
    picked: list[DataFrame] = []

    def take(picks: DataFrame) -> DataFrame:
        """Note the picks, and give the distances that they leave."""
        picks = written(picks, "picks")
        picked.append(picks.select("domain", F.lit(len(picked) + 1).cast("long").alias("rank"), "gloss"))
        return picks.select("domain", F.col("gloss").alias("pick"), F.col("vec").alias("to"))

    def nearer(state: DataFrame, to: DataFrame) -> DataFrame:
        joined = state.join(to, "domain", "left").where(F.coalesce(F.col("gloss") != F.col("pick"), F.lit(True)))
        return joined.select("domain", "gloss", "vec", F.least("near", 1 - _dot("vec", "to")).alias("near"))

    state = own.withColumn("near", F.lit(None).cast("double"))
    if seed == "center":
        each = own.select("domain", F.posexplode("vec").alias("i", "x")).groupBy("domain", "i").agg(F.sum("x").alias("x"))
        total = each.groupBy("domain").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("all"))
        size = own.groupBy("domain").agg(F.count("*").alias("n"))
        # of the sum of 1 - cosine to all n classes, the class's own share (0, or 1 without a direction) is taken away
        itself = F.when(_dot("vec", "vec") > 0, 0).otherwise(1)
        mean = (F.col("n") - _dot("vec", "all") - itself) / F.greatest(F.col("n") - 1, F.lit(1))
        first = own.join(total.join(size, "domain"), "domain").withColumn("mean", F.round(mean, 9))
        firsts = [first.groupBy("domain").agg(F.min_by(F.struct("gloss", "vec"), F.struct("mean", "gloss")).alias("s")).select("domain", "s.*")]
    else:
        pair = written(farthest_pair(own), "pair")
        firsts = [own.join(pair.select("domain", F.col(x).alias("gloss")), ["domain", "gloss"]) for x in "ab"]
    for f in firsts:
        state = nearer(state, take(f))
    while len(picked) < k:
        if len(picked) % ROUNDS_A_TABLE == 0:
            state = written(state, "distances")
        order = F.struct(-F.round("near", 9), "gloss")
        to = take(state.groupBy("domain").agg(F.min_by(F.struct("gloss", "vec"), order).alias("s")).select("domain", "s.*"))
        if to.isEmpty():  # every class of every domain is chosen
            break
        state = nearer(state, to)
    return reduce(DataFrame.unionByName, picked[:k]) if picked[:k] else own.select("domain", F.lit(0).cast("long").alias("rank"), "gloss").where("false")


def chosen_set_distances(distances: DataFrame, chosen: DataFrame) -> DataFrame:
    """Smallest, mean and largest distance inside ``chosen(gloss)``, and its closest pair."""
    a, b = chosen.select(F.col("gloss").alias("a")), chosen.select(F.col("gloss").alias("b"))
    inside = distances.join(a, "a").join(b, "b")
    return inside.agg(
        F.count("*").alias("pairs"), F.min("distance").alias("least"), F.avg("distance").alias("mean"), F.max("distance").alias("most"),
        F.min_by(F.concat_ws("/", "a", "b"), F.struct(F.round("distance", 9), "a", "b")).alias("closest"),
    )


def domain_lists(candidates: DataFrame, ranked: DataFrame, forced: DataFrame, common: DataFrame, k: int) -> DataFrame:
    """``k`` classes of each domain: forced ones first, then by rank; common ones are left out."""
    pool = candidates.join(common.select("gloss"), "gloss", "left_anti")
    marked = pool.join(forced.select("domain", "gloss", F.lit(0).alias("part")), ["domain", "gloss"], "left").join(ranked, ["domain", "gloss"], "left")
    order = Window.partitionBy("domain").orderBy(F.coalesce("part", F.lit(1)), F.col("rank").asc_nulls_last(), "gloss")
    return marked.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k).select("domain", "pos", "gloss")


_BANDS = (("0-70", 0.0, 70.0), ("70-80", 70.0, 80.0), ("80-85", 80.0, 85.0), ("85-90", 85.0, 90.0), ("90-100", 90.0, 101.0))


def expected_top3(sentences: DataFrame, profiles: DataFrame, unknown: float = 50.0) -> DataFrame:
    """Mean top-3 rate of the signs of each sentence ``(sentence_id, sign)``; unknown signs count as ``unknown``."""
    rated = sentences.join(profiles.select("sign", "top3_hit_rate"), "sign", "left")
    return rated.groupBy("sentence_id").agg(F.avg(F.coalesce("top3_hit_rate", F.lit(unknown))).alias("expected"))


def accuracy_bands(sentences: DataFrame, profiles: DataFrame) -> DataFrame:
    """Sentences by their expected top-3 rate, in fixed bands; empty bands are kept."""
    e = expected_top3(sentences, profiles)
    bands = sentences.sparkSession.createDataFrame(list(_BANDS), "band string, lo double, hi double")
    number = F.lit(None).cast("string")
    for name, lo, hi in _BANDS:
        number = F.when((F.col("expected") >= lo) & (F.col("expected") < hi), name).otherwise(number)
    found = e.withColumn("band", number).groupBy("band").agg(F.count("*").alias("n"), F.avg("expected").alias("mean"), F.stddev_samp("expected").alias("std"))
    return bands.select("band").join(found, "band", "left").withColumn("n", F.coalesce("n", F.lit(0)))
