"""Operators against hand-made cases, plain Python and the properties they promise."""

import datetime
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossmill.functions import distributions as D
from glossmill.functions import geometry as G
from glossmill.functions import text as T
from glossmill.functions.bleu import sentence_bleu
from glossmill.operators import evalreport, segments, splits, statistics, vocab
from glossmill.operators import landmarks as L
from glossmill.plans import proxies as P
from glossmill.plans import q_captions
from glossmill.sources import readers
from glossmill.streaming import captions as C

SF = "/root/testdata/sf0.001"


def one(spark, **columns):
    """A row of the expressions."""
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_ctqi_grid(spark):
    cases = [(100, 100, 100, 100, 100), (0, 100, 100, 0, 0), (100, 0, 100, 0, 0), (100, 100, 0, 50, 50), (50, 100, 100, 50, 37.5), (50, 50, 50, 18.75, 15.625)]
    for ga, cf1, p, v2, v3 in cases:
        r = one(spark, a=T.ctqi_v2(*map(F.lit, (ga, cf1, p))), b=T.ctqi_v3(*map(F.lit, (ga, cf1, p))))
        assert (r.a, r.b) == (pytest.approx(v2), pytest.approx(v3))
        assert 0 <= r.b <= r.a + 1e-9 <= 100 + 1e-9


def test_coverage_and_accuracy(spark):
    ref, hyp = T.content_words(F.lit("The man is walking before the dance!")), T.content_words(F.lit("A man walked to dance."))
    r = one(spark, c=T.coverage(ref, hyp)).c
    assert (r.recall, r.precision, r.missing_words, r.hallucinated_words) == (100.0, 100.0, [], [])
    a = one(spark, g=T.gloss_accuracy(F.array(F.lit("walk"), F.lit("DANCE"), F.lit("X")), F.array(F.lit("WALK "), F.lit("EAT")))).g
    assert (a.accuracy, a.correct, a.total) == (50.0, 1, 2) and [m.original for m in a.mismatches] == ["EAT", "[NONE]"]
    empty = F.array().cast("array<string>")
    e = one(spark, g=T.gloss_accuracy(empty, empty), p=T.perfect_translation(empty, empty), c=T.coverage(empty, hyp))
    assert (e.g.accuracy, e.p, e.c.recall, e.c.f1) == (0.0, 0.0, 0.0, 0.0)


def test_answers(spark):
    fenced = '```json\n{"sentence": "He walks.", "selections": ["WALK"]}\n```'
    r = one(spark, a=T.parse_response(F.lit(fenced)), b=T.parse_response(F.lit("just text")), c=T.parse_score(F.lit("Score: 87.5 of 100")), d=T.parse_score(F.lit('{"overall": 130}')))
    assert (r.a.sentence, r.a.selections, r.b.sentence, r.c, r.d) == ("He walks.", ["WALK"], "just text", 87.5, 100.0)
    tops = F.array(F.array(F.lit("RUN"), F.lit("WALK")), F.array(F.lit("BEFORE")))
    none = F.array().cast("array<string>")
    e = one(spark, a=T.effective_glosses(tops, none, F.lit("He walks.")), b=T.effective_glosses(tops, F.array(F.lit("he"), F.lit("walks")), F.lit("He walks.")))
    assert (e.a, e.b) == (["WALK", "BEFORE"], ["HE", "WALKS"])
    assert one(spark, w=T.wrap_text(F.lit("aaa bb cccc d"), 6)).w == "aaa bb\ncccc d"


def test_bleu():
    same = "the man walks before the dance".split()
    assert sentence_bleu(same, same) == pytest.approx(100)
    assert sentence_bleu([], same) == 0 and sentence_bleu("x y".split(), same) == 0
    half = sentence_bleu("the man eats".split(), "the man walks".split())
    assert half == pytest.approx(100 * (2 / 3 * 1 / 2 * 1 / 2) ** (1 / 3))
    short = sentence_bleu("the man".split(), "the man walks".split())
    assert short == pytest.approx(100 * math.exp(1 - 3 / 2))


def test_user_scorer(spark):
    score = evalreport.scorer(lambda s: s.str.len().where(s.str.len() > 3), lambda s: s.str.len() * 0.0)
    rows = spark.createDataFrame([("abcd",), ("ab",)], "s string").select(score(F.col("s")).alias("x")).collect()
    assert [r.x for r in rows] == [4.0, 0.0]


@pytest.mark.parametrize("make", [splits.stratified_family_split, splits.rounded_split, splits.simple_split])
def test_split_is_a_partition(spark, make):
    fams = splits.families(P.clips(spark, SF))
    out = make(fams).collect()
    assert len(out) == fams.count() == len({(r.gloss, r.video_id) for r in out})
    by: dict = {}
    for r in out:
        by.setdefault(r.gloss, set()).add(r.split)
    sizes = {r.gloss: r["count"] for r in fams.groupBy("gloss").count().collect()}
    assert all(by[g] == {"train", "val", "test"} for g, n in sizes.items() if n >= 3)
    assert sorted(map(tuple, make(fams).collect())) == sorted(map(tuple, out))


def test_family_split_does_not_leak_and_the_control_does(spark):
    clips = P.clips(spark, SF)
    good = splits.assign(clips, splits.stratified_family_split(splits.families(clips)))
    assert splits.leaky_overlap(good).count() == 0
    bad = clips.withColumn("clip_id", F.concat("clip_id", F.lit("x"))).unionByName(clips)
    assert splits.leaky_overlap(splits.leaky_split(bad)).count() > 0


def test_signer_aware_split_keeps_groups_whole(spark):
    out = splits.signer_aware_split(P.clips(spark, SF).select("gloss", "video_id").distinct(), gap=40)
    rows = out.where("NOT is_copy").collect()
    where: dict = {}
    for r in rows:
        where.setdefault((r.gloss, r.signer_group), set()).add(r.split)
    groups = {r.gloss: len({x.signer_group for x in rows if x.gloss == r.gloss}) for r in rows}
    assert all(len(s) == 1 for (g, _), s in where.items() if groups[g] > 2)


def test_augmentation_sequence_counts(spark):
    out = splits.augmentation_sequence(spark.createDataFrame([("a", 5), ("b", 100)], "key string, n int")).collect()
    for key, n in (("a", 5), ("b", 100)):
        assert sorted(r.aug_no for r in out if r.key == key) == list(range(n))
    assert {r.technique for r in out if r.key == "b"} == {t for t, _ in splits.TECHNIQUES}


def test_smooth_pads_with_zeros(spark):
    v = np.array([5.0, 1, 2, 8, 3, 0, 7])
    rows = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "clip_id long, frame_idx long, v double")
    for w in (5, 4):
        got = [r.smooth for r in segments.smooth(rows, w).orderBy("frame_idx").collect()]
        assert got == pytest.approx(np.convolve(v, np.ones(w) / w, "same"))


def test_motion_segments(spark):
    moves = [0, 1, 1, 1, 0, 0, 0, 1, 0, 1, 1, 0, 0, 0, 0, 1]
    rows = spark.createDataFrame([(1, i, bool(m), len(moves)) for i, m in enumerate(moves)], "clip_id long, frame_idx long, moves boolean, n_frames long")
    got = [(r.start_frame, r.end_frame) for r in segments.motion_segments(rows, 2, 60, 3, 1).orderBy("seg_no").collect()]
    assert got == [(0, 4), (6, 11)]


def test_merge_short_intervals(spark):
    rows = spark.createDataFrame([(1, 0, 300), (1, 500, 900), (1, 1300, 1500), (1, 9000, 9100)], "video_id long, start_ms long, end_ms long")
    got = [(r.start_ms, r.end_ms) for r in segments.merge_short_intervals(rows).orderBy("start_ms").collect()]
    assert got == [(0, 1500), (9000, 9100)]


def plain_merge(rows, merges, ends):
    out = []
    for video, a, b in sorted(rows):
        if out and out[-1][0] == video and merges(out[-1][1], out[-1][2], a, b):
            out[-1][2:] = [ends(out[-1][2], b), out[-1][3] + 1]
        else:
            out.append([video, a, b, 1])
    return sorted(map(tuple, out))


@pytest.mark.parametrize("block_rows", [50_000, 40, 7])
def test_walks_in_blocks(spark, block_rows):
    """One video holds most intervals; some stretches never let a block forget what was before it."""
    rng = np.random.default_rng(13)
    rows = []
    for video, n in ((1, 400), (2, 5), (3, 60), (4, 1)):
        starts = np.cumsum(rng.integers(0, 700 if video != 3 else 40, n))
        rows += [(video, int(a), int(a + rng.integers(1, 1200 if video != 3 else 30))) for a in starts]
    df = spark.createDataFrame(rows, "video_id long, start_ms long, end_ms long").repartition(4)
    got = sorted(map(tuple, segments.merge_short_intervals(df, 100, 900, block_rows).collect()))
    assert got == plain_merge(rows, lambda s, e, a, b: a - e <= 100 and e - s < 900 and b - a < 900, max)
    got = sorted(map(tuple, segments.merge_annotations(df, 50, 300, 250, block_rows).collect()))
    assert got == plain_merge(rows, lambda s, e, a, b: a - e < 50 or (a - e < 300 and (e - s < 250 or b - a < 250)), lambda e, b: b)
    frames = spark.createDataFrame([(c, i, float(v)) for c in (1, 2) for i, v in enumerate(rng.integers(0, 4, 300))], "clip_id long, frame_idx long, v double")
    one = sorted(map(tuple, segments.valleys(frames, 2, 0.5, 4).collect()))
    assert one == sorted(map(tuple, segments.valleys(frames, 2, 0.5, 4, block_rows).collect())) and len(one) > 60
    assert all(b[1] - a[1] >= 4 for a, b in zip(one, one[1:]) if a[0] == b[0])
    assert segments.merge_short_intervals(df.where("false")).collect() == []


def test_distributions():
    assert D.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert D.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)
    assert D.binomial_greater(8, 10) == pytest.approx(56 / 1024)
    assert D.mcnemar_exact(1, 5) == pytest.approx(2 * 7 / 64)
    assert D.sample_size(0.8, 0.5, 1.0) == 32
    assert D.ks_two_sided(0.0, 5, 5) == 1.0


def test_average_rank_and_wilcoxon(spark):
    rows = spark.createDataFrame([("m", float(x)) for x in [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5]], "g string, x double")
    got = sorted((r.x, r["rank"]) for r in statistics.average_rank(rows, "x", ["g"]).collect())
    assert got == [(1, 1.5), (1, 1.5), (2, 3), (3, 4.5), (3, 4.5), (4, 6), (5, 8), (5, 8), (5, 8), (6, 10), (9, 11)]


def test_rank_statistics_read_their_input_once(spark, tmp_path):
    """Ranks, ties and correlations by brute force; the plans start from written counts, not from the input again."""
    rng = np.random.default_rng(14)
    x, y = rng.integers(0, 30, 300), rng.integers(0, 20, 300)
    y = x // 3 + y
    spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y)], "human long, s long").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    out = statistics.correlations(df, "human", ["s"])
    assert str(tmp_path) not in out._jdf.queryExecution().optimizedPlan().toString() and len(out.inputFiles()) > 0
    assert not any(str(tmp_path) in f for f in out.inputFiles())

    def ranks(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    r = out.first()
    assert r.pearson == pytest.approx(np.corrcoef(x, y)[0, 1]) and r.spearman == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])
    w = statistics.wilcoxon(df.selectExpr("'m' AS metric", "s AS model", "human AS baseline")).first()
    d = (y - x)[y != x]
    assert (w.n, w.w_plus, w.w_minus) == (len(d), ranks(abs(d))[d > 0].sum(), ranks(abs(d))[d < 0].sum())
    assert w.ties == sum(c**3 - c for c in np.unique(abs(d), return_counts=True)[1])


def test_bootstrap_interval_holds_the_mean(spark):
    draw = np.random.default_rng(1).normal(10, 2, 200)
    rows = spark.createDataFrame([("m", float(x), i) for i, x in enumerate(draw)], "metric string, value double, id long")
    r = statistics.bootstrap_bca(rows, 500).first()
    se = draw.std() / math.sqrt(len(draw))
    assert r.ci_low < draw.mean() < r.ci_high
    assert r.ci_high - r.ci_low == pytest.approx(2 * 1.96 * se, rel=0.25)


def test_bootstrap_does_not_depend_on_partitions(spark):
    rows = spark.range(300).select(F.lit("m").alias("metric"), (F.col("id") % 17).cast("double").alias("value"), "id")
    assert statistics.bootstrap_bca(rows.repartition(7), 300).collect() == statistics.bootstrap_bca(rows.coalesce(1), 300).collect()


def test_p_values(spark):
    rng = np.random.default_rng(4)
    diffs = {"up": np.round(rng.normal(1, 3, 60), 1), "none": np.round(rng.normal(0, 1, 40), 1), "flat": np.zeros(5)}
    rows = [(m, 10.0, 10.0 + float(x)) for m, d in diffs.items() for x in d]
    got = {r.metric: r for r in statistics.p_values(spark.createDataFrame(rows, "metric string, baseline double, model double")).collect()}
    for m, d in diffs.items():
        n, kept = len(d), np.round(d[d != 0], 9)
        if not len(kept):
            assert (got[m].p_t, got[m].p_wilcoxon, got[m].p_bonferroni) == (1.0, 1.0, 1.0)
            continue
        t = d.mean() / (d.std(ddof=1) / math.sqrt(n))
        grid = np.linspace(0, abs(t), 200_001)
        density = math.exp(math.lgamma(n / 2) - math.lgamma((n - 1) / 2)) / math.sqrt((n - 1) * math.pi) * (1 + grid**2 / (n - 1)) ** (-n / 2)
        p_t = 1 - 2 * float(((density[1:] + density[:-1]) / 2).sum() * (grid[1] - grid[0]))
        size = np.abs(kept)
        rank = np.array([(size < x).sum() + ((size == x).sum() + 1) / 2 for x in size])
        w, k = min(rank[kept > 0].sum(), rank[kept < 0].sum()), len(kept)
        ties = sum(float(c) ** 3 - c for c in np.unique(size, return_counts=True)[1])
        z = (w - k * (k + 1) / 4) / math.sqrt(k * (k + 1) * (2 * k + 1) / 24 - ties / 48)
        better = int((d > 0).sum())
        assert got[m].p_t == pytest.approx(p_t, abs=1e-7)
        assert got[m].p_wilcoxon == pytest.approx(math.erfc(-z / math.sqrt(2)), abs=1e-6)
        assert got[m].p_binomial == pytest.approx(sum(math.comb(n, i) for i in range(better, n + 1)) / 2**n, abs=1e-9)
        assert got[m].p_bonferroni == pytest.approx(min(1, 3 * p_t), abs=1e-6)


def test_pca_weights(spark):
    x = np.random.default_rng(2).normal(0, 1, (200, 1)) * [1, 2, -1] + np.random.default_rng(3).normal(0, 1, (200, 3))
    got = statistics.pca_weights(spark.createDataFrame(x.tolist(), "a double, b double, c double"), ["a", "b", "c"])
    v, corr = np.ones(3) / 3, np.corrcoef(x.T)
    v[2] = -v[2]
    for _ in range(500):
        v = corr @ v
        v /= np.linalg.norm(v)
    assert got["weight"].tolist() == pytest.approx((np.abs(v) / np.abs(v).sum()).tolist())
    assert got["explained"][0] == pytest.approx(float(v @ corr @ v) / 3)


def test_repetition(spark):
    rows = [(1, i, math.sin(2 * math.pi * i / 8)) for i in range(64)] + [(2, i, float(i == 3)) for i in range(40)] + [(3, i, 1.0) for i in range(10)]
    out = L.repetition(spark.createDataFrame(rows, "clip_id long, frame_idx long, v double"), F.col("v"))
    assert {r.clip_id: r.period for r in out.collect()} == {1: 8, 2: 0, 3: 0}


def test_wrapped_lines(spark):
    texts = ["", "a", "one two three four", "averyveryverylongword b", "x " * 40, None]
    for width in (5, 12, 50):
        got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.wrap_text(F.col("t"), width).alias("w"))
        for i, w in got.collect():
            lines = []
            for word in (texts[i] or "").split():
                if lines and len(lines[-1]) + 1 + len(word) <= width:
                    lines[-1] += " " + word
                else:
                    lines.append(word)
            assert w == "\n".join(lines)


def test_design_dataset(spark):
    pool = spark.createDataFrame([(f"e{i}", "easy") for i in range(4)] + [(f"h{i}", "hard") for i in range(3)], "gloss string, difficulty string")
    got = [tuple(r.glosses) for r in splits.design_dataset(pool, {"easy": 2, "hard": 1}, 18).collect()]
    assert len(set(got)) == 18 and all([g[0] for g in c] == ["e", "e", "h"] for c in got)
    with pytest.raises(ValueError, match="only 18"):
        splits.design_dataset(pool, {"easy": 2, "hard": 1}, 19)


def test_rank_candidates_in_blocks(spark):
    rng = np.random.default_rng(6)
    some = spark.createDataFrame([(f"c{i}", rng.normal(size=4).tolist(), i) for i in range(30)], "gloss string, vec array<double>, n long")
    kept = spark.createDataFrame([(f"k{i}", rng.normal(size=4).tolist()) for i in range(20)] + [("zero", [0.0] * 4)], "gloss string, vec array<double>")
    one, three = (sorted(map(tuple, vocab.rank_candidates(some, kept, b).select("gloss", "nearest", "n", F.round("score", 9)).collect())) for b in (1, 3))
    assert len(one) == 30 and one == three


def plain_choice(names, x, k, seed):
    """The greedy choice over the full matrix, as one would write it for a small one."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    d = np.round(1 - u @ u.T, 9)
    np.fill_diagonal(d, 0)
    if seed == "center":
        chosen = [int(np.argmin(np.round(d.sum(1) / max(len(x) - 1, 1), 9)))]
    else:
        chosen = [int(i) for i in np.unravel_index(np.argmax(d), d.shape)]
    while len(chosen) < min(k, len(x)):
        near = d[chosen].min(0)
        near[chosen] = -1
        chosen.append(int(np.argmax(near)))
    return [names[i] for i in chosen[:k]]


@pytest.mark.parametrize("seed", ["center", "dispersion"])
def test_farthest_point(spark, seed, monkeypatch):
    monkeypatch.setattr(vocab, "ROUNDS_A_TABLE", 3)
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for domain, n in (("x", 40), ("y", 7), ("z", 3)):
        x = rng.normal(size=(n, 5))
        x[1] = x[0] * 2  # a tie
        names = [f"{domain}{i:02}" for i in range(n)]
        rows += [(domain, a, v.tolist()) for a, v in zip(names, x)]
        want[domain] = plain_choice(names, x, 10, seed)
    df = spark.createDataFrame(rows, "domain string, gloss string, vec array<double>").repartition(3)
    got = vocab.farthest_point(df, 10, seed).orderBy("rank").collect()
    assert {d: [r.gloss for r in got if r.domain == d] for d in want} == want
    one, more = (sorted(map(tuple, vocab.farthest_pair(df, b).collect())) for b in (1, 4))
    assert one == more


def test_farthest_point_of_many_classes(spark):
    """20,000 classes in one domain, from their vectors; no step sees them all in one group."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(20_000, 6)).round(3)
    df = spark.createDataFrame([("d", f"g{i:05}", v) for i, v in enumerate(x.tolist())], "domain string, gloss string, vec array<double>")
    got = [r.gloss for r in vocab.farthest_point(df, 4).orderBy("rank").collect()]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    chosen = [int(np.argmin(np.round((len(u) - u @ u.sum(0)) / (len(u) - 1), 9)))]
    while len(chosen) < 4:
        near = np.round(1 - (u @ u[chosen].T).max(1), 9)
        near[chosen] = -1
        chosen.append(int(np.argmax(near)))
    assert got == [f"g{i:05}" for i in chosen]


def test_augmentation_is_repeatable_and_keeps_unseen_points():
    x = np.random.default_rng(0).normal(0, 1, (12, 10, 3))
    x[:, 3] = 0
    for technique, _ in splits.TECHNIQUES:
        a, b = (L.augment(x, technique, np.random.default_rng(5)) for _ in range(2))
        assert np.array_equal(a, b) and np.isfinite(a).all()
        assert (a[:, 3, :2] == 0).all()
        assert len(a) == len(x) or technique == "speed"
    assert np.array_equal(L.augment(L.augment(x, "flip", None), "flip", None), x)


def test_augmentation_values():
    """Hands keep their wrists, a view from the side keeps distances, levels follow the number, hands drop in turn."""
    x = np.random.default_rng(1).normal(0, 1, (6, 83, 3))
    out = L.augment(x, "proportion", np.random.default_rng(2))
    for start, end in L.HANDS:
        k = np.linalg.norm(out[:, start + 1 : end] - out[:, start : start + 1], axis=-1) / np.linalg.norm(x[:, start + 1 : end] - x[:, start : start + 1], axis=-1)
        assert np.allclose(out[:, start], x[:, start]) and np.allclose(k, k[0, 0]) and 0.8 <= k[0, 0] <= 1.2
    assert np.allclose(out[:, :33].mean(1), x[:, :33].mean(1)) and np.array_equal(out[:, 75:], x[:, 75:])
    turned = L.augment(x, "viewpoint", np.random.default_rng(3))
    assert np.allclose(np.linalg.norm(turned[:, 1] - turned[:, 0], axis=-1), np.linalg.norm(x[:, 1] - x[:, 0], axis=-1)) and not np.allclose(turned[..., 2], x[..., 2])
    plain, both = (L.augment(x, t, np.random.default_rng(4)) for t in ("geometric", "combined"))
    assert not np.allclose(plain, both) and np.allclose((both - both.mean((0, 1))) / (plain - plain.mean((0, 1))), (both - both.mean((0, 1)))[0, 0, 0] / (plain - plain.mean((0, 1)))[0, 0, 0])
    spreads = [(L.augment(x, "noise", np.random.default_rng(5), k) - x).std() for k in range(3)]
    assert np.allclose(spreads, [0.01, 0.02, 0.03], rtol=0.1)
    assert [int((L.augment(x, "occlusion", np.random.default_rng(6), k)[0] == 0).all(-1).sum()) for k in range(3)] == [12, 20, 29]
    assert [[(L.augment(x, "hand_drop", None, k)[:, a:b] == 0).all() for a, b in L.HANDS] for k in range(2)] == [[True, False], [False, True]]
    assert [len(L.augment(x, "speed", None, k)) for k in range(2)] == [8, 4]


def test_prediction_and_entry_readers(spark, tmp_path):
    row = {"sample_id": "a", "entry_id": 1, "top_k": [{"gloss": "EAT", "confidence": 0.5}]}
    (tmp_path / "lines.json").write_text("\n" + "\n".join(json.dumps(row | {"entry_id": i}) for i in range(3)))
    (tmp_path / "array.json").write_text(json.dumps([row | {"entry_id": i} for i in range(3)], indent=1))
    for name in ("lines", "array"):
        assert [r.entry_id for r in readers.read_predictions(spark, str(tmp_path / f"{name}.json")).orderBy("entry_id").collect()] == [0, 1, 2]
    entry = {"entry_id": 1, "glosses": ["EAT"], "model_bleu": 2.5, "gloss_mismatches": [{"position": 0, "predicted": "A", "original": "B"}]}
    many = [entry | {"entry_id": i} for i in range(3)]
    shapes = {"l": "\n".join(map(json.dumps, many)), "a": json.dumps(many, indent=2), "e": json.dumps({"entries": many}), "r": json.dumps({"results": many, "n": 3}, indent=2)}
    for name, text in shapes.items():
        (tmp_path / f"{name}.json").write_text(text)
        got = readers.read_eval_entries(spark, str(tmp_path / f"{name}.json")).orderBy("entry_id").collect()
        assert [(r.entry_id, r.model_bleu, r.gloss_mismatches[0].original) for r in got] == [(i, 2.5, "B") for i in range(3)]


def test_hands_open_and_closed(spark):
    def hand(bend):
        out = [[0.0, 0.0, 0.0]]
        for f in range(5):
            x, y = 0.02 * (f - 2), 0.08
            for k in range(4):
                out.append([x + 0.01 * k * (f - 2) * (1 - bend), y + (0.03 * k if not bend else 0.02 * (k % 2)), 0.0])
        return out

    rows = spark.createDataFrame([("open", hand(0)), ("fist", hand(1))], "h string, kp array<array<double>>")
    f = G.hand_features(F.col("kp"))
    got = {r.h: r for r in rows.select("h", *[f[n].alias(n) for n in ("ext_index", "openness")]).collect()}
    assert got["open"].ext_index > 0.95 > 0.6 > got["fist"].ext_index
    assert got["open"].openness > got["fist"].openness
    assert len(f) == 15


def test_sources(spark, tmp_path):
    (tmp_path / "map.json").write_text(json.dumps({"1": {"gloss": "EAT"}, "2": "GO"}))
    assert {(r.video_id, r.gloss) for r in readers.read_video_mapping(spark, str(tmp_path / "map.json")).collect()} == {("1", "EAT"), ("2", "GO")}
    (tmp_path / "inst.json").write_text(json.dumps([{"gloss": "EAT", "instances": [{"video_id": "a", "signer_id": 3}, {"video_id": "b", "signer_id": 4}]}]))
    assert readers.read_gloss_instances(spark, str(tmp_path / "inst.json")).count() == 2
    (tmp_path / "split.json").write_text(json.dumps({"7": {"subset": "train", "action": [1, 5]}, "8": {"subset": "val", "action": []}}))
    (tmp_path / "classes.tsv").write_text("0\tEAT\n1\tGO\n")
    got = readers.read_split_json(spark, str(tmp_path / "split.json"), str(tmp_path / "classes.tsv")).collect()
    assert {(r.video_id, r.subset, r.gloss) for r in got} == {("7", "train", "GO"), ("8", "val", None)}
    for k, shape in enumerate(({"0": "EAT", "1": "GO"}, {"EAT": 0, "GO": 1}, {"classes": ["EAT", "GO"]})):
        (tmp_path / f"v{k}.json").write_text(json.dumps(shape))
        assert {(r.class_idx, r.gloss) for r in readers.read_vocabulary(spark, str(tmp_path / f"v{k}.json")).collect()} == {(0, "EAT"), (1, "GO")}
    np.save(tmp_path / "clip1.npy", np.ones((2, 75, 2)))
    np.save(tmp_path / "clip2.npy", np.array([[np.nan, 1.0]] * 75))
    clips = readers.read_clip_blobs(spark, str(tmp_path)).collect()
    assert sorted((r.clip_id, r.frame_idx, len(r.kp), len(r.kp[0]), r.kp[0][0]) for r in clips) == [("clip1", 0, 83, 3, 1.0), ("clip1", 1, 83, 3, 1.0), ("clip2", 0, 83, 3, 0.0)]


def test_annotations(spark, tmp_path):
    (tmp_path / "vid9.xml").write_text(
        """<ANNOTATION_DOCUMENT><TIME_ORDER><TIME_SLOT TIME_SLOT_ID="t1" TIME_VALUE="100"/><TIME_SLOT TIME_SLOT_ID="t2" TIME_VALUE="900"/></TIME_ORDER>
        <TIER TIER_ID="gloss"><ANNOTATION><ALIGNABLE_ANNOTATION ANNOTATION_ID="a1" TIME_SLOT_REF1="t1" TIME_SLOT_REF2="t2"><ANNOTATION_VALUE>EAT</ANNOTATION_VALUE></ALIGNABLE_ANNOTATION></ANNOTATION>
        <ANNOTATION><ALIGNABLE_ANNOTATION ANNOTATION_ID="a2" TIME_SLOT_REF1="t2" TIME_SLOT_REF2="t2"><ANNOTATION_VALUE>X</ANNOTATION_VALUE></ALIGNABLE_ANNOTATION></ANNOTATION></TIER>
        <TIER TIER_ID="other"><ANNOTATION><ALIGNABLE_ANNOTATION ANNOTATION_ID="a3" TIME_SLOT_REF1="t1" TIME_SLOT_REF2="t2"><ANNOTATION_VALUE></ANNOTATION_VALUE></ALIGNABLE_ANNOTATION></ANNOTATION></TIER></ANNOTATION_DOCUMENT>"""
    )
    got = readers.read_annotations(spark, str(tmp_path / "vid9.xml")).collect()
    assert [(r.video_id, r.annotation_id, r.text, r.start_ms, r.end_ms) for r in got] == [("vid9", "a1", "EAT", 100, 900)]


def test_trigger_buffer():
    b = C.TriggerBuffer()
    said = []
    for t, w in [(0, "I"), (0.5, "GO"), (0.9, "HOME"), (2, "YOU"), (2.4, "WHERE"), (3, "EAT"), (9, "FINISH"), (20, "A"), (30.5, "B")]:
        said += b.word(t, w, 0.5)
    said += b.silence(math.inf)
    want = [("I GO HOME", "full"), ("YOU WHERE", "question"), ("EAT", "idle"), ("FINISH", "end"), ("A", "timeout"), ("B", "timeout")]
    assert [(x[1], x[4]) for x in said] == want
    assert C.TriggerBuffer().silence(math.inf) == []


def test_stream_twin(spark):
    until = q_captions._watermark(spark, SF)
    events = q_captions.events(spark, SF)
    for stream, batch in (
        (q_captions.trigger_caption_stream, C.trigger_captions(events, until, **q_captions._SETTINGS)),
        (q_captions.count_batch_stream, C.count_batches(events, 3, 7200.0, until, 172800.0)),
    ):
        plain = q_captions._plain_times(batch, "ts")
        plain = q_captions.rounded(plain, "confidence") if "confidence" in plain.columns else plain
        want = sorted(map(tuple, plain.collect()))
        assert want and sorted(map(tuple, stream(spark, SF).collect())) == want


def test_stream_late_rows(spark, tmp_path):
    """Events that come in any order inside the watermark, over several files, are walked in order of time."""
    rng = random.Random(5)
    rows = [(f"s{k % 3}", k, 1_700_000_000 + 2 * k + (4000 if k > 150 else 0), rng.choice(["GO", "WHERE", "DONE", "EAT"]), 0.5) for k in range(300)]
    late = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 50))
    schema = "session_id string, event_id long, s long, gloss string, confidence double"
    for k in range(0, 300, 60):
        part = spark.createDataFrame(late[k : k + 60], schema).select("session_id", "event_id", F.timestamp_seconds("s").alias("ts"), "gloss", "confidence")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    every = spark.read.parquet(str(tmp_path / "in"))
    reader = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1)
    C.run_available(C.trigger_caption_stream(reader.parquet(str(tmp_path / "in")), "60 seconds"), str(tmp_path / "out"))
    got = spark.read.schema(C.CAPTION).parquet(str(tmp_path / "out"))
    until = datetime.datetime.fromtimestamp(max(r[2] for r in rows) - 60, datetime.timezone.utc)
    want = C.trigger_captions(every, until)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 50
