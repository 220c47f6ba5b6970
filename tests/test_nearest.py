"""Nearest classes by cells against all pairs."""

import numpy as np
import pytest

from glossmill.operators import vocab


def plain(x, k):
    d = np.linalg.norm(x[:, None] - x[None], axis=2).round(9)
    return {(f"g{i:04}", r + 1, f"g{j:04}") for i in range(len(x)) for r, j in enumerate([j for j in np.argsort(d[i], kind="stable") if j != i][:k])}


@pytest.mark.parametrize("kind", ["random", "clustered", "equal"])
def test_nearest_classes(spark, monkeypatch, kind):
    """Ties, equal vectors and crowded cells; of far clusters most pairs of cells are never compared."""
    monkeypatch.setattr(vocab, "ONE_BLOCK", 40)
    draw = np.random.default_rng(5)
    x = draw.normal(size=(300, 6))
    if kind == "clustered":
        x = x * 0.1 + draw.normal(size=(12, 6))[draw.integers(0, 12, 300)] * 100
    if kind == "equal":
        x[:150] = x[0]
    shares, was = [], vocab.needed_cells

    def counted(centers, radius, bound):
        need = was(centers, radius, bound)
        shares.append(sum(map(len, need)) / len(need) ** 2)
        return need

    monkeypatch.setattr(vocab, "needed_cells", counted)
    table = spark.createDataFrame([(f"g{i:04}", v.tolist()) for i, v in enumerate(x)], "gloss string, vec array<double>")
    got = vocab.nearest_classes(table, 4, cells=16).collect()
    assert {(r.gloss, r.rank, r.other) for r in got} == plain(x, 4) and len(got) == 1200
    print(kind, shares)
    assert kind != "clustered" or shares[0] < 0.5


def test_few_classes(spark):
    rows = [("a", [0.0]), ("b", [1.0]), ("c", [5.0])]
    table = spark.createDataFrame(rows, "gloss string, vec array<double>")
    got = sorted((r.gloss, r.rank, r.other) for r in vocab.nearest_classes(table, 5, cells=2).collect())
    assert got == [("a", 1, "b"), ("a", 2, "c"), ("b", 1, "a"), ("b", 2, "c"), ("c", 1, "b"), ("c", 2, "a")]
    assert vocab.nearest_classes(table.limit(0)).count() == 0
