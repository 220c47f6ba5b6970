"""Column functions over score and feature vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where a vector is all zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double"))))


def softmax(scores: Column) -> Column:
    """Softmax, with the maximum taken off first."""
    once = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731 - names a value, else each entry computes it anew
    shifted = once(F.array_max(scores).cast("double"), lambda top: F.transform(scores, lambda x: F.exp(x.cast("double") - top)))
    return once(shifted, lambda e: once(total(e), lambda s: F.transform(e, lambda x: x / s)))


def entropy(p: Column) -> Column:
    """Entropy of a distribution over the entropy of the even one."""
    return -total(F.transform(p, lambda x: x * F.log(x + 1e-10))) / F.log(F.size(p).cast("double"))


def top_k(scores: Column, names: Column, k: int) -> Column:
    """The ``k`` likeliest names with their softmax confidence; ``UNKNOWN`` where there is no name; ties by index."""
    ranked = F.transform(softmax(scores), lambda p, i: F.struct((-p).alias("minus"), i.alias("i")))
    best = F.slice(F.array_sort(ranked), 1, k)
    return F.transform(best, lambda x: F.struct(F.coalesce(F.get(names, x["i"]), F.lit("UNKNOWN")).alias("gloss"), (-x["minus"]).alias("confidence")))


def mask_classes(p: Column, masked: list[int]) -> Column:
    """A distribution without some classes, normalised again; their places are 0."""
    kept = F.transform(p, lambda x, i: F.when(i.isin(masked), 0.0).otherwise(x.cast("double")))
    return F.transform(kept, lambda x: F.when(total(kept) > 0, x / total(kept)).otherwise(0.0))
