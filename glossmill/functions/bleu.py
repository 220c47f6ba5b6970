"""Sentence BLEU for batches of sentence pairs."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from glossmill.functions.text import PUNCTUATION, words


def sentence_bleu(output: list[str], reference: list[str], order: int = 4) -> float:
    """BLEU from 0 to 100 of a tokenised sentence against one reference.

    Clipped n-gram precisions up to the longest order that the output has; orders without a match get half, a quarter and
    so on of one match (exponential smoothing); brevity penalty. 0 if no word matches.
    """
    logs, smooth, any_match = [], 1.0, False
    for n in range(1, order + 1):
        total = len(output) - n + 1
        if total <= 0:
            break
        said = Counter(tuple(output[i : i + n]) for i in range(total))
        wanted = Counter(tuple(reference[i : i + n]) for i in range(len(reference) - n + 1))
        matches = sum(min(c, wanted[g]) for g, c in said.items())
        if matches:
            any_match = True
            logs.append(math.log(matches / total))
        else:
            smooth *= 2
            logs.append(math.log(1 / (smooth * total)))
    if not any_match:
        return 0.0
    penalty = math.exp(min(0.0, 1 - len(reference) / len(output)))
    return 100 * penalty * math.exp(sum(logs) / len(logs))


def bleu(output: Column, reference: Column) -> Column:
    """Sentence BLEU of two string columns, lower-cased and without punctuation; null if either is null."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hyp, ref in batches:
            yield pd.Series([sentence_bleu(list(h), list(r)) for h, r in zip(hyp, ref, strict=True)], dtype=float)

    def tokens(c: Column) -> Column:
        return words(F.lower(F.regexp_replace(c, PUNCTUATION, "")))

    return F.when(output.isNotNull() & reference.isNotNull(), run(tokens(output), tokens(reference)))
