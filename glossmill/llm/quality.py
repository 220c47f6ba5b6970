"""Quality rules by weak supervision: rules vote or abstain, EM learns how far to trust each, posteriors decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import bounded_batches, cut

_COUNTS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, "
    "n_ended_lines long, n_distinct long, n_upper long, n_latin long, n_letters long, n_punctuation long, n_bangs long"
)
_FIELDS = [x.split()[0] for x in _COUNTS.split(", ")]
_UPPER = bytes(range(65, 91))
_LATIN = _UPPER + bytes(range(97, 123))
_LETTERS = _LATIN + bytes(range(0x80, 0x100))
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_FOLLOW_ON = bytes(range(0x80, 0xC0))  # every code point has one other byte
_SYMBOLS = b"#*$%&|<>"


def counts_of(text: bytes | None) -> tuple[int, ...]:
    """The counts of ``_FIELDS`` over a whole UTF-8 text; a null text has none of anything.

    Words are ``[^\\x20\\x09-\\x0D]+``. ``n_repeat_words`` are the words inside three-word windows that occur twice or
    more in the text, first ones included; ``n_dup_lines`` the lines with a word that equal an earlier line.
    """
    text = text or b""
    words = text.split()
    n = len(words)
    size = sum(map(len, words))
    points = len(text.translate(None, _FOLLOW_ON))
    lines = [x for x in text.split(b"\n") if x.strip()]
    ids: dict[bytes, int] = {}
    number = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    repeated = 0
    if n > 3:
        pair = number[:-1] * len(ids) + number[1:]
        if len(ids) > 2_000_000:  # three numbers would not fit in 64 bits
            pair = np.unique(pair, return_inverse=True)[1]
        window = pair[:-1] * len(ids) + number[2:]
        order = np.argsort(window, kind="stable")
        same = window[order[1:]] == window[order[:-1]]
        twice = np.zeros(n - 2, bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        covered[:-2] |= twice
        covered[1:-1] |= twice
        covered[2:] |= twice
        repeated = int(covered.sum())

    def many(kind: bytes) -> int:
        return len(text) - len(text.translate(None, kind))

    return (
        n,
        points - (len(text) - size),
        many(_SYMBOLS),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        sum(x.rstrip()[-1:] in b".!?" for x in lines),
        len(ids),
        many(_UPPER),
        many(_LATIN),
        many(_LETTERS),
        many(_PUNCTUATION),
        text.count(b"!!"),
    )


def text_counts(text: Column) -> Column:
    """Struct of the counts of :func:`counts_of`."""

    @F.pandas_udf(_COUNTS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame.from_records([counts_of(x) for x in texts], columns=_FIELDS).astype("int64")

    return run(text.cast("binary"))


def _rule(value: str, good: str, bad: str) -> str:
    return f"CASE WHEN {value} {bad} THEN -1 WHEN {value} {good} THEN 1 ELSE 0 END"


#: The rules, each a vote: 1 good, -1 bad, 0 abstains. Counts are those of :func:`counts_of`; w is n_words, at least 1.
RULES: dict[str, str] = {
    "symbols": _rule("n_symbols / w", "<= 0.02", "> 0.1"),
    "punctuation": _rule("n_punctuation / w", "<= 0.3", "> 0.45"),
    "letters": _rule("n_letters / greatest(n_letters + n_punctuation, 1)", ">= 0.93", "< 0.9"),
    "shouting": _rule("n_upper / greatest(n_latin, 1)", "<= 0.15", "> 0.5"),
    "bangs": _rule("n_bangs / w", "<= 0.01", "> 0.1"),
    "repeats": _rule("n_repeat_words / w", "<= 0.1", "> 0.3"),
    "variety": _rule("n_distinct / w", ">= 0.35", "< 0.12"),
    "word_length": "CASE WHEN word_chars / w BETWEEN 3 AND 8 THEN 1 WHEN word_chars / w BETWEEN 2 AND 14 THEN 0 ELSE -1 END",
    "dup_lines": f"CASE WHEN n_lines < 3 THEN 0 ELSE {_rule('n_dup_lines / n_lines', '<= 0.1', '> 0.3')} END",
    "line_ends": f"CASE WHEN n_lines < 3 THEN 0 ELSE {_rule('n_ended_lines / n_lines', '>= 0.7', '< 0.3')} END",
    "length": "CASE WHEN n_words < 50 THEN -1 WHEN n_words >= 100 THEN 1 ELSE 0 END",
}


class LabelModel:
    """Dawid-Skene model of the rules: P(vote | class) for each rule, and the share of good documents."""

    def __init__(self, share: float, tables: np.ndarray):
        self.share, self.tables = share, tables  # tables[rule, class, vote + 1]

    @classmethod
    def fit(cls, patterns: np.ndarray, weight: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> LabelModel:
        """EM over distinct vote patterns and how many documents have each.

        It starts from the all-must-pass verdict, softened: no bad vote is good nine times in ten, one bad vote three
        times, more only once in twenty. With nothing to learn from, a rule is right eight times in ten.
        """
        rules = patterns.shape[1]
        onehot = np.stack([patterns == v for v in (-1, 0, 1)], -1).astype(float)
        good = np.array([0.9, 0.3, 0.05])[np.minimum((patterns < 0).sum(1), 2)]
        share, tables = 0.5, np.tile([[[0.8, 0.1, 0.1], [0.1, 0.1, 0.8]]], (rules, 1, 1))
        for _ in range(rounds if weight.sum() else 0):
            both = np.stack([1 - good, good]) * weight
            tables = np.einsum("cp,prv->rcv", both, onehot) + 0.5
            tables /= tables.sum(-1, keepdims=True)
            share = (both[1].sum() + 1) / (weight.sum() + 2)
            new = cls(share, tables).posterior(patterns)
            moved = np.abs(new - good).max()
            good = new
            if moved < tolerance:
                break
        return cls(share, tables)

    def log_odds(self) -> tuple[float, np.ndarray]:
        return float(np.log(self.share / (1 - self.share))), np.log(self.tables[:, 1] / self.tables[:, 0])

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        base, steps = self.log_odds()
        total = base + sum(steps[r, patterns[:, r] + 1] for r in range(patterns.shape[1]))
        return 1 / (1 + np.exp(-np.clip(total, -700, 700)))

    def column(self, votes: list[str]) -> Column:
        """Posterior probability that a document is good, from its vote columns."""
        base, steps = self.log_odds()
        total = F.lit(base)
        for r, name in enumerate(votes):
            total = total + F.element_at(F.array(*[F.lit(float(x)) for x in steps[r]]), F.col(name) + 2)
        return 1 / (1 + F.exp(-total))


def judge(docs: DataFrame, threshold: float = 0.5, rules: dict[str, str] = RULES) -> tuple[DataFrame, LabelModel]:
    """Counts, votes and posterior of every row of ``docs(doc_id, text)``, and the fitted model.

    The model learns from the vote patterns of all documents; there are at most ``3 ** len(rules)`` of them, which is
    all that reaches the driver. Returns ``doc_id``, the counts, a column ``vote_<rule>`` for each rule, ``posterior``
    and ``good`` (posterior at or above ``threshold``). Null, empty and repeated texts are rows like any other.
    """
    bounded_batches(docs.sparkSession)
    votes = [f"vote_{name}" for name in rules]
    counted = docs.select("doc_id", text_counts(F.col("text")).alias("c")).select("doc_id", "c.*")
    counted = counted.withColumn("w", F.greatest("n_words", F.lit(1)))
    counted = cut(counted.select("*", *[F.expr(x).alias(v) for v, x in zip(votes, rules.values(), strict=True)]).drop("w"), "votes")
    seen = counted.groupBy(*votes).agg(F.count("*").alias("n")).orderBy(*votes).collect()
    patterns = np.array([[r[v] for v in votes] for r in seen], int).reshape(len(seen), len(votes))
    model = LabelModel.fit(patterns, np.array([r["n"] for r in seen], float))
    scored = counted.withColumn("posterior", model.column(votes))
    return scored.withColumn("good", F.col("posterior") >= threshold), model
