"""Column functions over glosses, sentences and model answers. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the function words that do not count as content.
FUNCTION_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might must can of to in on "
    "at for with from by about as into through during before after above below between under over and or but if then so than "
    "that this these those i me my you your he she it we they him her its our their not no yes"
).split()
#: ASCII punctuation as a character class.
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def norm_gloss(gloss: Column) -> Column:
    """Canonical form of a gloss: upper case, trimmed."""
    return F.upper(F.trim(gloss))


def words(text: Column) -> Column:
    """Words between white space, in order; none for null."""
    return F.coalesce(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""), F.array().cast("array<string>"))


def content_words(text: Column, stop: list[str] | None = None, lexicon: Column | None = None) -> Column:
    """Lower-cased words without punctuation and function words; ``lexicon`` maps words to lemmas."""
    plain = words(F.lower(F.regexp_replace(text, PUNCTUATION, "")))
    stops = F.array(*[F.lit(w) for w in (FUNCTION_WORDS if stop is None else stop)])
    kept = F.filter(plain, lambda w: ~F.array_contains(stops, w))
    if lexicon is None:
        return kept
    return F.transform(kept, lambda w: F.coalesce(F.element_at(lexicon, w), w))


def words_match(a: Column, b: Column) -> Column:
    """Equal, one inside the other, or the first four letters of one begin the other."""
    return (
        a.contains(b)
        | b.contains(a)
        | ((F.length(a) >= 4) & b.startswith(F.substring(a, 1, 4)))
        | ((F.length(b) >= 4) & a.startswith(F.substring(b, 1, 4)))
    )


def matched(these: Column, those: Column) -> Column:
    """The words of ``these`` that match one of ``those``."""
    return F.filter(these, lambda a: F.exists(those, lambda b: words_match(a, b)))


def unmatched(these: Column, those: Column) -> Column:
    return F.filter(these, lambda a: ~F.exists(those, lambda b: words_match(a, b)))


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` in percent, 0 for an empty whole."""
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def f1(a: Column, b: Column) -> Column:
    return F.when(a + b > 0, 2 * a * b / (a + b)).otherwise(F.lit(0.0))


def coverage(reference: Column, output: Column) -> Column:
    """Struct of recall, precision, F1 (0 to 100) and the missing and hallucinated words of two content-word lists."""
    missing, extra = unmatched(reference, output), unmatched(output, reference)
    recall = share(F.size(reference) - F.size(missing), F.size(reference))
    precision = share(F.size(output) - F.size(extra), F.size(output))
    return F.struct(
        recall.alias("recall"), precision.alias("precision"), f1(recall, precision).alias("f1"),
        missing.alias("missing_words"), extra.alias("hallucinated_words"),
    )


def gloss_accuracy(predicted: Column, truth: Column) -> Column:
    """Struct of accuracy (percent of the shorter list), correct, total and the mismatches, padded with ``[NONE]``."""
    both = F.zip_with(predicted, truth, lambda p, t: F.struct(p.alias("predicted"), t.alias("original")))
    both = F.transform(
        both,
        lambda x, i: F.struct(
            i.alias("position"), F.coalesce(x["predicted"], F.lit("[NONE]")).alias("predicted"), F.coalesce(x["original"], F.lit("[NONE]")).alias("original")
        ),
    )
    wrong = F.filter(both, lambda x: norm_gloss(x["predicted"]) != norm_gloss(x["original"]))
    total = F.least(F.size(predicted), F.size(truth))
    correct = F.size(F.filter(F.zip_with(predicted, truth, lambda p, t: norm_gloss(p) == norm_gloss(t)), lambda x: x))
    return F.struct(
        share(correct, total).alias("accuracy"), correct.alias("correct"), total.alias("total"), wrong.alias("mismatches")
    )


def perfect_translation(predicted: Column, truth: Column) -> Column:
    """100 if both lists are equal gloss by gloss and not empty, else 0."""
    same = F.transform(predicted, norm_gloss) == F.transform(truth, norm_gloss)
    return F.when((F.size(predicted) > 0) & same, 100.0).otherwise(0.0)


def perplexity_to_score(perplexity: Column) -> Column:
    """Piecewise curve from perplexity (an input) to 0..100."""
    x = perplexity  # fixed values: the bounds and scores of the pieces
    return (
        F.when(x < 50, 100.0)
        .when(x < 100, 90 + (100 - x) / 50 * 10)
        .when(x < 500, 60 + (500 - x) / 400 * 30)
        .when(x < 2000, 30 + (2000 - x) / 1500 * 30)
        .when(x < 5000, 10 + (5000 - x) / 3000 * 20)
        .otherwise(F.greatest(F.lit(0.0), 10 - (x - 5000) / 1000))
    )


def ctqi_v1(accuracy: Column, quality: Column, perfect: Column, weights: tuple[float, float, float] = (0.4, 0.4, 0.2)) -> Column:
    """Weighted mean over the scores that are there."""
    scores = list(zip((accuracy, quality, perfect), weights, strict=True))
    total = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in scores), F.lit(0.0))
    weight = sum((F.when(s.isNotNull(), w).otherwise(0.0) for s, w in scores), F.lit(0.0))
    return F.when(weight > 0, total / weight)


def ctqi_geometric(accuracy: Column, quality: Column, cover: Column, floor: float = 1.0) -> Column:
    """Geometric mean over the scores that are there, each at least ``floor``."""
    scores = (accuracy, quality, cover)
    total = sum((F.coalesce(F.log(F.greatest(s, F.lit(floor)) / 100) * s.isNotNull().cast("int"), F.lit(0.0)) for s in scores), F.lit(0.0))
    count = sum((s.isNotNull().cast("int") for s in scores), F.lit(0))
    return F.when(count > 0, F.exp(total / count) * 100)


def _unit(score: Column) -> Column:
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)) / 100


def ctqi_v2(accuracy: Column, cover: Column, plausibility: Column) -> Column:
    """Prerequisite chain: accuracy and coverage gate, plausibility modifies between a half and one."""
    return _unit(accuracy) * _unit(cover) * (0.5 + 0.5 * _unit(plausibility)) * 100


def ctqi_v3(accuracy: Column, cover: Column, plausibility: Column, alpha: Column | float = 0.5) -> Column:
    """As v2, with plausibility's part scaled by accuracy; ``alpha`` is the floor of the modifier."""
    a = F.lit(alpha) if isinstance(alpha, float) else alpha
    return _unit(accuracy) * _unit(cover) * (a + (1 - a) * _unit(plausibility) * _unit(accuracy)) * 100


def baseline_sentence(glosses: Column) -> Column:
    """The top-1 glosses as a sentence."""
    return F.concat(F.array_join(glosses, " "), F.lit("."))


_ANSWER = "struct<sentence:string,selections:array<string>>"


def parse_response(answer: Column) -> Column:
    """Struct of sentence and selections from a model's answer: the JSON object in it, else the bare text."""
    plain = F.trim(F.regexp_replace(answer, r"```(?:json)?", ""))
    body = F.regexp_extract(plain, r"(?s)\{.*\}", 0)
    parsed = F.from_json(body, _ANSWER)
    return F.struct(
        F.coalesce(parsed["sentence"], plain).alias("sentence"),
        F.coalesce(parsed["selections"], F.array().cast("array<string>")).alias("selections"),
    )


def parse_score(answer: Column) -> Column:
    """Score between 0 and 100 from a JSON answer's ``overall``, else from the first number in the text."""
    body = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    number = F.coalesce(
        F.get_json_object(body, "$.overall").try_cast("double"),
        F.regexp_extract(answer, r"(\d+(?:\.\d+)?)", 1).try_cast("double"),
    )
    return F.least(F.greatest(number, F.lit(0.0)), F.lit(100.0))


def effective_glosses(top_k: Column, selections: Column, sentence: Column) -> Column:
    """The gloss that the sentence used at each position.

    ``top_k`` is a list over positions of candidate lists, best first. Selections count if there is one for each
    position and all are in the sentence; else the first candidate that matches a word of the sentence, else the first.
    """
    low = F.lower(sentence)
    said = words(F.regexp_replace(low, PUNCTUATION, ""))
    usable = (F.size(selections) == F.size(top_k)) & F.forall(selections, lambda s: low.contains(F.lower(s)))

    def fits(candidate: Column) -> Column:
        c = F.lower(candidate)
        near = lambda w: w.contains(c) | c.contains(w) | ((F.length(c) >= 4) & w.startswith(F.substring(c, 1, 4)))
        return F.exists(said, near)

    picked = F.transform(top_k, lambda cs: F.coalesce(F.get(F.filter(cs, fits), F.lit(0)), F.get(cs, F.lit(0))))
    return F.when(usable, F.transform(selections, norm_gloss)).otherwise(F.transform(picked, norm_gloss))


def format_prompt(top_k: Column) -> Column:
    """One line for each position with its candidates ``(gloss, confidence)`` and their confidence in percent."""

    def candidate(c: Column) -> Column:
        return F.concat(F.lit("'"), c["gloss"], F.lit("' ("), F.format_number(c["confidence"] * 100, 1), F.lit("%)"))

    lines = F.transform(
        top_k, lambda cs, i: F.concat(F.lit("Position "), (i + 1).cast("string"), F.lit(": "), F.array_join(F.transform(cs, candidate), ", "))
    )
    return F.array_join(lines, "\n")


def wrap_text(text: Column, width: int = 50) -> Column:
    """Greedy line wrapping at spaces."""
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("line"))

    def step(acc: Column, word: Column) -> Column:
        grown = F.when(acc["line"] == "", word).otherwise(F.concat(acc["line"], F.lit(" "), word))
        fits = F.length(grown) <= width
        closed = F.when(acc["done"] == "", acc["line"]).otherwise(F.concat(acc["done"], F.lit("\n"), acc["line"]))
        return F.struct(
            F.when(fits | (acc["line"] == ""), acc["done"]).otherwise(closed).alias("done"),
            F.when(fits | (acc["line"] == ""), grown).otherwise(word).alias("line"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["done"] == "", acc["line"]).otherwise(F.concat(acc["done"], F.lit("\n"), acc["line"]))

    return F.aggregate(words(text), start, step, finish)


def ms_to_frame(ms: Column, fps: float) -> Column:
    """Frame of a time in milliseconds, halves to even."""
    return F.bround(ms / 1000 * fps).cast("int")
