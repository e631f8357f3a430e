"""Scores of an answer (0 to 1): relevance, completeness, accuracy, consistency, conciseness and the whole."""

from __future__ import annotations

import difflib
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .questions import question_type
from .text import any_of, clauses, key_words, sigmoid, words

# Fixed values.
MARKERS = {
    "procedural": ((0.25, ("move", "place", "perform", "draw", "roll", "must", "should")), (0.25, ("first", "then", "after", "before", "when", "next"))),
    "definitional": ((0.3, ("is", "are", "means", "refers to", "represents")), (0.2, ("such as", "example", "including", "like", "e.g."))),
    "quantitative": ((0.3, None), (0.2, ("each", "per", "total", "maximum", "minimum"))),  # None: any digit
    "permission": ((0.3, ("can", "may", "allowed", "must", "can't", "cannot", "forbidden", "not allowed")), (0.2, ("if", "when", "unless", "except", "only"))),
}
COMMON = ("this", "that", "what", "when", "where", "which", "while", "with", "from", "have", "does", "their", "they", "your", "about")
RANGES = {"procedural": (400, 800), "definitional": (200, 500), "quantitative": (100, 300), "permission": (150, 400), "locational": (100, 300), "conditional": (200, 500), "general": (200, 600)}
WEIGHTS = {"relevance": 0.30, "completeness": 0.25, "accuracy": 0.40, "conciseness": 0.05}
BANDS = ((0.8, "Excellent - High quality answer"), (0.6, "Good - Satisfactory answer"), (0.4, "Fair - Some improvement needed"), (None, "Poor - Significant issues"))


def relevance(cross_score: Column) -> Column:
    """From a pair model's score; a half where there is none."""
    return F.coalesce(sigmoid(cross_score), F.lit(0.5))


def completeness(question: Column, answer: Column) -> Column:
    """A half, more for what answers of the question's type hold and for its key words; at most 1."""
    kind, text = question_type(question), F.lower(answer)
    found = lambda ws: F.when(any_of(text, ws) if ws else answer.rlike(r"\d"), 1.0).otherwise(0.0)
    marked = F.lit(0.0)
    for name, parts in MARKERS.items():
        marked = F.when(kind == name, sum((found(ws) * w for w, ws in parts), F.lit(0.0))).otherwise(marked)
    asked = F.array_except(key_words(question), F.array(*map(F.lit, COMMON)))
    covered = F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, key_words(answer))) / F.size(asked)).otherwise(0.0)
    return F.least(F.lit(1.0), 0.5 + marked + covered * 0.3)


def word_overlap(answer: Column, truth: Column) -> Column:
    """Share of the truth's key words in the answer; a half where it has none."""
    k = key_words(truth)
    return F.when(F.size(k) > 0, F.size(F.array_intersect(k, key_words(answer))) / F.size(k)).otherwise(0.5)


def accuracy(similarity: Column, cross: Column, overlap: Column, sequence: Column) -> Column:
    """Weighted sum of four likenesses, with floors for high similarity of the embeddings."""
    s = F.greatest(F.lit(0.0), similarity)
    mixed = lambda a, b, c, d: a * s + b * cross + c * overlap + d * sequence
    total = F.when(s > 0.7, mixed(0.60, 0.25, 0.10, 0.05)).otherwise(mixed(0.45, 0.25, 0.20, 0.10))
    return F.greatest(total, F.when(s > 0.8, 0.90).when(s > 0.7, 0.85).when(s > 0.6, 0.75).otherwise(0.0))


def consistency(answer: Column, chunks: Column) -> Column:
    """Mean over the answer's sentences of the best share of words in one of the first five chunks; a half without either."""
    own = F.filter(F.transform(clauses(F.lower(answer)), lambda s: F.trim(s)), lambda s: F.length(s) > 10)
    bags = F.transform(F.slice(chunks, 1, 5), lambda c: words(F.lower(c)))

    def best(s: Column) -> Column:
        w = F.array_distinct(words(s))
        return F.array_max(F.transform(bags, lambda b: F.size(F.array_intersect(w, b)) / F.size(w)))

    total = F.aggregate(F.transform(own, best), F.lit(0.0), lambda a, x: a + x)
    return F.when((F.size(own) > 0) & (F.size(chunks) > 0), total / F.size(own)).otherwise(0.5)


def conciseness(question: Column, answer: Column) -> Column:
    """1 where the answer's length is in its type's range, less below and above."""
    n, low, high = F.length(answer), F.lit(None).cast("int"), F.lit(None).cast("int")
    kind = question_type(question)
    for name, (a, b) in RANGES.items():
        low, high = F.when(kind == name, a).otherwise(low), F.when(kind == name, b).otherwise(high)
    return F.when(n < low, n / low).when(n > high, F.greatest(F.lit(0.0), 1 - (n - high) / (high * 2))).otherwise(1.0)


def overall(parts: Mapping[str, Column], weights: Mapping[str, float] = WEIGHTS) -> Column:
    """Weighted sum of the four dimensions. Weights must add up to 1."""
    if abs(sum(weights.values()) - 1) > 0.01:
        raise ValueError(f"weights must add up to 1, not {sum(weights.values())}")
    return sum((parts[k] * w for k, w in weights.items()), F.lit(0.0))


def interpretation(score: Column) -> Column:
    return F.coalesce(*(F.when(score >= at, said) if at is not None else F.lit(said) for at, said in BANDS))


def explained(parts: Mapping[str, Column], answer: Column, weights: Mapping[str, float] = WEIGHTS) -> Column:
    """The scores of an answer as text."""
    whole = overall(parts, weights)
    lines = [F.format_string("Overall Score: %.3f", whole), F.lit(""), F.lit("Breakdown:")]
    lines += [F.format_string(f"  {k.capitalize() + ':':<13} %.3f (weight: {round(w * 100)}%%)", parts[k]) for k, w in weights.items()]
    lines += [F.lit(""), F.format_string("Answer length: %d characters", F.length(answer)), F.lit(""), F.concat(F.lit("Interpretation: "), interpretation(whole))]
    return F.array_join(F.array(*lines), "\n")


def sequence_likeness(a: Column, b: Column) -> Column:
    """Share of matching blocks in both texts (0 to 1) by an Arrow UDF; nulls count as empty."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y, strict=True)], dtype=float)

    return F.pandas_udf(run, "double")(a, b)


def shown_quality(x: Column) -> Column:
    """A quality as a whole number of 1 to 10, halves to even."""
    return F.greatest(F.lit(1), F.least(F.lit(10), F.bround(x).cast("int")))


def band(x: Column, high: float, medium: float) -> Column:
    return F.when(x >= high, "high").when(x >= medium, "medium").otherwise("low")
