"""Column functions on text. Nulls stay null unless a function says otherwise."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(t: Column) -> Column:
    """Lower case, trimmed, white space collapsed."""
    return F.regexp_replace(F.trim(F.lower(t)), r"\s+", " ")


def for_matching(t: Column) -> Column:
    """Lower case without punctuation, then white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def for_duplicates(t: Column) -> Column:
    """White space collapsed, then punctuation removed, so that a lone mark leaves two spaces."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(t), r"\s+", " ")), r"[^\p{L}\p{N}_\s]", "")


def sentences(t: Column) -> Column:
    """Split after . ! ? and white space, terminators kept."""
    return F.split(t, r"(?<=[.!?])\s+")


def clauses(t: Column) -> Column:
    """Split at runs of . ! ?, terminators dropped."""
    return F.split(t, r"[.!?]+")


def words(t: Column) -> Column:
    return F.filter(F.split(F.trim(t), r"\s+"), lambda w: w != "")


def ascii_only(t: Column) -> Column:
    return F.regexp_replace(t, r"[^\x00-\x7F]", " ")


def key_words(t: Column) -> Column:
    """Distinct lower-case words of four letters and more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"\b[a-z]{4,}\b"), F.lit(0)))


def tokens(t: Column) -> Column:
    """Search tokens: lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def without_mentions(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"@\w+[,:]?", ""), r"\s+", " "))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def sigmoid(x: Column, scale: float = 3.0) -> Column:
    return 1 / (1 + F.exp(-x / scale))


def squeezed(t: Column) -> Column:
    """Runs of white space as one blank, none at the ends; case is kept."""
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def capitalised(t: Column) -> Column:
    """First letter in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 2**31 - 1))


def first_word(t: Column) -> Column:
    return F.lower(F.regexp_extract(t, r"^\s*(\S+)", 1))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def any_of(t: Column, parts: Sequence[str]) -> Column:
    """Whether any part occurs in t, inside words as well."""
    return t.rlike("|".join(re.escape(p) for p in parts))


def whole_words_replaced(t: Column, pairs: Column) -> Column:
    """t with each pair's original (an array of structs original, correction) replaced where it is a whole word, in any case."""
    quoted = lambda w: F.concat(F.lit(r"(?i)\b\Q"), w, F.lit(r"\E\b"))
    plain = lambda w: F.regexp_replace(w, r"([\\$])", r"\\$1")
    return F.aggregate(pairs, t, lambda s, p: F.regexp_replace(s, quoted(p["original"]), plain(p["correction"])))


# Fixed values.
ENGLISH = ("yes", "no", "the", "is", "are", "this", "that", "what", "where", "when", "how")


def language(t: Column, detected: Column) -> Column:
    """A detector's language, but en for texts under 20 characters, for those under 50 with a common English word, and where it found none; unknown without text."""
    short = (F.length(t) < 50) & any_of(F.lower(t), ENGLISH)
    return F.when(F.coalesce(t, F.lit("")) == "", "unknown").when((F.length(t) < 20) | short, "en").otherwise(F.coalesce(detected, F.lit("en")))
