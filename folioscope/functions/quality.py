"""Text quality, extraction confidence and paragraph filters."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clauses, let


def _count(t: Column, pattern: str) -> Column:
    return F.regexp_count(t, F.lit(pattern))


def _held(t: Column, characters: str) -> Column:
    """How many of t's characters are among these."""
    return F.length(t) - F.length(F.translate(t, characters, ""))


def vowel_share(t: Column) -> Column:
    """struct(n, share): ASCII letters and blanks, and the share of vowels and blanks among them."""
    n = _held(t, string.ascii_letters + " ")
    return F.struct(n.alias("n"), (_held(t, "aeiouAEIOU ") / F.greatest(n, F.lit(1))).alias("share"))


#: A word of over 3 characters with a capital after its first and a small letter anywhere.
MIXED_CASE = r"(?<!\S)(?=\S{4})(?=\S*\p{IsLowercase})\S+?\p{IsUppercase}\S*"


def text_quality(t: Column) -> Column:
    """0 to 100: penalties for repeated letters, odd vowel shares, dot leaders and mixed case, a bonus for sentences.

    Texts under 20 characters score 0, null as well.
    """
    runs, dots = _count(F.lower(t), r"([a-z])\1{4,}") * 5, _count(t, r"\.{6,}") * 5
    odd = let(vowel_share(t), lambda v: F.when(v["n"] <= 20, 0).when(v["share"] < 0.25, 20).when(v["share"] < 0.30, 10).when(v["share"] > 0.55, 15).otherwise(0))
    fit = F.size(F.filter(clauses(t), lambda s: _count(s, r"\S+").between(3, 50)))
    mixed = F.when(_count(t, r"\S+") >= 5, _count(t, MIXED_CASE) * 3).otherwise(0)
    score = 100 - runs - odd - dots + F.least(F.lit(20), fit * 2) - mixed - F.when(F.length(t) < 100, 10).otherwise(0)
    return F.when(F.length(t) >= 20, F.greatest(F.lit(0), F.least(F.lit(100), score))).otherwise(0).cast("double")


def confidence(quality: Column, method: Column, section: Column, variant: Column) -> Column:
    """Share of quality, raised for direct extraction and a named section, lowered for variants; at most 1."""
    x = quality / 100 * F.when(method == "pdf", 1.1).otherwise(1.0) * F.when(F.length(section) > 3, 1.05).otherwise(1.0)
    return F.least(F.lit(1.0), x * F.when(variant, 0.9).otherwise(1.0))


def is_corrupt(t: Column) -> Column:
    """Runs of a letter or of dots, or hardly a vowel or blank; never texts under 20 characters."""
    low = F.lower(t)
    few = let(vowel_share(t), lambda v: (v["n"] > 20) & (v["share"] < 0.15))
    broken = low.rlike(r"([a-z])\1{7,}") | t.rlike(r"\.{8,}") | (_count(low, r"([a-z])\1{4,}") >= 3) | few
    return (F.length(t) >= 20) & broken


def skip_reason(t: Column) -> Column:
    """Why a paragraph is left out: too short, a page number, dot leaders or corruption; else null."""
    return F.when(F.trim(t).rlike(r"^[0-9]{1,3}$"), "page number").when(F.length(F.trim(t)) < 20, "short").when(is_corrupt(t), "corrupt")
