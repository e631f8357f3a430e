"""What recurring corrections teach: characters, word starts and whole words to replace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _changed(pairs: DataFrame) -> DataFrame:
    """Trimmed pairs of original and correction that differ; nulls and empty ones are left out."""
    p = pairs.select(F.trim("original").alias("original"), F.trim("corrected").alias("corrected"))
    return p.where("original <> '' and corrected <> '' and original <> corrected")


def characters(pairs: DataFrame, least: int = 3) -> DataFrame:
    """original, corrected and n of characters replaced at least so often in words of equal length."""
    p = _changed(pairs).where(F.length("original") == F.length("corrected"))
    at = F.explode(F.arrays_zip(F.split("original", "").alias("o"), F.split("corrected", "").alias("c")))
    counts = p.select(at.alias("x")).select(F.col("x.o").alias("original"), F.col("x.c").alias("corrected")).where(r"original <> corrected and not original rlike '\\s'")
    return counts.groupBy("original", "corrected").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _long(pairs: DataFrame) -> DataFrame:
    tails = F.substring("original", 2, 2**31 - 1) == F.substring("corrected", 2, 2**31 - 1)
    return _changed(pairs).where((F.length("original") > 3) & (F.length("corrected") > 3)).withColumn("starts", tails)


def starts(pairs: DataFrame, each: int = 2, examples: int = 2) -> DataFrame:
    """First characters replaced in at least so many words, each seen so often; and the number of those words."""
    seen = _long(pairs).where("starts").groupBy("original", "corrected").agg(F.count("*").alias("k")).where(F.col("k") >= each)
    first = lambda c: F.substring(c, 1, 1)
    return seen.groupBy(first("original").alias("prefix"), first("corrected").alias("prefix_replacement")).agg(F.count("*").alias("examples")).where(F.col("examples") >= examples)


def whole_words(pairs: DataFrame, top: int = 20, least: int = 3) -> DataFrame:
    """The most frequent replacements of words (ties by word), of those the ones seen at least so often."""
    p = _long(pairs).where(~F.col("starts") & (F.lower("original") != F.lower("corrected")))
    counts = p.groupBy("original", "corrected").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "original", "corrected").limit(top).where(F.col("n") >= least)


def merged(existing: DataFrame, learned: DataFrame, key: str) -> DataFrame:
    """All existing entries and the learned ones of other keys."""
    return existing.unionByName(learned.join(existing.select(key), key, "left_anti"))


def _prefixes_replaced(t: Column, p: dict[str, str]) -> Column:
    old, new = F.lit(p["prefix"]), F.lit(p["prefix_replacement"])
    found = F.array_distinct(F.regexp_extract_all(t, F.lit(p["pattern"]), F.lit(0)))
    return F.aggregate(found, t, lambda s, w: F.replace(s, w, F.replace(w, old, new)))


def repaired(t: Column, characters: dict[str, str], patterns: list[dict[str, str]]) -> Column:
    """t with single characters, then patterns replaced (type prefix_replace, regex or simple) in their order."""
    single = {a: b for a, b in characters.items() if len(a) == 1}
    short = {a: b for a, b in single.items() if len(b) == 1}
    if short:
        t = F.translate(t, "".join(short), "".join(short.values()))
    for a, b in single.items():
        if a not in short:
            t = F.replace(t, F.lit(a), F.lit(b))
    for p in patterns:
        kind = p.get("type", "simple")
        if kind == "prefix_replace":
            t = _prefixes_replaced(t, p)
        elif kind == "regex":
            t = F.regexp_replace(t, p["pattern"], p.get("replacement", ""))
        else:
            t = F.replace(t, F.lit(p["pattern"]), F.lit(p.get("replacement", "")))
    return t
