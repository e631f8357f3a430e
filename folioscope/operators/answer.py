"""Answers put together from ranked chunks, and the choice between two sources."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.questions import intent, need
from ..functions.text import let, sentences, squeezed, words

NOTHING = "No relevant information found."


class Style(NamedTuple):
    """How answers to one kind of question are put together."""

    chunks: int  # so many of the best are read
    words: int  # a sentence has at least
    budget: int  # characters
    most: int  # sentences
    top: int | None  # so many of the best sentences are tried
    position: float  # share of the boost for early chunks
    enough: int | None = None  # three sentences over so many characters are enough
    markers: tuple[float, tuple[str, ...]] = (0.0, ())
    terms: float = 0.0  # boost for each of the question's verbs, concepts or key words in a sentence
    digits: float = 0.0


# Fixed values.
STYLES = {
    "procedural": Style(8, 4, 700, 5, 10, 0.2, markers=(0.05, ("first", "then", "next", "after", "must", "should", "to", "step")), terms=0.08),
    "definitional": Style(8, 4, 600, 4, 8, 0.2, markers=(0.06, ("is", "are", "means", "refers to", "represents", "called", "known as")), terms=0.07),
    "quantitative": Style(8, 3, 500, 3, 6, 0.2, digits=0.15),
    "sentence": Style(10, 4, 600, 5, None, 0.3, enough=300, terms=0.15),
}
STYLE_OF = {"procedural": "procedural", "definition": "definitional", "quantitative": "quantitative"}


def extractive(chunks: Column, budget: int = 800, most: int = 15, least: int = 50) -> Column:
    """Whole chunks up to budget characters; of the first that doesn't fit its sentences that do, if over 50 characters are left."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("used"), F.lit(False).alias("done"))

    def put(s: Column, x: Column) -> Column:
        return F.struct(F.concat(s["parts"], F.array(x)).alias("parts"), (s["used"] + F.length(x) + 1).cast("int").alias("used"), s["done"].alias("done"))

    def stopped(s: Column) -> Column:
        return F.struct(s["parts"].alias("parts"), s["used"].alias("used"), F.lit(True).alias("done"))

    def sentence(s: Column, x: Column) -> Column:
        return F.when(s["done"], s).when(s["used"] + F.length(x) <= budget, put(s, x)).otherwise(stopped(s))

    def chunk(s: Column, x: Column) -> Column:
        part = F.when(budget - s["used"] > least, stopped(F.aggregate(sentences(x), s, sentence))).otherwise(stopped(s))
        return F.when(s["done"] | (F.coalesce(x, F.lit("")) == ""), s).when(s["used"] + F.length(x) > budget, part).otherwise(put(s, x))

    parts = F.aggregate(F.slice(chunks, 1, most), start, chunk, lambda s: s["parts"])
    return let(parts, lambda p: F.when(F.size(p) > 0, squeezed(F.array_join(p, " "))).otherwise(F.lit(NOTHING)))


def chosen(listed: Column, budget: Column, most: Column, enough: Column) -> Column:
    """Of sentences (structs with sentence and chunk_idx, best first) those that fit, each wording once.

    Sentences that don't fit are passed over; it stops at most sentences, or at three over enough characters (null: never).
    """
    pick = F.struct(F.lit("").alias("sentence"), F.lit(0).alias("chunk_idx"))
    start = F.struct(F.slice(F.array(pick), 2, 0).alias("parts"), F.array().cast("array<string>").alias("seen"), F.lit(0).alias("used"), F.lit(False).alias("done"))

    def add(s: Column, x: Column) -> Column:
        plain = squeezed(F.lower(x["sentence"]))
        skip = s["done"] | F.array_contains(s["seen"], plain) | (s["used"] + F.length(x["sentence"]) > budget)
        n, used = F.size(s["parts"]) + 1, s["used"] + F.length(x["sentence"]) + 1
        done = (n >= most) | F.coalesce((n >= 3) & (used > enough), F.lit(False))
        part = F.struct(x["sentence"].alias("sentence"), x["chunk_idx"].cast("int").alias("chunk_idx"))
        more = F.struct(F.concat(s["parts"], F.array(part)).alias("parts"), F.concat(s["seen"], F.array(plain)).alias("seen"), used.cast("int").alias("used"), done.alias("done"))
        return F.when(skip, s).otherwise(more)

    return F.aggregate(listed, start, add, lambda s: s["parts"])


def answered(
    questions: DataFrame, chunks: DataFrame, question: str, similarity: Callable[[Column, Column], Column], *, verbs: Column, concepts: Column, keywords: Column, style: str | None = None
) -> DataFrame:
    """question, style, answer, n_sentences and used (chunks, in the answer's order) for each question.

    questions holds question (an id) and the columns question (the text), verbs, concepts and keywords are made of;
    chunks holds question (the id), chunk_idx (from 0) and text. similarity is of a sentence and the
    question's text, by built-in functions or an Arrow UDF. The style follows the question's intent
    unless one is given. Where no sentence fits, the answer is the start of the first chunk; where
    there are no chunks, or no candidates for the sentence style, that nothing was found.
    """
    kind = need(intent(F.col("question")))
    named = F.lit(style) if style else F.coalesce(*(F.when(kind == k, v) for k, v in STYLE_OF.items()), F.lit("sentence"))
    of = lambda field: F.coalesce(*(F.when(F.col("style") == k, getattr(v, field)) for k, v in STYLES.items() if getattr(v, field) is not None), F.lit(None).cast("int"))
    terms = F.when(named == "procedural", verbs).when(named == "definitional", concepts).when(named == "sentence", keywords)
    q = questions.select(F.col(question), F.col("question").alias("asked"), named.alias("style"), terms.alias("terms"))
    s = chunks.select(question, "chunk_idx", "text").join(q, question).where(F.col("chunk_idx") < of("chunks"))
    s = s.select(question, "asked", "style", "terms", "chunk_idx", F.posexplode(sentences(F.col("text"))).alias("sent_idx", "s")).withColumn("sentence", F.trim("s"))
    shouted = (F.col("style") == "sentence") & (F.col("sentence") == F.upper("sentence")) & F.col("sentence").rlike(r"\p{L}") & (F.length("sentence") < 50)
    s = s.where((F.size(words(F.col("sentence"))) >= of("words")) & ~shouted)
    low = F.lower("sentence")
    held = lambda parts: F.coalesce(F.size(F.filter(parts, lambda x: F.contains(low, x))), F.lit(0))
    score = similarity(F.col("sentence"), F.col("asked")) + 1.0 / (F.col("chunk_idx") + 1) * of("position") + F.greatest(held(F.col("terms")), F.lit(0)) * of("terms")
    score += F.when(F.col("sentence").rlike(r"\d"), of("digits")).otherwise(0.0)
    for k, v in STYLES.items():
        if v.markers[1]:
            score += F.when(F.col("style") == k, held(F.array(*map(F.lit, v.markers[1]))) * v.markers[0]).otherwise(0.0)
    s = s.withColumn("score", score)
    best = Window.partitionBy(question).orderBy(F.desc("score"), "chunk_idx", "sent_idx")
    s = s.withColumn("r", F.row_number().over(best)).where(F.coalesce(F.col("r") <= of("top"), F.lit(True)))
    listed = s.groupBy(question).agg(F.array_sort(F.collect_list(F.struct("r", "sentence", "chunk_idx"))).alias("xs"))
    first = chunks.groupBy(question).agg(F.min_by("text", "chunk_idx").alias("first"))
    out = q.join(listed, question, "left").join(first, question, "left")
    parts = chosen(F.coalesce("xs", F.array().cast(listed.schema["xs"].dataType)), of("budget"), of("most"), of("enough"))
    out = out.withColumn("parts", parts)
    joined = F.array_join(F.transform("parts", lambda x: x["sentence"]), " ")
    text = (
        F.when(F.size("parts") > 0, F.when(F.col("style") == "sentence", squeezed(joined)).otherwise(joined))
        .when(F.col("first").isNull() | ((F.col("style") == "sentence") & F.col("xs").isNull()), NOTHING).otherwise(F.left("first", of("budget")))
    )
    return out.select(question, "style", text.alias("answer"), F.size("parts").cast("long").alias("n_sentences"), F.transform("parts", lambda x: x["chunk_idx"]).alias("used"))


def arbitrated(questions: DataFrame, forum: DataFrame, rulebook: DataFrame, question: str, weight: float = 0.45) -> DataFrame:
    """question, source, forum_confidence and rulebook_confidence: the source whose best score, weighted, is higher.

    Both hold question, rank (from 1) and score; scores over 1 are moved down by 1.
    Ties go to the rulebook; where it has no hits, to the forum; where neither has, to none.
    """
    best = lambda df, c: df.where("rank = 1").select(question, F.when(F.col("score") > 1, F.least(F.lit(1.0), F.col("score") - 1)).otherwise(F.col("score")).alias(c))
    both = questions.select(question).join(best(forum, "f"), question, "left").join(best(rulebook, "r"), question, "left")
    f, r = F.coalesce("f", F.lit(0.0)), F.coalesce("r", F.lit(0.0))
    source = F.when(F.col("f").isNull() & F.col("r").isNull(), "none").when(f * weight > r * (1 - weight), "forum").when(F.col("r").isNotNull(), "rulebook").otherwise("forum")
    return both.select(question, source.alias("source"), f.alias("forum_confidence"), r.alias("rulebook_confidence"))
