"""Spelling of words: protected terms, typing errors, fragments and the nearest known words.

Every distinct word is corrected once and joined back, so costs follow the
vocabulary. Word lists are parameters of the driver's size, shipped with the task;
known words can also be a table of any size (corrections_from), which is joined.
"""

from __future__ import annotations

import difflib
import functools
import string
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import entities
from ..functions.text import whole_words_replaced
from .common import tasks


@dataclass(frozen=True)
class Lexicon:
    """known: words with their counts; terms: words never changed; typos and fragments: fixed replacements."""

    known: Mapping[str, int]
    terms: Sequence[str] = ()
    typos: Mapping[str, str] = field(default_factory=dict)
    fragments: Mapping[str, str] = field(default_factory=dict)


def _edits(w: str) -> set[str]:
    cuts = [(w[:k], w[k:]) for k in range(len(w) + 1)]
    letters = string.ascii_lowercase
    gone = {a + b[1:] for a, b in cuts if b}
    moved = {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1}
    other = {a + c + b[1:] for a, b in cuts if b for c in letters}
    more = {a + c + b for a, b in cuts for c in letters}
    return gone | moved | other | more


def cased_like(word: str, new: str) -> str:
    return new.upper() if word.isupper() else new[:1].upper() + new[1:].lower() if word[:1].isupper() else new


def _shorter(w: str) -> set[str]:
    """w and what is left of it without one or two characters."""
    one = {w[:k] + w[k + 1 :] for k in range(len(w))}
    return {w} | one | {x[:k] + x[k + 1 :] for x in one for k in range(len(x))}


def _likeness(low: str, c: str) -> float:
    return difflib.SequenceMatcher(None, low, c).ratio()


class Corrector:
    """A lexicon with an index of what is left of its words, by which words two edits away are found."""

    def __init__(self, lex: Lexicon) -> None:
        self.lex, self.terms = lex, {t.lower(): t for t in lex.terms}
        self.edits = functools.lru_cache(maxsize=2000)(_edits)
        self.index: dict[str, list[str]] = {}
        for w in lex.known:
            for x in _shorter(w):
                self.index.setdefault(x, []).append(w)

    def candidates(self, word: str) -> set[str]:
        """Known words one edit away, else two; none: empty. Words two edits apart share a word one edit from both."""
        near = _edits(word)
        found = near & self.lex.known.keys()
        maybe = {w for x in _shorter(word) for w in self.index.get(x, ())} if not found else set()
        return found or {w for w in maybe if not near.isdisjoint(self.edits(w))}

    def best(self, low: str, maybe: Iterable[str]) -> str | None:
        """The likest of maybe one edit away, else of those two away."""
        near = _edits(low)
        rank = lambda c: (-(_likeness(low, c) - 0.1 * abs(len(c) - len(low))), c)
        one = near.intersection(maybe)
        if one:
            return min(one, key=rank)
        return next((c for c in sorted(maybe, key=rank) if not near.isdisjoint(self.edits(c))), None)

    def correct(self, word: str) -> str:
        """The word as it should be: unchanged where nothing near enough is known."""
        low = word.lower()
        return self.settled(word, low in self.lex.known, lambda: {w for x in _shorter(low) for w in self.index.get(x, ())})

    def settled(self, word: str, valid: bool, maybe: Callable[[], Iterable[str]]) -> str:
        """word as correct() has it, valid where it is known; maybe gives all known words that share a _shorter word."""
        low, lex = word.lower(), self.lex
        if not word.isalpha() or low in self.terms:
            return word
        if low in lex.typos:
            return cased_like(word, lex.typos[low])
        near = difflib.get_close_matches(low, self.terms, n=1, cutoff=0.90 if valid else 0.85)
        if near and (not valid or word not in lex.fragments):
            term = self.terms[near[0]]
            return term.upper() if word.isupper() else term[:1].upper() + term[1:] if word[0].isupper() else term.lower()
        if word in lex.fragments or valid:
            return lex.fragments.get(word, word)
        best = self.best(low, maybe())
        good = best is not None and _likeness(low, best) >= (0.5 if len(word) <= 3 else 0.65)
        return cased_like(word, best) if good else word


def corrections(words: DataFrame, lex: Lexicon, column: str = "word") -> DataFrame:
    """word and correction of each distinct word that changes."""

    @F.pandas_udf("string")
    def fix(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        corrector = Corrector(lex)
        for b in batches:
            yield b.map(corrector.correct)

    distinct = words.select(F.col(column).alias("word")).where("word is not null").distinct()
    distinct = distinct.repartition(tasks(words), "word")  # few bytes but much work: don't let it run as one task
    return distinct.withColumn("correction", fix("word")).where("word <> correction")


LETTERS = r"^\p{L}+$"


def known_words(words: DataFrame, column: str = "word", least: int = 2) -> DataFrame:
    """low and n of every word of letters, in lower case, that stands least times and more: one that stands once has no other to bear it out."""
    w = words.where(F.col(column).rlike(LETTERS)).groupBy(F.col(column).alias("word")).agg(F.count("*").alias("n"))
    return w.select(_lower(F.col("word")).alias("low"), "n").groupBy("low").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _lower(word: Column) -> Column:
    def lowered(words: pd.Series) -> pd.Series:
        return words.str.lower()  # as Corrector does it

    return F.pandas_udf(lowered, "string")(word)


def _keys(word: Column) -> Column:
    def shorter(words: pd.Series) -> pd.Series:
        return words.map(lambda w: sorted(_shorter(w)))

    return F.pandas_udf(shorter, "array<string>")(word)


def corrections_from(words: DataFrame, known: DataFrame, lex: Lexicon | None = None, column: str = "word") -> DataFrame:
    """corrections() by a table of known words (low), of any size; lex gives the other lists.

    Unknown words meet the known ones that they share a deletion with (_shorter) in a
    join on its hash: words that only hashes bring together are no edits of each other.
    """
    lex = lex or Lexicon({})

    @F.pandas_udf("string")
    def fix(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        corrector = Corrector(lex)
        for b in batches:
            yield pd.Series([corrector.settled(w, v, lambda m=m: () if m is None else list(m)) for w, v, m in zip(*b, strict=True)], dtype=object)

    distinct = words.select(F.col(column).alias("word")).where(F.col("word").rlike(LETTERS)).distinct()
    distinct = distinct.withColumn("low", _lower(F.col("word"))).join(known.select("low", F.lit(True).alias("valid")), "low", "left")
    distinct = distinct.select("word", "low", F.coalesce("valid", F.lit(False)).alias("valid"))
    unknown = distinct.where("not valid").select("low").distinct()
    keyed = unknown.repartition(tasks(words), "low").select("low", F.explode(_keys(F.col("low"))).alias("x")).select("low", F.xxhash64("x").alias("key"))
    of_known = known.select("low").repartition(tasks(words), "low").select(F.col("low").alias("known"), F.explode(_keys(F.col("low"))).alias("x")).select("known", F.xxhash64("x").alias("key"))
    maybe = keyed.join(of_known, "key").groupBy("low").agg(F.collect_set("known").alias("maybe"))
    return distinct.join(maybe, "low", "left").withColumn("correction", fix("word", "valid", "maybe")).where("word <> correction").select("word", "correction")


def pieces(t: Column) -> Column:
    """t cut into runs of word characters and of others; joined again they are t."""
    return F.regexp_extract_all(t, F.lit(r"(?U)\w+|\W+"), F.lit(0))


def question_corrections(questions: DataFrame, lex: Lexicon) -> DataFrame:
    """questions with question corrected, and corrections (original, correction) in the order of the words.

    Terms of the lexicon and words of entities that a question names stay as they are; each other
    wrong word is replaced wherever it stands as a whole word.
    """
    parts = questions.select("qid", "question", F.posexplode(pieces(F.col("question"))).alias("pos", "word"))
    fixed = parts.join(corrections(parts, lex), "word")
    named = F.transform(entities(F.col("question")), lambda x: F.lower(F.substring_index(x, ":", -1)))
    barred = F.concat(named, F.flatten(F.transform(named, lambda x: F.split(x, " "))))
    fixed = fixed.where(~F.array_contains(barred, F.lower("word")))
    each = fixed.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word", "correction"))), lambda x: F.struct(x["word"].alias("original"), x["correction"].alias("correction"))).alias("corrections"))
    out = questions.join(each, "qid", "left").withColumn("corrections", F.coalesce("corrections", F.array().cast(each.schema["corrections"].dataType)))
    return out.withColumn("question", whole_words_replaced(F.col("question"), F.col("corrections")))


def corrected(docs: DataFrame, lex: Lexicon, id_col: str, text_col: str = "text") -> DataFrame:
    """id, text and corrections of each document (ids are unique); a null text stays null.

    Words are shuffled once with their places; texts are put together again by id.
    """
    parts = docs.select(id_col, F.posexplode(pieces(F.col(text_col))).alias("pos", "word"))
    fixed = parts.join(corrections(parts, lex), "word", "left")
    again = fixed.groupBy(id_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("correction", "word").alias("w")))), lambda x: x["w"]), "").alias("fixed"),
        F.count("correction").alias("corrections"),
    )
    return docs.select(id_col, text_col).join(again, id_col, "left").select(id_col, F.coalesce("fixed", text_col).alias(text_col), F.coalesce("corrections", F.lit(0).cast("long")).alias("corrections"))
