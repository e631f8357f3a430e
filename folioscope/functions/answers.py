"""Answers of forum posts: cleaning, quotes, length and usefulness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import capitalised, for_matching, jaccard, let, sentences, squeezed, words

# Fixed values.
MENTIONS = (r"\b[A-Z][a-z]+\s+[A-Z][a-z]*@\w+\s*", r"\b[a-z]+\s+[a-z]+@\w+\s*", r"(?:^|[.!?]\s+)@\w+\s*", r"@\w+\s+(?:says?|wrote|mentioned):\s*")
NAMED_QUOTE = r"\b[A-Z][a-z]+ [A-Z][a-z]+@\w+\s*"
INLINE = r"(?i)(Question:|Q:)\s*.+?(Answer:|A:)\s*"
PREFIXES = (
    r"^(Hmm,?|Well,?|So,?|Actually,?|Basically,?)\s+",
    r"^(I think|I believe|In my opinion|IMHO|IMO)\s+",
    r"^(Good question[.,!]\s+)",
    r"^(Let me see[.,!]\s+)",
    r"^(Can't remember [^,]+,\s+but\s+)",
    r"^(I don't have [^,]+,\s+but\s+)",
)
SUFFIXES = (r"\s+(Hope (that )?helps?|Cheers|Thanks)[.,!]*$", r"\s+(Let me know if you have questions?)[.,!]*$")
ACKNOWLEDGED = r"(?i)^((thanks?|thank you|thx|ty)|(ok|okay)|(got it|understood)|(nice|cool|great)|(\+1|agree|same here))[\s!.]*$"
USEFUL = r"(?i)(?:page|p\.|pg\.)\s*\d+|(?:rulebook|rules?|manual)|(?:according to|the rules? state|in the)|(?:you (?:can|should|must|need)|it (?:says|states))"
SPECULATIVE = r"(?i)I don't know|I'm not sure|I think maybe|\bprobably\b|I guess|not certain|can't remember|unsure|unclear"
DEFINITIVE = r"(?i)\b(yes|no|correct|incorrect|must|cannot|always|never|exactly|definitely)\b"
LONGEST, SHORTEST, TOO_SHORT = 500, 50, 15


def last_of_quotes(t: Column) -> Column:
    """What follows the last of two and more mentions, if it is 50 characters and more; else t."""
    tail = F.trim(F.regexp_extract(t, r"(?s).*@\w+(.*)$", 1))
    return F.when((F.regexp_count(t, F.lit(r"@\w+")) >= 2) & (F.length(tail) >= 50), tail).otherwise(t)


def without_attributions(t: Column) -> Column:
    for p in MENTIONS:
        t = F.regexp_replace(t, p, "")
    return F.trim(F.regexp_replace(t, r"\s{2,}", " "))


def _alike(a: Column, b: Column) -> Column:
    return jaccard(F.array_distinct(words(for_matching(a))), F.array_distinct(words(for_matching(b))))


def without_question(t: Column, question: Column) -> Column:
    """t without the question it repeats at its start and without inline questions."""
    plain = F.regexp_replace(t, NAMED_QUOTE, "")
    first = let(F.regexp_extract(plain, r"(?s)^.*?[.!?]\s+", 0), lambda f: F.when(f == "", plain).otherwise(f))
    starts = _alike(question, F.substring(t, F.lit(1), F.length(question) + 100)) > 0.6
    rest = F.when(starts & (_alike(first, question) > 0.5), F.substring(plain, F.length(first) + 1, F.length(plain)))
    kept = F.when(starts, F.trim(F.coalesce(rest, plain))).otherwise(plain)
    return F.trim(F.regexp_replace(kept, INLINE, ""))


def without_fillers(t: Column) -> Column:
    for p in PREFIXES + SUFFIXES:
        t = F.regexp_replace(t, f"(?i){p}", "")
    return capitalised(squeezed(t))


def shortened(t: Column) -> Column:
    """t of at most 500 characters: its first sentences that fit, or a cut where those are under 50."""
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))

    def add(s: Column, x: Column) -> Column:
        more = F.when(s["text"] == "", x).otherwise(F.concat(s["text"], F.lit(" "), x))
        full = s["full"] | (F.length(more) > LONGEST)
        return F.struct(F.when(full, s["text"]).otherwise(more).alias("text"), full.alias("full"))

    kept = F.aggregate(sentences(t), start, add, lambda s: s["text"])
    cut = let(kept, lambda k: F.when(F.length(k) >= SHORTEST, k).otherwise(F.concat(F.substring(t, 1, LONGEST - 3), F.lit("..."))))
    return F.when(F.length(t) <= LONGEST, t).otherwise(cut)


def cleaned(t: Column, question: Column) -> Column:
    """All cleaning in turn. An empty or null question removes no quote of it."""
    return let(last_of_quotes(t), lambda a: let(without_attributions(a), lambda b: let(
        F.when(F.coalesce(question, F.lit("")) != "", without_question(b, question)).otherwise(b), lambda c: let(without_fillers(c), shortened)
    )))


def usefulness(content: Column, question: Column, by_asker: Column) -> Column:
    """struct(score, text): how useful a post is as an answer (0 and more) and its cleaned text. A null post counts as empty."""
    post, asked = F.trim(F.coalesce(content, F.lit(""))), F.coalesce(question, F.lit("")) != ""
    dull = (F.length(post) < TOO_SHORT) | post.rlike(ACKNOWLEDGED)
    out = lambda s, t: F.struct(s.cast("int").alias("score"), t.alias("text"))
    return F.when(dull, out(F.lit(0), post)).otherwise(let(cleaned(post, question), lambda t: out(_points(t, asked, by_asker), t)))


def _points(t: Column, asked: Column, by_asker: Column) -> Column:
    n, marks = F.length(t), F.regexp_count(t, F.lit(r"\?"))
    base = F.when(asked, 2).otherwise(0)
    length = F.when(n > 600, -2).when(n > 400, 1).when(n > 200, 3).when(n >= 50, 4).otherwise(0)
    when = lambda c, k: F.when(c, k).otherwise(0)
    doubt = F.when(marks > 2, -5).when(marks == 2, -3).when(marks == 1, -2).otherwise(0)
    total = base + length + when(t.rlike(USEFUL), 3) + when(t.rlike(r"\b\d+\b"), 1) + when(t.rlike(DEFINITIVE), 2) + when(t.rlike(SPECULATIVE), -3)
    total = total + doubt + when(F.coalesce(by_asker, F.lit(False)), -2) + when(t.rlike(r"(?i)^(I think|Maybe|Perhaps)"), -1)
    return F.when(n < TOO_SHORT, base).otherwise(F.greatest(F.lit(0), total))
