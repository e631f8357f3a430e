"""Questions: intent, type, cleaning, splitting and extraction from a thread's title and first post."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, capitalised, clauses, first_word, let, sentences, squeezed

# Fixed values.
INTENTS = (
    ("how_many", r"\b(how many|how much|what number)\b"),
    ("how_to", r"\b(how (do|does|can|to)|what (is the (way|process|method)|are the steps))\b"),
    ("what_is", r"\b(what is|what are|what does|define)\b"),
    ("when", r"\b(when|at what point|during which)\b"),
    ("where", r"\b(where|in which location)\b"),
    ("who", r"\b(who|which player)\b"),
    ("why", r"\b(why|for what reason)\b"),
    ("can", r"\b(can|may|is it (possible|allowed))\b"),
)
NEEDS = {"how_to": "procedural", "what_is": "definition", "how_many": "quantitative", "when": "temporal", "where": "locational", "can": "permission"}
TYPES = (
    ("procedural", ("how", "steps", "process", "perform", "do")),
    ("definitional", ("what", "define", "means", "is")),
    ("quantitative", ("how many", "how much", "number")),
    ("conditional", ("when", "if", "during", "while")),
    ("permission", ("can", "may", "allowed", "able to")),
    ("locational", ("where", "which space", "location")),
)
GREETINGS = (r"^(hi|hello|hey|greetings)[\s!,]*", r"(thanks?|thank you|thx|ty)\s*(in advance|!)*$", r"^(sorry|excuse me)[\s!,]*")
ASKING = ("how", "what", "when", "where", "why", "who", "which", "can", "should", "does", "is", "are")
INNER = (" can ", " should ", " could ", " would ", " does ", " do ")
LONGEST = 150


def intent(q: Column) -> Column:
    """The first intent whose pattern occurs, else general."""
    return F.coalesce(*(F.when(F.lower(q).rlike(p), name) for name, p in INTENTS), F.lit("general"))


def need(kind: Column) -> Column:
    """What an answer to a question of this intent needs, else null."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in NEEDS.items() for x in pair)), kind)


def needs(kind: Column) -> Column:
    """struct of six flags, one for each need: what an answer to a question of this intent needs."""
    return F.struct(*(F.coalesce(need(kind) == n, F.lit(False)).alias(f"needs_{n}") for n in NEEDS.values()))


def question_type(q: Column) -> Column:
    """The first type of which a key word occurs, inside words as well; else general."""
    return F.coalesce(*(F.when(any_of(F.lower(q), words), name) for name, words in TYPES), F.lit("general"))


def is_question(t: Column) -> Column:
    return F.contains(t, F.lit("?")) | first_word(t).isin(*ASKING)


def with_mark(t: Column) -> Column:
    """t with a question mark, if it has none at its end and reads like a question."""
    asks = first_word(t).isin(*ASKING) | any_of(F.lower(F.trim(t)), INNER)
    return F.when(~F.trim(t).endswith("?") & asks, F.concat(F.trim(t), F.lit("?"))).otherwise(F.trim(t))


def cleaned(t: Column) -> Column:
    """Without greetings and thanks, blanks squeezed, first letter in upper case."""
    for g in GREETINGS:
        t = F.regexp_replace(t, f"(?i){g}", "")
    return capitalised(squeezed(t))


def core(t: Column) -> Column:
    """A long title's first short sentence that asks, else its first such clause, else its start up to a blank."""
    short = lambda s: F.length(s) < LONGEST
    sentence = F.get(F.filter(sentences(t), lambda s: F.contains(s, F.lit("?")) & short(s)), F.lit(0))
    clause = F.get(F.filter(F.transform(F.split(t, ","), lambda c: F.trim(c)), lambda c: first_word(c).isin(*ASKING) & short(c)), F.lit(0))
    head = F.substring(t, 1, LONGEST)
    whole_words = F.regexp_extract(head, "(?s)^(.*) ", 1)
    head = F.when(F.length(whole_words) > 50, whole_words).otherwise(head)
    return F.coalesce(sentence, with_mark(clause), F.when(F.length(t) > LONGEST, with_mark(head)).otherwise(t))


def split_questions(t: Column) -> Column:
    """Questions of t, cut after a mark that a capital follows, of more than 15 characters; t itself if there is none."""
    parts = F.transform(F.split(t, r"\?\s*(?=[A-Z])"), lambda p: F.trim(p))
    marked = F.transform(parts, lambda p: cleaned(F.when((p == "") | p.endswith("?"), p).otherwise(F.concat(p, F.lit("?")))))
    good = F.filter(marked, lambda q: is_question(q) & (F.length(q) > 15))
    return let(good, lambda g: F.when(F.size(g) > 0, g).otherwise(F.array(t)))


def all_questions(title: Column, content: Column) -> Column:
    """Every question of a first post; the title's alone where there is no text; a short title leads a lone one that doesn't ask by itself."""
    t, body = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(content, F.lit("")))
    none = F.array().cast("array<string>")

    def led(qs: Column) -> Column:
        q = F.get(qs, F.lit(0))
        leads = (F.size(qs) == 1) & (t != "") & ~first_word(q).isin(*ASKING) & (F.length(cleaned(t)) < 80)
        return F.when(leads, F.array(F.concat(cleaned(t), F.lit(": "), q))).otherwise(qs)

    return F.when((body == "") & (t == ""), none).when(body == "", F.array(cleaned(t))).otherwise(let(split_questions(body), led))


def extract(title: Column, content: Column) -> Column:
    """The question that a thread asks; nulls count as empty, null where both are empty."""
    body = F.trim(F.coalesce(content, F.lit("")))
    bound = F.struct(cleaned(F.trim(F.coalesce(title, F.lit("")))).alias("t"), body.alias("c"), split_questions(body).getItem(0).alias("q"))
    return let(bound, lambda b: _choose(b["t"], b["c"], b["q"]))


def _choose(t: Column, c: Column, q: Column) -> Column:
    n, has = F.length(t), c != ""
    asks, colon = F.contains(t, F.lit("?")), F.contains(t, F.lit(":"))
    topic = F.trim(F.substring_index(t, ":", 1))
    on_topic = F.when((F.length(topic) < 30) & (F.length(q) < 100), F.concat(topic, F.lit(": "), q)).otherwise(q)
    complete = asks | (n > 80) | ((n > 40) & ~has)
    repeats = (n > 10) & F.startswith(F.lower(F.substring(c, 1, 100)), F.lower(F.substring(t, 1, 20)))
    parts = F.transform(clauses(c), lambda s: cleaned(s))
    part = F.coalesce(F.get(F.filter(parts, lambda s: is_question(s) & (F.length(s) > 10)), F.lit(0)), F.get(parts, F.lit(0)))
    joined = let(with_mark(F.concat(t, F.lit(": "), part)), lambda m: F.when(F.length(m) > LONGEST, core(m)).otherwise(m))
    return (
        F.when(asks & (n < LONGEST), t)
        .when((n > LONGEST) & (F.length(core(t)) > 10), core(t))
        .when(has & colon, on_topic)
        .when(complete & (n > 10), with_mark(t))
        .when(~complete & has & repeats, with_mark(q))
        .when(~complete & has & (F.length(part) > 10), joined)
        .when(has, with_mark(q))
        .when(t != "", with_mark(t))
    )
