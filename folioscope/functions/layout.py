"""Layout of documents: headings, lines to skip, tables, kinds of paragraphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, let, sentences, words

# Fixed values.
NOT_HEADINGS = (
    "GRAVITATIONAL", "IMPROVED", "ADVANCED", "BANDIT", "CONTROLLER", "LIGHT WOUND", "HEAVY WOUND", "TOHIT", "TORSO", "HEAD", "DAMAGE",
    "SINGLE SHOT", "SINGLE BARREL", "QUICK SHOT", "DETECT", "THROW", "RANGE", "STARING", "ORIES",
)
SKIPPED = (
    r"table of contents", r"^\s*thank you", r"special thanks", r"credits", r"designed by", r"illustrated by",
    r"advertisement", r"visit our website", r"customer service", r"all rights reserved", r"contact\s*us", r"customer\s*support|technical\s*support",
    r"^\s*component list", r"^game components$", r"^box contents$", r"^in the box$", r"^you should have$", r"^this game includes$",
    r"^\s*table\s+of\s+contents\s*$", r"^\s*contents\s*$", r"\.\s*\.\s*\.\s*\.+\s*\d+\s*$", r"^\d+\s*$",
    r"narrative\s+design:", r"writing:", r"proofreading:", r"graphic\s+design:", r"3d\s+modelling:", r"dtp:", r"production:",
    r"tests?\s+and\s+development:", r"internal\s+testing:", r"rulebook\s+&\s+gameplay", r"game\s+world\s+team:", r"dedicated\s+to",
    r"^\d+x\s+", r"^\d+\s+x\s+", r"^\d+\s*x.*quantity", r"^\s*component\s+type",
)
CREDITS = (
    r"narrative\s+design:", r"writing:", r"proofreading:", r"graphic\s+design:", r"illustrations?:", r"3d\s+modelling:", r"dtp:", r"production:",
    r"tests?\s+and\s+development:", r"internal\s+testing:", r"based\s+on:", r"dedicated\s+to",
)
COMPONENTS = r"component\s*list|game\s*components"
TOPICS = (
    "water", "window", "anomaly", "enemy", "loot", "radiation", "movement", "attack", "weapon", "artifact", "grenade", "bolt", "decoy", "attention", "stalker",
    "move through", "line of sight", "los", "action", "turn", "phase", "round", "card", "tile", "damage", "heal", "search", "objective",
)


SECTIONS = (
    "setup", "game setup", "objective", "goal", "components", "overview", "gameplay", "game play", "turn structure", "player turn", "phases", "actions", "movement", "combat", "trading", "resources",
    "winning", "end game", "end of game", "victory", "scoring", "special rules", "variants", "solo mode", "team play", "reference", "quick reference", "glossary", "FAQ", "clarifications",
    "mission", "enemies", "anomalies", "artifacts", "equipment", "weapons", "armor", "radiation", "attention", "status", "tokens",
)


def section_name(t: Column, before: Column | None = None) -> Column:
    """A section's name from a paragraph: after a number, before a bar, a short first line like a title, a line with a section's word; else before."""
    found = lambda p: F.when(t.rlike(p), F.trim(F.regexp_extract(t, p, 1)))
    lines = F.split(t, "\n")
    line = F.trim(F.get(lines, F.lit(0)))
    capitals = F.length(F.regexp_replace(line, r"\P{Lu}", ""))
    titled = ((line == F.upper(line)) & line.rlike(r"\p{L}")) | (line.rlike(r"^\p{Lu}") & (capitals >= 2))
    n = F.size(words(line))
    named = any_of(F.lower(line), [s.lower() for s in SECTIONS]) & (~line.endswith(".") | (n <= 6))
    title = F.when((line != "") & (F.length(line) < 60) & titled & (named | ((n <= 8) & ~line.endswith("."))), line)

    def by_word(s: str) -> Column:
        near = F.filter(F.slice(lines, 1, 3), lambda x: F.contains(F.lower(x), F.lit(s.lower())))
        short = F.filter(F.transform(near, lambda x: F.trim(F.regexp_replace(x, r"^\|+|\|+$", ""))), lambda x: F.length(x) < 60)
        return F.when(F.substring(t, 1, 150).rlike(rf"(?i)\b{s}\b"), F.coalesce(F.get(short, F.lit(0)), F.lit(s.title())))

    return F.coalesce(found(r"^\d+\.?\d*\s+([A-Z][A-Za-z\s]{2,50})"), found(r"^\|?\s*([A-Z][A-Za-z\s&]{3,50})\s*\|"), title, *map(by_word, SECTIONS), *([] if before is None else [before]))


def is_header(line: Column) -> Column:
    """A line of up to 40 characters in capitals or with over three of them."""
    capitals = F.length(F.regexp_replace(line, r"\P{Lu}", ""))
    return (F.length(line) <= 40) & (((line == F.upper(line)) & line.rlike(r"\p{Lu}")) | (capitals > 3))


def caps_heading(t: Column, barred: Sequence[str] = NOT_HEADINGS) -> Column:
    """A section's heading: 2 to 15 words of 2 letters and more, all in capitals, in at most 100 characters."""
    w = words(F.regexp_replace(t, r"[^\p{L}\p{N}_\s]", ""))
    capital = lambda x: (x == F.upper(x)) & x.rlike(r"\p{Lu}") & (F.length(x) >= 2)
    return (F.length(t) <= 100) & ~any_of(F.upper(t), barred) & F.size(w).between(2, 15) & F.forall(w, capital)


def _like_title(t: Column, strict: bool) -> Column:
    w = words(t)
    longer = F.filter(w, lambda x: F.length(x) > 2)
    led = F.size(F.filter(longer, lambda x: x.rlike(r"^\p{Lu}")))
    fits = (F.length(t) <= 150) & ~F.trim(t).contains("\n") & F.size(w).between(2, 20) & (F.size(longer) > 0) & (led >= F.size(longer) * 0.7)
    return fits & ~t.contains(":") & ~F.trim(t).rlike("(,|and)$") if strict else fits


def title_heading(t: Column, strict: bool = True) -> Column:
    """A subsection's heading: one line of 2 to 20 words in at most 150 characters, 70 % of its longer words capitalised.

    strict also bars colons and endings of lists; texts from character recognition are read without it.
    """
    return _like_title(t, strict) & ~caps_heading(t)


def is_example(t: Column) -> Column:
    """Whether a sentence of t starts with Example:"""
    return F.exists(sentences(F.trim(t)), lambda s: F.trim(s).startswith("Example:"))


def is_skipped(t: Column) -> Column:
    """Whether a paragraph is front matter, credits or a list of components."""
    return t.rlike("(?i)" + "|".join(SKIPPED))


def is_contents_line(t: Column, page: Column) -> Column:
    """An entry of a table of contents on the first three pages: dotted leader or digits at the end."""
    return (page <= 3) & t.rlike(r"\.\s*\.\s*\.|\d+\s*$")


def body_lines(t: Column) -> Column:
    """A page without its first and last line, where it has more than 4."""
    return let(F.split(t, "\n"), lambda ls: F.when(F.size(ls) > 4, F.array_join(F.slice(ls, 2, F.greatest(F.size(ls) - 2, F.lit(0))), "\n")).otherwise(t))


def spaced_table(t: Column) -> Column:
    """t with an empty line after each group of bullets, where it has 3 bullets and more."""
    bullet = lambda x: F.coalesce(F.trim(x).startswith("•"), F.lit(False))

    def spaced(lines: Column) -> Column:
        ends = F.transform(lines, lambda x, i: F.when(bullet(x) & ~bullet(F.get(lines, i + 1)), F.array(x, F.lit(""))).otherwise(F.array(x)))
        return F.when(F.size(F.filter(lines, bullet)) >= 3, F.array_join(F.flatten(ends), "\n")).otherwise(t)

    return let(F.split(t, "\n"), spaced)


def same_topic(a: Column, b: Column, terms: Sequence[str] = TOPICS, least: float = 0.6) -> Column:
    """Whether two texts share their topics: common terms over the larger set; true where either has none."""
    of = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(rf"\b({'|'.join(terms)})\b"), F.lit(1)))
    return let(F.struct(of(a).alias("a"), of(b).alias("b")), lambda s: (F.size(s["a"]) == 0) | (F.size(s["b"]) == 0) | (F.size(F.array_intersect(s["a"], s["b"])) / F.greatest(F.size(s["a"]), F.size(s["b"])) >= least))


def kinds(paragraphs: Column, strict: bool = True) -> Column:
    """Of an array of paragraphs: blank, credits, components, example, caps, title or text for each.

    A heading counts where the next paragraph is a subsection's heading or holds
    a sentence of 5 words and more; else it is caption (capitals: left out) or
    text (title case: content that is appended as it is, so called label).
    """
    enough = lambda t: F.exists(sentences(t), lambda s: F.size(words(s)) >= 5)

    def looked_at(p: Column) -> Column:
        """A paragraph with what it looks like, found once; no heading has over 150 characters."""
        t = F.trim(p)
        short = (t != "") & (F.length(t) <= 150)
        shape = F.when(short & caps_heading(t), "caps").when(short & _like_title(t, strict), "title")
        return F.struct(t.alias("t"), shape.alias("shape"))

    def kind(x: Column, after: Column) -> Column:
        t, shape = x["t"], F.coalesce(x["shape"], F.lit(""))
        follows = F.coalesce((after["t"] != "") & ((after["shape"] == "title") | (after["shape"].isNull() & enough(after["t"]))), F.lit(False))
        return (
            F.when(t == "", "blank").when(t.rlike("(?i)" + "|".join(CREDITS)), "credits").when(t.rlike("(?i)" + COMPONENTS), "components")
            .when(is_example(t), "example").when(shape == "caps", F.when(follows, "caps").otherwise("caption"))
            .when(shape == "title", F.when(follows, "title").otherwise("label")).otherwise("text")
        )

    return let(F.transform(paragraphs, looked_at), lambda ps: F.transform(ps, lambda x, i: kind(x, F.get(ps, i + 1))))
