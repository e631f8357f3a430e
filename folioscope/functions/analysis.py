"""Analysis of questions by vocabularies: entities, verbs, nouns, concepts, keywords, search terms and enhancement.

Without a tagger, words are told apart by lists: verbs are the action verbs, nouns all
other words over two letters that are no stop words, lemmas drop common endings.
Arrays of another analyser (an Arrow UDF, say) can be given in their place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .questions import intent
from .text import let

# Fixed values.
VOCABULARY = {
    "action": ("action", "perform", "execute", "take", "do", "make", "conduct"),
    "movement": ("move", "travel", "relocate", "movement", "position", "place"),
    "combat": ("attack", "fight", "shoot", "battle", "engage", "combat", "damage", "wound"),
    "resource": ("gain", "spend", "pay", "receive", "acquire", "collect", "resource"),
    "card": ("draw", "discard", "play", "reveal", "card", "hand"),
    "turn": ("round", "phase", "step", "turn", "sequence", "order"),
    "player": ("stalker", "character", "hero", "agent", "player"),
    "equipment": ("weapon", "gear", "item", "tool", "artifact", "equipment"),
    "location": ("zone", "area", "space", "territory", "region", "base", "location"),
    "condition": ("status", "effect", "modifier", "state", "condition"),
    "test": ("check", "skill test", "attribute test", "roll", "test", "dice"),
    "enemy": ("mutant", "monster", "creature", "threat", "anomaly", "enemy"),
    "mission": ("quest", "task", "objective", "goal", "mission"),
    "win": ("victory", "succeed", "complete", "achieve", "win"),
    "lose": ("defeat", "fail", "eliminated", "lose"),
}
ENTITIES = {
    "CHARACTER": ("stalker", "borsuk", "ghost", "hulyash", "degtyarev", "snork", "bloodsucker", "chimera", "controller", "pseudodog", "player", "character", "milady"),
    "LOCATION": ("zone", "lost territories", "mission map", "map", "entrance", "exit", "space", "area", "territory", "region", "base", "lost territory entrance", "window", "windows"),
    "WEAPON": ("akm", "ak", "knife", "grenade", "rifle", "pistol", "shotgun", "weapon", "gun", "firearm", "blade", "axe"),
    "ITEM": ("geiger counter", "detector", "bolt", "artifact", "loot", "ammo", "ammunition", "attachment", "container", "token", "card", "equipment", "gear", "item", "dice"),
    "MECHANIC": (
        "line of sight", "los", "action point", "ap", "turn token", "hp", "health point", "wound", "critical injury", "attention marker", "attention token", "focus token",
        "skill test", "defense roll", "attack roll", "damage", "turn", "round", "phase", "mission", "objective",
    ),
    "STATUS": ("exposed", "exposed token", "critical injury", "wounded", "radiation exposure", "radiation dosage", "poisoned", "bleeding", "stunned", "pinned", "dead", "dies", "death"),
    "ANOMALY": ("anomaly", "bubble", "vortex", "springboard", "burner", "anomaly symbol", "anomaly overlay", "anomalies"),
    "ENEMY_TYPE": ("human enemy", "mutant enemy", "mutant", "human", "psionic", "enemy", "enemies"),
}
COMMON = (
    "player", "players", "game", "turn", "round", "phase", "card", "cards", "dice", "roll", "table", "board", "piece", "token", "marker", "counter", "rule", "rules", "example", "note", "tip", "question", "answer",
    "the", "this", "that", "these", "those", "it", "its", "you", "your", "what", "when", "where", "who", "why", "how", "can", "does", "do", "is", "are",
)
STOP_NOUNS = ("action", "move", "cost", "through", "can", "does", "what", "how", "when", "where", "who", "why", "do")
DOMAIN = (
    "water", "reload", "window", "anomaly", "artifact", "enemy", "stalker", "radiation", "loot", "weapon", "card", "mission", "combat", "damage", "heal", "rest", "search", "trade", "wound", "status", "equipment", "psionic", "mutant",
)
PHRASES = ("line of sight", "action point", "skill test", "zone of control", "free action")
GENERIC = ("action", "do", "make", "perform", "take", "execute", "conduct")
VERBS = ("move", "attack", "draw", "discard", "place", "flip", "reveal", "resolve", "use", "take", "gain", "lose", "damage", "heal", "roll", "play", "activate", "trigger", "setup", "remove")
STOP = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "should", "could", "may", "might", "must", "can", "of", "in", "on", "at", "to", "for", "with", "from", "by",
    "as", "or", "and", "but", "if", "then", "this", "that", "these", "those", "my", "your", "their", "i", "you",
)
SYNONYMS = {
    "move": ("relocate", "traverse", "travel", "go"), "attack": ("combat", "fight", "engage", "strike"), "draw": ("take", "pick up", "obtain"), "discard": ("remove", "dispose", "eliminate"), "place": ("put", "position", "set"),
    "flip": ("turn over", "reverse"), "reveal": ("show", "uncover"), "resolve": ("execute", "complete"), "round": ("turn", "cycle", "phase"), "space": ("tile", "location", "position"), "token": ("marker", "counter"), "damage": ("injury", "wound"),
    "range": ("distance", "reach"), "anomaly": ("hazard",), "artifact": ("item",), "mission": ("scenario", "quest"), "stalker": ("character",), "enemy": ("hostile", "foe"), "adjacent": ("next to", "neighboring"),
}
CONCEPTS = ("stalker", "enemy", "anomaly", "artifact", "mission", "token", "card", "space", "tile", "round", "turn", "phase", "range", "damage", "line of sight", "los", "hp", "action", "movement")
LITE_TYPES = (
    ("how_to", r"\b(how (do|does|to|can|should)|what (is|are) the (steps|process|way))"), ("definition", r"\b(what (is|are|does|means?)|define)"), ("quantity", r"\b(how many|how much|number of|amount of)"), ("location", r"\b(where|which space|which tile)"),
    ("timing", r"\b(when|at what point|timing|order)"), ("condition", r"\b(can you|is it possible|are you allowed|may you)"), ("comparison", r"\b(difference between|versus|vs|compared)"), ("reason", r"\b(why|reason|purpose)"),
)


def _list(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _in(values: Sequence[str]):
    return lambda x: x.isin(*values)


def longest_first(text: Column, terms: Sequence[tuple[str, str]]) -> Column:
    """type:term of each term that occurs in text, in their order; what is found is blanked, so that later terms don't see it."""
    each = F.array(*(F.struct(F.lit(f"{kind}:{term}").alias("name"), F.lit(term).alias("term"), F.lit(" " * len(term)).alias("blank")) for kind, term in terms))
    start = F.struct(text.alias("t"), F.array().cast("array<string>").alias("found"))

    def look(s: Column, x: Column) -> Column:
        found = F.struct(F.replace(s["t"], x["term"], x["blank"]).alias("t"), F.concat(s["found"], F.array(x["name"])).alias("found"))
        return F.when(F.contains(s["t"], x["term"]), found).otherwise(s)

    return F.aggregate(each, start, look, lambda s: s["found"])


def ordered_terms(vocabulary: Mapping[str, Sequence[str]]) -> list[tuple[str, str]]:
    """(type, term), longer terms of a type first."""
    return [(kind, term) for kind, terms in vocabulary.items() for term in sorted(terms, key=len, reverse=True)]


def entities(text: Column, vocabulary: Mapping[str, Sequence[str]] = ENTITIES) -> Column:
    """Sorted type:name of the entities of text; capitalised words and abbreviations that no list has are of type UNKNOWN.

    Terms match inside words as well. Null has none.
    """
    kinds = {term: kind for kind, terms in vocabulary.items() for term in terms}
    lookup = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))

    def named(x: Column) -> Column:
        return F.concat(F.coalesce(F.element_at(lookup, F.lower(x)), F.lit("UNKNOWN")), F.lit(":"), F.when(F.element_at(lookup, F.lower(x)).isNull(), x).otherwise(F.lower(x)))

    def whole(found: Column) -> Column:
        parts = F.flatten(F.transform(found, lambda x: F.split(F.substring_index(x, ":", -1), " ")))
        free = lambda x: ~F.array_contains(parts, F.lower(x))
        caps = F.filter(F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"), F.lit(0)), lambda x: free(x) & ~F.lower(x).isin(*COMMON))
        short = F.filter(F.regexp_extract_all(text, F.lit(r"\b[A-Z]{2,}\b"), F.lit(0)), free)
        return F.array_sort(F.array_distinct(F.concat(found, F.transform(caps, named), F.transform(short, named))))

    return F.coalesce(let(longest_first(F.lower(text), ordered_terms(vocabulary)), whole), F.array().cast("array<string>"))


def by_type(named: Column, types: Sequence[str] = (*ENTITIES, "UNKNOWN")) -> Column:
    """map(type, names) of entities, types without any left out."""
    of = lambda t: F.transform(F.filter(named, lambda x: F.startswith(x, F.lit(f"{t}:"))), lambda x: F.substring_index(x, ":", -1))
    return F.map_filter(F.map_from_arrays(_list(types), F.array(*(of(t) for t in types))), lambda _, v: F.size(v) > 0)


def known_entities(named: Column) -> Column:
    """entities that a list has: what boosts by shared entities compare."""
    return F.filter(named, lambda x: ~F.startswith(x, F.lit("UNKNOWN:")))


def plain_words(text: Column) -> Column:
    """Lower-case words of letters, in order."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"\w+"), F.lit(0)), lambda w: w.rlike("^[a-z]+$"))


def lemma(word: Column) -> Column:
    """word without a common ending: a stand-in for a lemmatiser."""
    n = F.length(word)
    return (
        F.when((n > 4) & word.endswith("ies"), F.concat(F.substring(word, 1, n - 3), F.lit("y")))
        .when((n > 3) & word.endswith("s") & ~word.endswith("ss") & ~word.endswith("us"), F.substring(word, 1, n - 1)).otherwise(word)
    )


def verbs(text: Column, known: Sequence[str] = VERBS) -> Column:
    """Lemmas of action verbs, in order."""
    return F.filter(F.transform(plain_words(text), lemma), _in(known))


def nouns(text: Column, known: Sequence[str] = VERBS, stop: Sequence[str] = STOP) -> Column:
    """Lemmas of words over two letters that are neither verbs nor stop words, in order."""
    kept = F.filter(plain_words(text), lambda w: ~w.isin(*stop) & (F.length(w) > 2))
    return F.filter(F.transform(kept, lemma), lambda w: ~w.isin(*known))


def concepts(text: Column, lemmas: Column, vocabulary: Mapping[str, Sequence[str]] = VOCABULARY) -> Column:
    """Concepts of lemmas (a term of two concepts counts for the later one), then those whose terms of several words occur in text."""
    of = {term: concept for concept, terms in vocabulary.items() for term in terms}
    lookup = F.create_map(*(F.lit(x) for pair in of.items() for x in pair))
    single = F.array_compact(F.transform(lemmas, lambda w: F.element_at(lookup, w)))
    several = F.array_compact(F.array(*(F.when(F.contains(F.lower(text), F.lit(t)), c) for c, terms in vocabulary.items() for t in terms if " " in t)))
    return F.array_distinct(F.concat(single, several))


def _words_asked(text: Column) -> Column:
    """Distinct words between white space, without marks at their ends, in lower case."""
    return F.array_distinct(F.transform(F.split(F.trim(F.lower(text)), r"\s+"), lambda w: F.regexp_replace(w, r"^\p{Punct}+|\p{Punct}+$", "")))


def enhanced(text: Column, found_verbs: Column, found_nouns: Column, found_concepts: Column, most: int = 1, vocabulary: Mapping[str, Sequence[str]] = VOCABULARY) -> Column:
    """text with at most so many more words: the first synonym not in it for each concept that a word of it names, generic ones last, then a word by intent."""

    def whole(words: Column) -> Column:
        new = []
        for terms in vocabulary.values():
            named = F.arrays_overlap(words, _list(terms))
            new.append(F.when(named, F.get(F.array_except(_list(terms), words), F.lit(0))))
        synonyms = F.array_compact(F.array(*new))
        special, generic = F.filter(synonyms, lambda w: ~w.isin(*GENERIC)), F.filter(synonyms, _in(GENERIC))
        kind = intent(text)
        fresh = lambda a: F.filter(F.slice(F.filter(a, lambda w: ~F.array_contains(words, w)), 1, 1), lambda w: w.isNotNull())
        none = F.array().cast("array<string>")
        more = (
            F.when((kind == "how_to") & (F.size(found_verbs) > 0), fresh(found_verbs)).when(kind.isin("what_is", "how_many") & (F.size(found_nouns) > 0), fresh(found_nouns))
            .when(F.size(found_concepts) > 0, fresh(found_concepts)).otherwise(none)
        )
        return F.trim(F.array_join(F.concat(F.array(text), F.slice(F.concat(special, generic, more), 1, most)), " "))

    return let(_words_asked(text), whole)


def collocations(text: Column, least: int = 2, top: int = 3) -> Column:
    """Neighbouring words that stand together least times and more, by pointwise mutual information, then by name."""

    def whole(ws: Column) -> Column:
        n = F.size(ws)
        count = lambda a, x: F.size(F.filter(a, lambda y: y == x))
        pairs = F.zip_with(F.slice(ws, 1, F.greatest(n - 1, F.lit(0))), F.slice(ws, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))

        def rated(ps: Column) -> Column:
            often = F.filter(F.array_distinct(ps), lambda p: count(ps, p) >= least)
            first, second = (lambda p: F.substring_index(p, " ", 1)), (lambda p: F.substring_index(p, " ", -1))
            by = F.transform(often, lambda p: F.struct((-F.log2(count(ps, p) * n / (count(ws, first(p)) * count(ws, second(p))))).alias("k"), p.alias("p")))
            return F.transform(F.slice(F.array_sort(by), 1, top), lambda x: x["p"])

        return let(pairs, rated)

    return let(F.regexp_extract_all(F.lower(text), F.lit(r"\w+|[^\w\s]"), F.lit(0)), whole)


def keywords(text: Column, found_nouns: Column, most: int = 5, again: bool = True) -> Column:
    """What an answer should hold: nouns, then terms and phrases of the domain that occur, then (again) collocations; the first few."""
    named = F.filter(found_nouns, lambda w: ~w.isin(*STOP_NOUNS) & (F.length(w) > 2))
    held = F.filter(_list((*DOMAIN, *PHRASES)), lambda t: F.contains(F.lower(text), t))
    more = F.concat(held, collocations(text)) if again else held
    return F.slice(F.concat(named, F.array_except(more, named)), 1, most)


def search_terms(found_nouns: Column, found_verbs: Column, names: Column, found_concepts: Column) -> Column:
    """The first three nouns, two verbs, two entities and two concepts of over two letters, each once."""
    parts = F.concat(F.slice(found_nouns, 1, 3), F.slice(found_verbs, 1, 2), F.slice(F.transform(names, lambda x: F.lower(F.substring_index(x, ":", -1))), 1, 2), F.slice(found_concepts, 1, 2))
    return F.filter(F.array_distinct(parts), lambda x: F.length(x) > 2)


def wordnet_class(tag: Column) -> Column:
    """a, v, n or r of a treebank tag; n where it is none of them."""
    return F.when(tag.startswith("J"), "a").when(tag.startswith("V"), "v").when(tag.startswith("R"), "r").otherwise("n")


def lite_type(text: Column) -> Column:
    return F.coalesce(*(F.when(F.lower(text).rlike(p), n) for n, p in LITE_TYPES), F.lit("general"))


def lite(text: Column) -> Column:
    """struct(type, key_terms, verbs, concepts, enhanced, search_terms, needs) without any tagger; arrays are sorted or in the lists' order."""
    low = F.lower(text)
    all_words = F.array_distinct(F.regexp_extract_all(low, F.lit(r"\b\w+\b"), F.lit(0)))
    terms = F.array_sort(F.filter(all_words, lambda w: ~w.isin(*STOP) & (F.length(w) > 2)))
    acts = F.array_sort(F.filter(all_words, _in(VERBS)))
    held = F.filter(_list(CONCEPTS), lambda c: F.contains(low, c))
    first = F.struct(lite_type(text).alias("type"), terms.alias("key_terms"), acts.alias("verbs"), held.alias("concepts"))

    def whole(a: Column) -> Column:
        near = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t)), " ".join(s[:2])) for t, s in SYNONYMS.items())))
        part = lambda x: F.when(F.size(x) > 0, F.array(F.array_join(x, " "))).otherwise(F.array().cast("array<string>"))
        more = F.array_join(F.concat(F.array(text), part(a["concepts"]), part(a["verbs"]), near), " ")
        found = F.concat(a["concepts"], a["verbs"])
        ranked = F.concat(found, F.slice(F.array_except(a["key_terms"], found), 1, 10))
        needs = F.when(a["type"].isin("how_to", "timing"), "procedural").when(a["type"] == "definition", "definition").when(a["type"] == "quantity", "quantitative").when(a["type"] == "condition", "conditional")
        return F.struct(a["type"].alias("type"), a["key_terms"].alias("key_terms"), a["verbs"].alias("verbs"), a["concepts"].alias("concepts"), more.alias("enhanced"), ranked.alias("search_terms"), needs.alias("needs"))

    return let(first, whole)
