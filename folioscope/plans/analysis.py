"""Queries that analyse questions: entities, enhancement, keywords and search terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import analysis as N
from ..functions import text as T
from .qa import INTENT_SQL, PLAIN
from .registry import query, read


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _items(values) -> str:
    return "[" + ", ".join(map(_text, values)) + "]"


TERMS = N.ordered_terms(N.ENTITIES)
POSTS_SQL = f"SELECT conv_id, turn, {PLAIN} AS t FROM conversations"
BLANKED = ", ".join(f"replace(t{k}, {_text(term)}, {_text(' ' * len(term))}) AS t{k + 1}" for k, (_, term) in enumerate(TERMS))
SEEN = ", ".join(f"CASE WHEN contains(t{k}, {_text(term)}) THEN {_text(f'{kind}:{term}')} END" for k, (kind, term) in enumerate(TERMS))
KIND_OF = {term: kind for kind, terms in N.ENTITIES.items() for term in terms}
NAMED = f"list_transform(list_filter({{}}, lambda x: NOT list_contains(parts, lower(x)){{}}), lambda x: coalesce(map({_items(KIND_OF)}, {_items(KIND_OF.values())})[lower(x)] || ':' || lower(x), 'UNKNOWN:' || x))"
ENTITY_SQL = rf"""SELECT conv_id, turn, t, list_sort(list_distinct(list_concat(found, list_concat({NAMED.format(r"regexp_extract_all(t, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b')", f" AND NOT list_contains({_items(N.COMMON)}, lower(x))")}, {NAMED.format(r"regexp_extract_all(t, '\b[A-Z]{2,}\b')", "")})))) AS named
 FROM (SELECT *, flatten(list_transform(found, lambda x: string_split(split_part(x, ':', 2), ' '))) AS parts FROM (SELECT conv_id, turn, t, list_filter([{SEEN}], lambda x: x IS NOT NULL) AS found FROM (SELECT conv_id, turn, t, lower(t) AS t0, {BLANKED} FROM ({POSTS_SQL}))))"""


def posts(spark, d) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", T.ascii_only(F.col("text")).alias("t"))


@query(f"SELECT conv_id, turn, list_aggregate(named, 'string_agg', ',') AS entities, len(list_filter(named, lambda x: NOT starts_with(x, 'UNKNOWN')))::BIGINT AS known FROM ({ENTITY_SQL})")
def op_entities(spark, d):
    """Named entities of each post: type:name, sorted."""
    e = posts(spark, d).select("conv_id", "turn", N.entities(F.col("t")).alias("named"))
    joined = F.when(F.size("named") > 0, F.array_join("named", ","))
    return e.select("conv_id", "turn", joined.alias("entities"), F.size(N.known_entities(F.col("named"))).cast("long").alias("known"))


@query(f"""SELECT conv_id, turn, len(list_intersect(k, b))::BIGINT AS shared, CASE WHEN len(list_intersect(k, b)) >= 2 THEN 1 + least(0.2, 0.1 * len(list_intersect(k, b))) ELSE 1 END::DOUBLE AS boost FROM
 (SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM (SELECT conv_id, turn, list_filter(named, lambda x: NOT starts_with(x, 'UNKNOWN')) AS k FROM ({ENTITY_SQL}))) WHERE b IS NOT NULL""")
def op_entity_boost(spark, d):
    """Entities that each post shares with the one before it, and the boost for them."""
    from pyspark.sql import Window

    from ..operators.retrieve import entity_boosted

    k = posts(spark, d).select("conv_id", "turn", N.known_entities(N.entities(F.col("t"))).alias("k"))
    k = k.withColumn("b", F.lag("k").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b is not null").withColumn("score", F.lit(1.0))
    return entity_boosted(k, F.col("b"), F.col("k")).select("conv_id", "turn", F.col("entity_matches").cast("long").alias("shared"), F.col("score").alias("boost"))


WORDS_SQL = r"list_filter(regexp_extract_all(lower(t), '\w+'), lambda w: regexp_matches(w, '^[a-z]+$'))"
LEMMA_SQL = "CASE WHEN length({0}) > 4 AND {0} LIKE '%ies' THEN {0}[:-4] || 'y' WHEN length({0}) > 3 AND {0} LIKE '%s' AND {0} NOT LIKE '%ss' AND {0} NOT LIKE '%us' THEN {0}[:-2] ELSE {0} END"
TAGGED_SQL = f"""SELECT *, list_filter(lemmas, lambda w: list_contains({_items(N.VERBS)}, w)) AS vs, list_filter(list_transform(list_filter(ws, lambda w: NOT list_contains({_items(N.STOP)}, w) AND length(w) > 2), lambda w: {LEMMA_SQL.format("w")}), lambda w: NOT list_contains({_items(N.VERBS)}, w)) AS ns
 FROM (SELECT *, list_transform(ws, lambda w: {LEMMA_SQL.format("w")}) AS lemmas FROM (SELECT *, {WORDS_SQL} AS ws FROM ({POSTS_SQL})))"""
CONCEPT_OF = {term: concept for concept, terms in N.VOCABULARY.items() for term in terms}
DISTINCT = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
CONCEPTS_SQL = f"list_concat(list_filter(list_transform(lemmas, lambda w: map({_items(CONCEPT_OF)}, {_items(CONCEPT_OF.values())})[w]), lambda x: x IS NOT NULL), list_filter([{', '.join(f'CASE WHEN contains(lower(t), {_text(m)}) THEN {_text(c)} END' for c, ts in N.VOCABULARY.items() for m in ts if ' ' in m)}], lambda x: x IS NOT NULL))"
SYNONYM = ", ".join(f"CASE WHEN len(list_intersect(qs, {_items(ts)})) > 0 THEN list_filter({_items(ts)}, lambda x: NOT list_contains(qs, x))[1] END" for ts in N.VOCABULARY.values())
ENHANCED_SQL = rf"""SELECT conv_id, turn, trim(t || coalesce(' ' || list_concat(list_concat(list_filter(syn, lambda x: NOT list_contains({_items(N.GENERIC)}, x)), list_filter(syn, lambda x: list_contains({_items(N.GENERIC)}, x))), more)[1], '')) AS enhanced, list_aggregate(cs, 'string_agg', ',') AS concepts FROM
 (SELECT *, CASE WHEN intent = 'how_to' AND len(vs) > 0 THEN list_filter(vs, lambda x: NOT list_contains(qs, x))[1:1] WHEN intent IN ('what_is', 'how_many') AND len(ns) > 0 THEN list_filter(ns, lambda x: NOT list_contains(qs, x))[1:1] WHEN len(cs) > 0 THEN list_filter(cs, lambda x: NOT list_contains(qs, x))[1:1] ELSE [] END AS more
 FROM (SELECT *, {INTENT_SQL} AS intent, list_filter([{SYNONYM}], lambda x: x IS NOT NULL) AS syn, {DISTINCT.format("call")} AS cs FROM (SELECT *, {CONCEPTS_SQL} AS call,
 list_transform(regexp_split_to_array(trim(lower(t)), '\s+'), lambda w: regexp_replace(w, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')) AS qs FROM ({TAGGED_SQL}))))"""


def tagged(spark, d) -> DataFrame:
    """Posts with verbs, nouns and concepts."""
    t = F.col("t")
    x = posts(spark, d).withColumns({"vs": N.verbs(t), "ns": N.nouns(t)})
    return x.withColumn("cs", N.concepts(t, F.transform(N.plain_words(t), N.lemma)))


@query(ENHANCED_SQL)
def op_enhanced(spark, d):
    """Each post with one word more for its search, and its concepts."""
    x = tagged(spark, d)
    return x.select("conv_id", "turn", N.enhanced(F.col("t"), F.col("vs"), F.col("ns"), F.col("cs")).alias("enhanced"), F.when(F.size("cs") > 0, F.array_join("cs", ",")).alias("concepts"))


@query(f"""SELECT conv_id, turn, list_aggregate(list_concat(kn, list_filter(held, lambda x: NOT list_contains(kn, x)))[1:5], 'string_agg', ',') AS keywords FROM (SELECT *, list_filter(ns, lambda w: NOT list_contains({_items(N.STOP_NOUNS)}, w)) AS kn,
 list_filter({_items((*N.DOMAIN, *N.PHRASES))}, lambda x: contains(lower(t), x)) AS held FROM ({TAGGED_SQL}))""")
def op_keywords(spark, d):
    """What an answer to each post should hold: nouns, then terms and phrases of the domain (collocations are tested apart)."""
    x = tagged(spark, d)
    k = N.keywords(F.col("t"), F.col("ns"), again=False)
    return x.select("conv_id", "turn", F.when(F.size(k) > 0, F.array_join(k, ",")).alias("keywords"))


LITE_SQL = rf"""SELECT conv_id, turn, type, list_aggregate(list_sort(list_filter(ws, lambda w: NOT list_contains({_items(N.STOP)}, w) AND length(w) > 2)), 'string_agg', ' ') AS key_terms, list_aggregate(vs, 'string_agg', ' ') AS verbs, list_aggregate(cs, 'string_agg', ',') AS concepts FROM
 (SELECT *, {"CASE " + " ".join(f"WHEN regexp_matches(lower(t), {_text(p)}) THEN {_text(n)}" for n, p in N.LITE_TYPES) + " ELSE 'general' END"} AS type, list_sort(list_filter(ws, lambda w: list_contains({_items(N.VERBS)}, w))) AS vs, list_filter({_items(N.CONCEPTS)}, lambda c: contains(lower(t), c)) AS cs
 FROM (SELECT *, list_distinct(regexp_extract_all(lower(t), '\b\w+\b')) AS ws FROM ({POSTS_SQL})))"""


@query(LITE_SQL)
def op_lite_analysis(spark, d):
    """The analysis that needs no tagger: type, key terms, verbs and concepts of each post."""
    x = posts(spark, d).select("conv_id", "turn", N.lite(F.col("t")).alias("a"))
    joined = lambda c, by: F.when(F.size(f"a.{c}") > 0, F.array_join(f"a.{c}", by)).alias(c)
    return x.select("conv_id", "turn", F.col("a.type").alias("type"), joined("key_terms", " "), joined("verbs", " "), joined("concepts", ","))


