"""Queries on questions, answers, layout, chunks, merging and learning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import layout as L
from ..functions import questions as Q
from ..functions import scores as C
from ..functions import text as T
from ..functions.analysis import STOP
from ..operators import chunk, learning, merge, spelling, threads
from ..operators.common import spread
from ..sources import html, sinks
from .registry import query, read


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(t: str, parts) -> str:
    return "(" + " OR ".join(f"contains({t}, {_quoted(p)})" for p in parts) + ")"


def _case(pairs, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


PLAIN = r"regexp_replace(text, '[^\x00-\x7F]', ' ', 'g')"
TYPE_SQL = lambda q: _case(((_any(f"lower({q})", ws), _quoted(n)) for n, ws in Q.TYPES), "'general'")
INTENT_SQL = _case(((f"regexp_matches(lower(t), {_quoted(p)})", _quoted(n)) for n, p in Q.INTENTS), "'general'")


@query(f"""SELECT conv_id, turn, intent, {_case(((f"intent = {_quoted(k)}", _quoted(v)) for k, v in Q.NEEDS.items()), "NULL")} AS need, {TYPE_SQL("t")} AS type
 FROM (SELECT *, {INTENT_SQL} AS intent FROM (SELECT conv_id, turn, {PLAIN} AS t FROM conversations))""")
def op_intent(spark, d):
    t = read(spark, d, "conversations").select("conv_id", "turn", T.ascii_only(F.col("text")).alias("t")).withColumn("intent", Q.intent(F.col("t")))
    return t.select("conv_id", "turn", "intent", Q.need(F.col("intent")).alias("need"), Q.question_type(F.col("t")).alias("type"))


KEY = lambda t: rf"list_distinct(regexp_extract_all(lower({t}), '\b[a-z]{{4,}}\b'))"
FOUND = lambda ws: f"CASE WHEN {_any('lower(a)', ws) if ws else 'regexp_matches(a, chr(92) || chr(100))'} THEN 1 ELSE 0 END"
COMPLETE_SQL = _case(((f"type = {_quoted(k)}", " + ".join(f"{w} * ({FOUND(ws)})" for w, ws in v)) for k, v in C.MARKERS.items()), "0")
TURNS_SQL = f"""SELECT conv_id, turn, a, q, {TYPE_SQL("q")} AS type FROM (SELECT conv_id, turn, t AS a, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS q
 FROM (SELECT conv_id, turn, {PLAIN} AS t FROM conversations)) WHERE q IS NOT NULL"""
NUM = lambda k: _case(((f"type = {_quoted(n)}", str(r[k])) for n, r in C.RANGES.items()), "NULL")


def turns(spark, d):
    """Each post as the answer to the one before it."""
    t = read(spark, d, "conversations").select("conv_id", "turn", T.ascii_only(F.col("text")).alias("a"))
    return t.withColumn("q", F.lag("a").over(Window.partitionBy("conv_id").orderBy("turn"))).where("q is not null")


@query(rf"""WITH p AS ({TURNS_SQL}), k AS (SELECT *, list_filter({KEY("q")}, lambda w: NOT list_contains([{", ".join(map(_quoted, C.COMMON))}], w)) AS asked, {KEY("a")} AS had, {NUM(0)} AS lo, {NUM(1)} AS hi, length(a) AS n,
 list_filter(list_transform(regexp_split_to_array(lower(a), '[.!?]+'), lambda s: trim(s)), lambda s: length(s) > 10) AS ss, list_filter(regexp_split_to_array(trim(lower(q)), '\s+'), lambda w: w <> '') AS bag FROM p),
 c AS (SELECT *, least(1.0, 0.5 + {COMPLETE_SQL} + CASE WHEN len(asked) > 0 THEN len(list_intersect(asked, had)) / len(asked) * 0.3 ELSE 0 END) AS completeness,
 CASE WHEN n < lo THEN n / lo WHEN n > hi THEN greatest(0, 1 - (n - hi) / (hi * 2)) ELSE 1 END AS conciseness,
 CASE WHEN len(ss) > 0 THEN list_avg(list_transform(ss, lambda s: len(list_intersect(list_distinct(list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '')), bag)) / len(list_distinct(list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> ''))))) ELSE 0.5 END AS consistency,
 CASE WHEN len({KEY("q")}) > 0 THEN len(list_intersect({KEY("q")}, had)) / len({KEY("q")}) ELSE 0.5 END AS overlap FROM k),
 s AS (SELECT *, 1 / (1 + exp(-(10 * overlap - 5) / 3)) AS relevance, 0.45 * overlap + 0.25 * overlap + 0.20 * overlap + 0.10 * overlap AS low, 0.60 * overlap + 0.25 * overlap + 0.10 * overlap + 0.05 * overlap AS high FROM c),
 t AS (SELECT *, greatest(CASE WHEN overlap > 0.7 THEN high ELSE low END, CASE WHEN overlap > 0.8 THEN 0.9 WHEN overlap > 0.7 THEN 0.85 WHEN overlap > 0.6 THEN 0.75 ELSE 0 END) AS accuracy FROM s),
 o AS (SELECT *, relevance * 0.3 + completeness * 0.25 + accuracy * 0.4 + conciseness * 0.05 AS overall FROM t)
 SELECT conv_id, turn, round(relevance, 6) AS relevance, round(completeness, 6) AS completeness, round(accuracy, 6) AS accuracy, round(consistency, 6) AS consistency, round(conciseness, 6) AS conciseness, round(overall, 6) AS overall,
 CASE WHEN overall >= 0.8 THEN 'Excellent - High quality answer' WHEN overall >= 0.6 THEN 'Good - Satisfactory answer' WHEN overall >= 0.4 THEN 'Fair - Some improvement needed' ELSE 'Poor - Significant issues' END AS said FROM o""")
def op_scores(spark, d):
    """All dimensions of each post as an answer; the overlap of key words stands in for the models' likenesses."""
    q, a = F.col("q"), F.col("a")
    x = turns(spark, d).withColumn("overlap", C.word_overlap(a, q))
    o = F.col("overlap")
    dims = {"relevance": C.relevance(10 * o - 5), "completeness": C.completeness(q, a), "accuracy": C.accuracy(o, o, o, o), "conciseness": C.conciseness(q, a)}
    x = x.withColumns(dims | {"consistency": C.consistency(a, F.array(q))})
    x = x.withColumn("overall", C.overall({k: F.col(k) for k in dims}))
    return x.select("conv_id", "turn", *(F.round(k, 6).alias(k) for k in (*dims, "consistency", "overall")), C.interpretation(F.col("overall")).alias("said"))


BARRED = "|".join(L.NOT_HEADINGS)
CAPS_SQL = rf"""(length(p) <= 100 AND NOT regexp_matches(upper(p), '{BARRED}') AND len(cw) BETWEEN 2 AND 15 AND len(list_filter(cw, lambda x: NOT (x = upper(x) AND regexp_matches(x, '\p{{Lu}}') AND length(x) >= 2))) = 0)"""


@query(rf"""WITH p AS (SELECT doc_id, i - 1 AS para_idx, trim(p) AS p FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, string_split({PLAIN}, chr(10)) AS ps FROM documents))),
 w AS (SELECT *, list_filter(regexp_split_to_array(trim(p), '\s+'), lambda x: x <> '') AS w, list_filter(regexp_split_to_array(trim(regexp_replace(p, '[^\p{{L}}\p{{N}}_\s]', '', 'g')), '\s+'), lambda x: x <> '') AS cw FROM p),
 l AS (SELECT *, list_filter(w, lambda x: length(x) > 2) AS lw, {CAPS_SQL} AS caps FROM w)
 SELECT doc_id, para_idx, caps, length(p) <= 150 AND len(w) BETWEEN 2 AND 20 AND len(lw) > 0 AND len(list_filter(lw, lambda x: regexp_matches(x, '^\p{{Lu}}'))) >= len(lw) * 0.7 AND NOT caps AND NOT contains(p, ':') AND NOT regexp_matches(p, '(,|and)$') AS title,
 regexp_matches(p, {_quoted("(?i)" + "|".join(L.SKIPPED))}) AS skipped FROM l""")
def fi_headings(spark, d):
    p = spread(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split(T.ascii_only(F.col("text")), "\n")).alias("para_idx", "p"))
    p = p.select("doc_id", F.col("para_idx").cast("long").alias("para_idx"), F.trim("p").alias("p"))
    return p.select("doc_id", "para_idx", *(f(F.col("p")).alias(n) for n, f in (("caps", L.caps_heading), ("title", L.title_heading), ("skipped", L.is_skipped))))


@query(rf"""WITH RECURSIVE s AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM documents WHERE length(text) > 1000)),
 r AS (SELECT *, length(s) > 1000 AS long, sum(CASE WHEN length(s) > 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
 g AS (SELECT doc_id, run, min(i) AS pos, list(s ORDER BY i) AS ss, list(length(s) + 1 ORDER BY i) AS ls FROM r WHERE NOT long GROUP BY ALL),
 p AS (SELECT *, len(ss) AS n, list_transform(range(0, len(ls) + 1), lambda k: coalesce(list_sum(ls[1:k]), 0)) AS upto FROM g),
 c AS (SELECT doc_id, run, 0::BIGINT AS lo, greatest(1, len(list_filter(upto, lambda u: u <= 1001)) - 1)::BIGINT AS hi FROM p UNION ALL
  SELECT doc_id, run, f, greatest(hi + 1, len(list_filter(upto, lambda u: u <= upto[f + 1] + 1001)) - 1)::BIGINT FROM (SELECT c.doc_id, c.run, c.hi, upto, greatest(c.lo, len(list_filter(upto, lambda u: u < upto[c.hi + 1] - 151)))::BIGINT AS f FROM c JOIN p USING (doc_id, run) WHERE c.hi < n)),
 o AS (SELECT doc_id, 0 AS pos, 0 AS k, text AS chunk FROM documents WHERE length(text) <= 1000 UNION ALL SELECT doc_id, pos, hi, array_to_string(ss[lo + 1:hi], ' ') FROM c JOIN p USING (doc_id, run)
  UNION ALL SELECT doc_id, i, k, w FROM (SELECT doc_id, i, k, substring(s, (k + 1)::INT, 1000) AS w FROM (SELECT doc_id, i, s, unnest(range(0, length(s), 850)) AS k FROM r WHERE long)) WHERE regexp_matches(w, '\S'))
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, k) - 1 AS chunk_index, length(chunk) AS n_chars, md5(chunk) AS digest FROM o""")
def co_chunks(spark, d):
    """Overlapping chunks of all documents."""
    c = chunk.overlapping(read(spark, d, "documents"), "doc_id")
    return c.select("doc_id", "chunk_index", F.length("chunk").cast("long").alias("n_chars"), F.md5("chunk").alias("digest"))


@query()
def co_sections(spark, d):
    """Section chunks of all documents, lines taken as paragraphs."""
    docs = read(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("paragraphs"))
    return chunk.sections(docs, "doc_id").select("doc_id", "chunk_index", "section", "subsection", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query()
def co_merge(spark, d):
    """Chunks of each document merged with those of a noisy copy of it (every third chunk in capitals, l read as 1)."""
    c = chunk.overlapping(read(spark, d, "documents"), "doc_id").select(F.col("doc_id").alias("book"), F.col("chunk_index").alias("idx"), F.col("chunk").alias("text"), F.lit("main").alias("section"))
    noisy = c.withColumn("text", F.when(F.col("idx") % 3 == 0, F.upper("text")).otherwise(F.replace("text", F.lit("l"), F.lit("1"))))
    return merge.merge(c, noisy).select("book", "idx", "method", "variant", "alternative", F.round("similarity", 6).alias("similarity"), "quality", F.round("confidence", 6).alias("confidence"))


POSTS = ("conv_id", "turn", "role", "text")


def thread_rows(spark, d):
    """Conversations as threads: the first post's first sentence is the title, authors are roles."""
    c = read(spark, d, "conversations")
    null = F.lit(None).cast("string")
    post = F.struct(F.col("turn").cast("string").alias("post_id"), F.col("role").alias("author"), null.alias("date"), T.ascii_only(F.col("text")).alias("content"), F.col("turn").cast("int").alias("position"), F.lit("en").alias("language"))
    g = c.groupBy(F.col("conv_id").alias("thread_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", post.alias("p")))).alias("ps"))  # a thread is a row
    g = g.select("thread_id", F.transform("ps", lambda x: x["p"]).alias("posts"))
    return g.select("thread_id", F.concat(F.lit("https://forum.example.com/thread/"), F.col("thread_id").cast("string")).alias("url"), F.get(T.sentences(F.get("posts", F.lit(0))["content"]), F.lit(0)).alias("title"), F.lit("en").alias("language"), "posts")


def _gone(t: str, *patterns: str) -> str:
    """SQL: t without what the patterns match, one after the other."""
    for p in patterns:
        t = f"regexp_replace({t}, {_quoted(p)}, '', 'g')"
    return t


BAG = lambda t: rf"list_distinct(list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(lower({t}), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g')), '\s+'), lambda w: w <> ''))"
ALIKE = lambda x, y: f"CASE WHEN len({BAG(x)}) = 0 OR len({BAG(y)}) = 0 THEN 0 ELSE len(list_intersect({BAG(x)}, {BAG(y)})) / len(list_distinct(list_concat({BAG(x)}, {BAG(y)}))) END"
CLEANED_SQL = rf"""SELECT *, CASE WHEN length(c4) <= {A.LONGEST} THEN c4 WHEN length(kept) >= {A.SHORTEST} THEN kept ELSE c4[1:{A.LONGEST - 3}] || '...' END AS t FROM (SELECT *, array_to_string(ss[1:coalesce(list_max(list_filter(range(1, len(ss) + 1), lambda i: length(array_to_string(ss[1:i], ' ')) <= {A.LONGEST})), 0)], ' ') AS kept
 FROM (SELECT *, regexp_split_to_array(regexp_replace(c4, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM (SELECT *, upper(f[1]) || f[2:] AS c4 FROM (SELECT *, trim(regexp_replace({_gone("c3", *("(?i)" + p for p in A.PREFIXES + A.SUFFIXES))}, '\s+', ' ', 'g')) AS f
 FROM (SELECT *, CASE WHEN q = '' THEN c2 ELSE trim({_gone("CASE WHEN starts THEN trim(CASE WHEN led > 0.5 THEN plain[length(first) + 1:] ELSE plain END) ELSE plain END", A.INLINE)}) END AS c3 FROM (SELECT *, {ALIKE("first", "q")} AS led FROM (SELECT *, {ALIKE("q", "c2[1:length(q) + 100]")} > 0.6 AS starts,
 coalesce(nullif(regexp_extract(plain, '(?s)^.*?[.!?]\s+', 0), ''), plain) AS first FROM (SELECT *, {_gone("c2", A.NAMED_QUOTE)} AS plain FROM (SELECT *, trim(regexp_replace({_gone("c1", *A.MENTIONS)}, '\s{{2,}}', ' ', 'g')) AS c2
 FROM (SELECT *, CASE WHEN len(regexp_extract_all(post, '@\w+')) >= 2 AND length(trim(regexp_extract(post, '(?s).*@\w+(.*)$', 1))) >= 50 THEN trim(regexp_extract(post, '(?s).*@\w+(.*)$', 1)) ELSE post END AS c1 FROM (SELECT *, trim(a) AS post FROM ({{source}}))))))))))))"""
POINT = lambda p, k: f"CASE WHEN regexp_matches(t, {_quoted(p)}) THEN {k} ELSE 0 END"


def points_sql(asker: str = "FALSE") -> str:
    """SQL: how useful a cleaned text t of a post is."""
    length = "CASE WHEN length(t) > 600 THEN -2 WHEN length(t) > 400 THEN 1 WHEN length(t) > 200 THEN 3 WHEN length(t) >= 50 THEN 4 ELSE 0 END"
    doubt = "CASE len(regexp_extract_all(t, '\\?')) WHEN 0 THEN 0 WHEN 1 THEN -2 WHEN 2 THEN -3 ELSE -5 END"
    marks = " + ".join((POINT(A.USEFUL, 3), POINT(r"\b[0-9]+\b", 1), POINT(A.DEFINITIVE, 2), POINT(A.SPECULATIVE, -3), POINT("(?i)^(I think|Maybe|Perhaps)", -1)))
    base = "CASE WHEN q <> '' THEN 2 ELSE 0 END"
    return f"""CASE WHEN length(post) < {A.TOO_SHORT} OR regexp_matches(post, {_quoted(A.ACKNOWLEDGED)}) THEN 0 WHEN length(t) < {A.TOO_SHORT} THEN {base} ELSE greatest(0, {base} + {length} + {marks} + {doubt} + CASE WHEN {asker} THEN -2 ELSE 0 END) END"""


TEXT_SQL = f"CASE WHEN length(post) < {A.TOO_SHORT} OR regexp_matches(post, {_quoted(A.ACKNOWLEDGED)}) THEN post ELSE t END"


def _listed(values) -> str:
    return "(" + ", ".join(map(_quoted, values)) + ")"


def _clean_question(x: str) -> str:
    plain = rf"trim(regexp_replace({_gone(x, *('(?i)' + g for g in Q.GREETINGS))}, '\s+', ' ', 'g'))"
    return f"(upper(({plain})[1]) || ({plain})[2:])"


def _asks(x: str) -> str:
    return rf"lower(regexp_extract({x}, '^\s*(\S+)', 1)) IN {_listed(Q.ASKING)}"


def _marked(x: str) -> str:
    inner = " OR ".join(f"contains(lower(trim({x})), {_quoted(w)})" for w in Q.INNER)
    return f"CASE WHEN NOT suffix(trim({x}), '?') AND ({_asks(x)} OR {inner}) THEN trim({x}) || '?' ELSE trim({x}) END"


def _core(x: str) -> str:
    sentence = rf"list_filter(regexp_split_to_array(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: contains(s, '?') AND length(s) < {Q.LONGEST})[1]"
    clause = f"list_filter(list_transform(string_split({x}, ','), lambda s: trim(s)), lambda s: {_asks('s')} AND length(s) < {Q.LONGEST})[1]"
    head = f"({x})[1:{Q.LONGEST}]"
    cut = f"CASE WHEN length(regexp_extract({head}, '(?s)^(.*) ', 1)) > 50 THEN regexp_extract({head}, '(?s)^(.*) ', 1) ELSE {head} END"
    return f"coalesce({sentence}, {_marked(clause)}, CASE WHEN length({x}) > {Q.LONGEST} THEN {_marked(cut)} ELSE {x} END)"


THREAD_SQL = rf"""SELECT conv_id, arg_min(role, turn) AS asker, arg_min(t, turn) AS content FROM (SELECT conv_id, turn, role, {PLAIN} AS t FROM conversations) GROUP BY 1 HAVING count(*) >= 2"""
ASKED_SQL = rf"""SELECT conv_id, asker, content, CASE WHEN contains(t, '?') AND n < {Q.LONGEST} THEN t WHEN n > {Q.LONGEST} AND length(core_t) > 10 THEN core_t WHEN c <> '' AND contains(t, ':') THEN CASE WHEN length(topic) < 30 AND length(q) < 100 THEN topic || ': ' || q ELSE q END
 WHEN complete AND n > 10 THEN {_marked("t")} WHEN NOT complete AND c <> '' AND n > 10 AND starts_with(lower(c[1:100]), lower(t[1:20])) THEN {_marked("q")} WHEN NOT complete AND c <> '' AND length(part) > 10 THEN CASE WHEN length(joined) > {Q.LONGEST} THEN core_j ELSE joined END
 WHEN c <> '' THEN {_marked("q")} WHEN t <> '' THEN {_marked("t")} END AS question
 FROM (SELECT *, {_core("joined")} AS core_j FROM (SELECT *, {_marked("t || ': ' || part")} AS joined, {_core("t")} AS core_t, length(t) AS n, trim(string_split(t, ':')[1]) AS topic, contains(t, '?') OR length(t) > 80 OR (length(t) > 40 AND c = '') AS complete
 FROM (SELECT *, coalesce(list_filter(parts, lambda s: (contains(s, '?') OR {_asks("s")}) AND length(s) > 10)[1], parts[1]) AS part, coalesce(list_filter(list_transform(qs, lambda p: {_clean_question("CASE WHEN p = '' OR suffix(p, '?') THEN p ELSE p || '?' END")}), lambda s: (contains(s, '?') OR {_asks("s")}) AND length(s) > 15)[1], c) AS q
 FROM (SELECT *, list_transform(regexp_split_to_array(c, '[.!?]+'), lambda s: {_clean_question("s")}) AS parts, list_transform(string_split(regexp_replace(c, '\?\s*([A-Z])', chr(1) || '\1', 'g'), chr(1)), lambda p: trim(p)) AS qs, {_clean_question("trim(title)")} AS t
 FROM (SELECT *, trim(content) AS c, regexp_split_to_array(regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1] AS title FROM ({THREAD_SQL}))))))"""
REPLY_SQL = f"""SELECT c.conv_id, turn, role = asker AS own, t.content, question AS q, {PLAIN.replace("text", "c.text")} AS a FROM conversations c JOIN ({ASKED_SQL}) t ON t.conv_id = c.conv_id WHERE question <> '' AND turn > (SELECT min(turn) FROM conversations f WHERE f.conv_id = c.conv_id)"""
PAIR_SQL = f"""SELECT conv_id, 'forum_' || conv_id AS id, any_value(q) AS question, any_value(content) AS content, arg_min(txt, (-score, turn)) AS answer, max(score)::INT AS score, count(*) AS useful FROM (SELECT *, {points_sql("own")} AS score, {TEXT_SQL} AS txt FROM ({CLEANED_SQL.replace("{source}", REPLY_SQL)})) WHERE score > 0 GROUP BY 1"""


@query(rf"""SELECT p.id, question, answer, least(3, useful) AS kept, score, concat_ws(',', CASE WHEN question = '' THEN 'empty question' END, CASE WHEN answer = '' THEN 'empty answer' END) AS errors,
 concat_ws(',', CASE WHEN length(question) < 10 THEN 'question too short' END, CASE WHEN length(answer) < 10 THEN 'answer too short' END, CASE WHEN score < 2 THEN 'low score' END, CASE WHEN NOT contains(question, '?') AND content <> '' AND NOT contains(content, '?') THEN 'no question mark' END) AS issues,
 CASE WHEN first <> p.id THEN first END AS duplicate_of FROM (SELECT *, min(id) OVER (PARTITION BY regexp_replace(trim(regexp_replace(lower(question), '\s+', ' ', 'g')), '[^\p{{L}}\p{{N}}_\s]', '', 'g')) AS first FROM ({PAIR_SQL})) p""")
def co_thread_pairs(spark, d):
    """Question and answer pairs of all threads, with their checks."""
    p = threads.checked(threads.pairs(thread_rows(spark, d)), "example.com")
    return p.select("id", "question", "answer", F.size("raw_answers").cast("long").alias("kept"), F.col("raw_answers")[0]["score"].alias("score"), F.array_join("errors", ",").alias("errors"), F.array_join("issues", ",").alias("issues"), "duplicate_of")


@query(rf"""SELECT count(*) AS pairs, avg(score) AS mean_score, count(*) FILTER (useful > 1) AS several, avg(length(answer)) AS mean_length, sum(len(regexp_extract_all(answer, '@\w+')))::BIGINT AS mentions, count(*) FILTER (length(answer) > 500) AS long FROM ({PAIR_SQL})""")
def co_thread_summary(spark, d):
    return threads.summary(threads.pairs(thread_rows(spark, d)))


@query(f"SELECT conv_id, turn, ({points_sql()})::INT AS score, {TEXT_SQL} AS cleaned FROM ({CLEANED_SQL.replace('{source}', TURNS_SQL)})")
def sf_answers(spark, d):
    """Usefulness and cleaned text of each post."""
    u = A.usefulness(F.col("a"), F.col("q"), F.lit(False))
    return turns(spark, d).select("conv_id", "turn", u.alias("u")).select("conv_id", "turn", F.col("u.score").alias("score"), F.col("u.text").alias("cleaned"))


@query()
def sc_posts(spark, d):
    return html.posts(read(spark, d, "pages"))


def corrections_of(spark, d):
    """Words of all conversations with a made-up correction: pairs to learn from."""
    w = read(spark, d, "conversations").select(F.explode(T.tokens(T.ascii_only(F.col("text")))).alias("original"))
    first = F.concat(F.lit("z"), F.substring("original", 2, 2**31 - 1))
    return w.withColumn("corrected", F.when(F.length("original") % 3 == 0, first).when(F.length("original") % 3 == 1, F.translate("original", "ae", "eo")).otherwise(F.concat("original", F.lit("x"))))


LEARN_SQL = rf"""WITH w AS (SELECT unnest(regexp_extract_all(lower({PLAIN}), '[\p{{L}}\p{{N}}]+')) AS o FROM conversations),
 p AS (SELECT o, CASE WHEN length(o) % 3 = 0 THEN 'z' || o[2:] WHEN length(o) % 3 = 1 THEN translate(o, 'ae', 'eo') ELSE o || 'x' END AS c FROM w), q AS (SELECT * FROM p WHERE o <> c)"""


@query(f"""{LEARN_SQL}, x AS (SELECT o, c, unnest(range(1, length(o) + 1)) AS i FROM q WHERE length(o) = length(c))
 SELECT o[i] AS original, c[i] AS corrected, count(*) AS n FROM x WHERE o[i] <> c[i] GROUP BY 1, 2 HAVING count(*) >= 3""")
def ag_learned_characters(spark, d):
    return learning.characters(corrections_of(spark, d))


@query(f"""{LEARN_SQL}, s AS (SELECT o, c FROM q WHERE length(o) > 3 AND length(c) > 3 AND o[2:] = c[2:] GROUP BY 1, 2 HAVING count(*) >= 2)
 SELECT o[1] AS prefix, c[1] AS prefix_replacement, count(*) AS examples FROM s GROUP BY 1, 2 HAVING count(*) >= 2""")
def ag_learned_starts(spark, d):
    return learning.starts(corrections_of(spark, d))


@query(f"""{LEARN_SQL} SELECT * FROM (SELECT o AS original, c AS corrected, count(*) AS n FROM q WHERE length(o) > 3 AND length(c) > 3 AND o[2:] <> c[2:] GROUP BY 1, 2 ORDER BY n DESC, o, c LIMIT 20) WHERE n >= 3""")
def ag_learned_words(spark, d):
    """The 20 most frequent replacements of words (a top-k report)."""
    return learning.whole_words(corrections_of(spark, d))


@query()
def op_spelling(spark, d):
    """Corrections of all words of conversations; every word that stands twice or more is known."""
    w = read(spark, d, "conversations").select(F.explode(spelling.pieces(F.col("text"))).alias("word"))
    return spelling.corrections_from(w, spelling.known_words(w))


@query(rf"""WITH s AS (SELECT unnest(regexp_split_to_array(regexp_replace({PLAIN}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM documents), w AS (SELECT regexp_extract_all(s, '[A-Za-z0-9_]+') AS ws FROM s),
 x AS (SELECT unnest(ws[2:]) AS w FROM w WHERE len(ws) > 1) SELECT lower(w) AS key, min(w) AS term, count(*) AS n FROM x WHERE regexp_matches(w, '^([A-Z]{{2,}}|[A-Z][a-zA-Z0-9]{{2,}})$') AND lower(w) NOT IN {_listed(STOP)} GROUP BY 1""")
def ag_terms(spark, d):
    """Capitalised words inside sentences that are no stop words, one spelling of each."""
    s = spread(read(spark, d, "documents").select("text")).select(F.explode(T.sentences(T.ascii_only(F.col("text")))).alias("s"))
    w = s.select(F.posexplode(F.regexp_extract_all("s", F.lit("[A-Za-z0-9_]+"), F.lit(0))).alias("pos", "w")).where("pos > 0 and w rlike '^([A-Z]{2,}|[A-Z][a-zA-Z0-9]{2,})$'").where(~F.lower("w").isin(*STOP))
    return w.groupBy(F.lower("w").alias("key")).agg(F.min("w").alias("term"), F.count("*").alias("n"))


@query("""SELECT 'rulebook_0_' || doc_id AS _id, doc_id AS idx, 50.0::DOUBLE AS quality_score, 'unknown' AS extraction_method, len(embedding)::BIGINT AS dims FROM documents JOIN embeddings ON vec_id = doc_id WHERE text <> '' AND len(embedding) = 64""")
def sk_index(spark, d):
    """Documents of the index with their vectors, defaults filled; rejected rows left out."""
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    c = read(spark, d, "documents").select("doc_id", "text").join(v, "doc_id").withColumn("source_type", F.lit(None).cast("string")).withColumnRenamed("doc_id", "idx")
    good, _ = sinks.index_documents(c, 64)
    return good.select("_id", "idx", F.col("quality_score").cast("double").alias("quality_score"), "extraction_method", F.size("embedding").cast("long").alias("dims"))


@query("""WITH r AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS run, avg(CASE WHEN value >= 0.8 THEN 1.0 ELSE 0.0 END) AS rate, avg(value) AS mean FROM events GROUP BY 1)
 SELECT run::VARCHAR AS run, round(rate, 6) AS rate, round(rate - lag(rate) OVER (ORDER BY run), 6) AS change, round(mean - lag(mean) OVER (ORDER BY run), 6) AS mean_change FROM r""")
def ev_runs(spark, d):
    """Pass rates and means by run (a day) with their changes; the window runs over one row a run."""
    e = read(spark, d, "events").groupBy(F.to_date("ts").alias("run")).agg(F.avg(F.when(F.col("value") >= 0.8, 1.0).otherwise(0.0)).alias("rate"), F.avg("value").alias("mean"))
    w = Window.orderBy("run")
    change = lambda c: F.round(F.col(c) - F.lag(c).over(w), 6)
    return e.select(F.col("run").cast("string").alias("run"), F.round("rate", 6).alias("rate"), change("rate").alias("change"), change("mean").alias("mean_change"))


@query("""WITH p AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'view') AS b FROM events GROUP BY 1)
 SELECT CASE WHEN b > a THEN 'better' WHEN b < a THEN 'worse' ELSE 'same' END AS kind, count(*) AS n, round(avg(b - a), 6) AS mean FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1""")
def ev_changes(spark, d):
    """Two runs compared item by item: better, worse and same."""
    kind = lambda k: F.avg(F.when(F.col("event_type") == k, F.col("value")))
    p = read(spark, d, "events").groupBy("user_id").agg(kind("click").alias("a"), kind("view").alias("b")).where("a is not null and b is not null")
    how = F.when(F.col("b") > F.col("a"), "better").when(F.col("b") < F.col("a"), "worse").otherwise("same")
    return p.groupBy(how.alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("b") - F.col("a")), 6).alias("mean"))
