"""Search queries: keyword, vector, hybrid, boosts, sweeps of the weight and the choice of source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as C
from ..functions import text as T
from ..operators import answer
from ..operators import retrieve as R
from ..operators.common import few
from .registry import TOKENS_SQL, query, read

K, HEAD, WEIGHT = 25, 10, 0.85


def _first(scores: str, k: int, rank: str = "rank") -> str:
    """SQL: the k best rows of each question."""
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS {rank} FROM ({scores})) WHERE {rank} <= {k}"


# docs (doc_id, text) and asked (qid, text) are defined before it; kw holds qid, doc_id, score (to 6 places)
KEYWORD_SQL = rf"""ts AS (SELECT doc_id, {TOKENS_SQL} AS ts FROM docs), st AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)) AS mean FROM ts),
 qa AS (SELECT qid, unnest(t) AS token, generate_subscripts(t, 1) AS qp FROM (SELECT qid, {TOKENS_SQL} AS t FROM asked)), q AS (SELECT qid, token, count(*) AS times FROM qa GROUP BY ALL),
 qs AS (SELECT qid, count(*) AS asked, sum(times) AS places FROM q GROUP BY 1), e AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS token, generate_subscripts(ts, 1) AS dp FROM ts),
 p AS (SELECT doc_id, dl, token, count(*) AS tf FROM e WHERE token IN (SELECT token FROM q) GROUP BY ALL), f AS (SELECT token, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, st GROUP BY token, n),
 s AS (SELECT qid, doc_id, dl, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS m, count(*) AS found, sum(idf * times) AS weight FROM p JOIN f USING (token) JOIN q USING (token), st GROUP BY ALL),
 held AS (SELECT * FROM s JOIN qs USING (qid) WHERE found = asked),
 ev AS (SELECT h.qid, h.doc_id, places, qp, dp - qp AS a FROM held h JOIN qa ON qa.qid = h.qid JOIN e ON e.doc_id = h.doc_id AND e.token = qa.token),
 ru AS (SELECT qid, doc_id, places, a - off AS s, count(DISTINCT qp) FILTER (off = 0) AS n0, count(DISTINCT qp) FILTER (off <= 1) AS n1, count(DISTINCT qp) AS n2, count(DISTINCT qp) FILTER (off = 1) AS l1, count(DISTINCT qp) FILTER (off >= 1) AS l2
  FROM ev, (SELECT unnest([0, 1, 2]) AS off) GROUP BY ALL),
 ph AS (SELECT qid, doc_id, sum(CASE WHEN n0 = places THEN 1.0 WHEN n1 = places THEN CASE WHEN l1 < places THEN 1.0 / 2 ELSE 0 END WHEN n2 = places AND l2 < places THEN 1.0 / 3 ELSE 0 END)::DOUBLE AS freq FROM ru GROUP BY ALL),
 kw AS (SELECT qid, doc_id, round(1.8 * m + CASE WHEN freq > 0 THEN 2.0 * weight * freq * 2.2 / (freq + 1.2 * (0.25 + 0.75 * dl / mean)) ELSE 0 END, 6) AS score FROM held LEFT JOIN ph USING (qid, doc_id), st)"""


@query(f"""WITH docs AS (SELECT doc_id, text FROM documents), asked AS (SELECT item_id AS qid, text FROM benchmark), {KEYWORD_SQL} SELECT qid AS item_id, doc_id, score, rank FROM ({_first("SELECT * FROM kw", K)})""")
def co_keyword_search(spark, d):
    """The 25 best documents that hold every token of each item (a top-k report)."""
    hits = R.keyword_search(read(spark, d, "documents"), read(spark, d, "benchmark"), "doc_id", "item_id", k=K)
    hits = R.top(hits.withColumn("score", F.round("score", 6)), "item_id", "doc_id", K)
    return hits.select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


NEAR_SQL = """SELECT qid, vec_id AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], q) + 1, 6) AS score
 FROM embeddings, (SELECT vec_id AS qid, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0) WHERE vec_id <> qid"""


def nearest(spark, d, k: int = K, among: DataFrame | None = None) -> DataFrame:
    """The k nearest of the vectors (of those whose id is among's doc_id) to each stated query: qid, doc_id, score, rank."""
    vectors = read(spark, d, "embeddings").select("vec_id", "embedding")
    queries = vectors.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    if among is not None:
        vectors = vectors.join(among.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return R.vector_search(vectors, queries, k).withColumnRenamed("vec_id", "doc_id")


@query(f"SELECT qid, doc_id AS vec_id, score, rank FROM ({_first(NEAR_SQL, K)})")
def co_vector_search(spark, d):
    """The 25 nearest of all vectors to each stated query (ids divisible by 100)."""
    return nearest(spark, d).select("qid", F.col("doc_id").alias("vec_id"), "score", F.col("rank").cast("long").alias("rank"))


# Documents as chunks of three sources, made up by their ids; a question is the first four tokens of a stated query's document.
DOCS_SQL = """docs AS (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN 'faq' WHEN doc_id % 5 < 3 THEN 'forum' ELSE 'rulebook' END AS source_type, CASE WHEN doc_id % 5 = 0 THEN 45 WHEN doc_id % 5 < 3 THEN 30 ELSE 50 END AS priority FROM documents),
 """
ASKED_SQL = f"""asked AS (SELECT doc_id AS qid, array_to_string({TOKENS_SQL}[1:4], ' ') AS text FROM documents WHERE doc_id % 100 = 0 AND doc_id IN (SELECT vec_id FROM embeddings)), """


def chunks(spark, d) -> DataFrame:
    kind = F.when(F.col("doc_id") % 5 == 0, "faq").when(F.col("doc_id") % 5 < 3, "forum").otherwise("rulebook")
    priority = F.when(kind == "faq", 45).when(kind == "forum", 30).otherwise(50)
    return read(spark, d, "documents").select("doc_id", "text", kind.alias("source_type"), priority.alias("priority"))


def asked(spark, d) -> DataFrame:
    stated = read(spark, d, "embeddings").where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("doc_id"))
    docs = read(spark, d, "documents").join(stated, "doc_id", "left_semi")
    return docs.select(F.col("doc_id").alias("qid"), F.array_join(F.slice(T.tokens(F.col("text")), 1, 4), " ").alias("text"))


def norm_sql(hits: str, name: str) -> str:
    return f"""SELECT qid, doc_id, CASE WHEN min(score) OVER w >= 0.9 AND max(score) OVER w <= 2.1 THEN greatest(0, least(1, score - 1))
 WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS {name} FROM ({hits}) WINDOW w AS (PARTITION BY qid)"""


def pools_sql(k: int, barred: str) -> str:
    """SQL: all hits of both sides with v_norm and k_norm (table both_sides), without sources in barred."""
    keep = f"WHERE doc_id IN (SELECT doc_id FROM docs WHERE source_type NOT IN ({barred}))"
    v, w = (_first(f"SELECT * FROM ({hits}) {keep}", max(5 * k, 25)) for hits in (NEAR_SQL, "SELECT * FROM kw"))
    return f"both_sides AS (SELECT qid, doc_id, round(coalesce(v_norm, 0), 6) AS v_norm, round(coalesce(k_norm, 0), 6) AS k_norm FROM ({norm_sql(v, 'v_norm')}) FULL JOIN ({norm_sql(w, 'k_norm')}) USING (qid, doc_id))"


def both_sides(spark, d, k: int = K, **sources) -> DataFrame:
    """qid, doc_id, v_norm and k_norm (to 6 places) of the pools of a hybrid search for k hits, from allowed sources."""
    docs = chunks(spark, d)
    there = R.allowed(docs, **sources).select("doc_id")
    words = R.keyword_search(docs, asked(spark, d), "doc_id", "qid", k=R.pool(k), among=R.permitted(**sources)).select("qid", "doc_id", F.round("score", 6).alias("score"))
    merged = R.hybrid(nearest(spark, d, R.pool(k), there), R.top(words, "qid", "doc_id", R.pool(k)), "qid", "doc_id")
    return merged.select("qid", "doc_id", *(F.round(c, 6).alias(c) for c in ("v_norm", "k_norm")))


def hybrid_hits(spark, d, k: int = K, **sources) -> DataFrame:
    """The k best of each question with score (to 9 places, as products of those to 6 have 8) and rank."""
    score = F.round(WEIGHT * F.col("v_norm") + (1 - WEIGHT) * F.col("k_norm"), 9)
    return R.top(both_sides(spark, d, k, **sources).withColumn("score", score), "qid", "doc_id", k)


def hybrid_sql(k: int, barred: str) -> str:
    """SQL that defines docs, asked and hits (qid, doc_id, v_norm, k_norm, score, rank)."""
    scored = f"SELECT *, round({WEIGHT} * v_norm + {round(1 - WEIGHT, 9)} * k_norm, 9) AS score FROM both_sides"
    return f"{DOCS_SQL}{ASKED_SQL}{KEYWORD_SQL}, {pools_sql(k, barred)}, hits AS ({_first(scored, k)})"


@query(f"WITH {hybrid_sql(K, repr('faq'))} SELECT * FROM hits")
def co_hybrid(spark, d):
    """The 25 best of vector and keyword hits of each question, of pools of 125, official answers left out (a top-k report)."""
    return hybrid_hits(spark, d).select("qid", "doc_id", "v_norm", "k_norm", "score", F.col("rank").cast("long").alias("rank"))


PLAIN = r"regexp_replace({}, '[^\x00-\x7F]', ' ', 'g')"
KEY_SQL = lambda t: rf"list_distinct(regexp_extract_all(lower({t}), '\b[a-z]{{4,}}\b'))"
OVERLAP_SQL = lambda truth, text: f"CASE WHEN len({KEY_SQL(truth)}) > 0 THEN len(list_intersect({KEY_SQL(truth)}, {KEY_SQL(text)})) / len({KEY_SQL(truth)}) ELSE 0.5 END"
def search_sql(keywords: str) -> str:
    """SQL that ranks hits anew (table ranked); keywords: how many key words of the question a body holds."""
    return f"""x AS (SELECT h.*, priority, d.text AS t, {PLAIN.format("d.text")} AS body, {PLAIN.format("a.text")} AS question FROM hits h JOIN docs d USING (doc_id) JOIN asked a USING (qid)),
 y AS (SELECT *, round(CASE WHEN rank <= {HEAD} THEN {OVERLAP_SQL("question", "body")} ELSE score END, 6) AS pair, {keywords} AS keyword_matches FROM x),
 z AS (SELECT qid, doc_id, t, pair, keyword_matches, round(score * (1 + 0.2 * keyword_matches) * priority / 50.0, 9) AS score FROM y),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pair DESC, doc_id) AS rank FROM z)"""


KEYWORDS_SQL = f"len(list_filter({KEY_SQL('question')}, lambda k: contains(lower(body), k)))"


def boosted(spark, d, hits: DataFrame, keywords: bool = True) -> DataFrame:
    """hits reranked by a stand-in pair model (shared key words), boosted by key words and priority, and ranked anew; with text.

    hits are cached (few for each question; spark.catalog.clearCache() drops them), so that texts stay where they are read.
    """
    hits = hits.persist()
    docs = chunks(spark, d).select("doc_id", F.col("text").alias("t"), "priority").join(few(hits), "doc_id")
    questions = asked(spark, d).select("qid", T.ascii_only(F.col("text")).alias("question"))
    x = docs.join(few(questions, hits.count()), "qid").withColumn("body", T.ascii_only(F.col("t")))
    x = R.reranked(x, C.word_overlap(F.col("body"), F.col("question")), HEAD).withColumn("pair", F.round("pair", 6))
    x = R.keyword_boosted(x, T.key_words(F.col("question")) if keywords else F.array().cast("array<string>"), F.col("body"))
    return R.final_ranks(R.priority_boosted(x).withColumn("score", F.round("score", 9)), "qid", "doc_id")


@query(f"WITH {hybrid_sql(K, repr('faq'))}, {search_sql(KEYWORDS_SQL)} SELECT qid, doc_id, score, pair, keyword_matches, rank FROM ranked")
def co_search(spark, d):
    """Hybrid search as a whole: pools, merge, reranked head, boosts of key words and of sources."""
    out = boosted(spark, d, hybrid_hits(spark, d))
    return out.select("qid", "doc_id", "score", "pair", F.col("keyword_matches").cast("long").alias("keyword_matches"), F.col("rank").cast("long").alias("rank"))


SWEEP = (0.0, 0.25, 0.5, 0.75, 1.0)
EACH_SQL = f"""WITH {hybrid_sql(K, repr("faq"))}, best AS (SELECT qid, weight::DOUBLE AS weight, round(max(weight * v_norm + (1 - weight) * k_norm), 9) AS best FROM both_sides, (SELECT unnest([{", ".join(map(str, SWEEP))}]) AS weight) GROUP BY ALL)"""


def best_by_weight(spark, d) -> DataFrame:
    """qid, weight and best: each question's best hybrid score for each of five weights, one plan."""
    each = both_sides(spark, d).select("qid", "v_norm", "k_norm", F.explode(F.array(*map(F.lit, SWEEP))).alias("weight"))
    return each.groupBy("qid", "weight").agg(F.round(F.max(F.col("weight") * F.col("v_norm") + (1 - F.col("weight")) * F.col("k_norm")), 9).alias("best"))


@query(f"""{EACH_SQL} SELECT weight, round(avg(best), 6) AS mean, round(min(best), 9) AS least, round(max(best), 9) AS most, count(*) FILTER (best >= 0.8) AS passed, round(stddev_samp(best), 6) AS spread FROM best GROUP BY 1""")
def co_weight_sweep(spark, d):
    b = F.col("best")
    return best_by_weight(spark, d).groupBy("weight").agg(F.round(F.avg(b), 6).alias("mean"), F.round(F.min(b), 9).alias("least"), F.round(F.max(b), 9).alias("most"), F.count_if(b >= 0.8).alias("passed"), F.round(F.stddev_samp(b), 6).alias("spread"))


@query(f"""{EACH_SQL} SELECT qid, {", ".join(f"round(max(best) FILTER (weight = {w}), 9) AS w{int(100 * w)}" for w in SWEEP)}, round(var_samp(best), 6) AS variance, round(max(best) - min(best), 9) AS range, max(best) - min(best) > 0.1 AS wide FROM best GROUP BY 1""")
def ag_weight_runs(spark, d):
    """Runs of all weights side by side for each question, with their variance and range."""
    b = F.col("best")
    each = [F.round(F.max(F.when(F.col("weight") == w, b)), 9).alias(f"w{int(100 * w)}") for w in SWEEP]
    return best_by_weight(spark, d).groupBy("qid").agg(*each, F.round(F.var_samp(b), 6).alias("variance"), F.round(F.max(b) - F.min(b), 9).alias("range"), (F.max(b) - F.min(b) > 0.1).alias("wide"))


@query(f"""{EACH_SQL}, m AS (SELECT weight, avg(best) AS mean FROM best GROUP BY 1), t AS (SELECT arg_max(weight, (round(mean, 9), -weight)) AS best_weight, max(mean) AS best_mean, max(mean) FILTER (weight = 0.75) AS usual,
 avg(mean) FILTER (weight >= 0.75) AS high, avg(mean) FILTER (weight <= 0.5) AS low FROM m)
 SELECT best_weight, round(best_mean, 6) AS best_mean, round(high, 6) AS high, round(low, 6) AS low, CASE WHEN best_weight = 0.75 OR (abs(best_weight - 0.75) <= 0.05 AND best_mean - usual < 0.01) THEN 'keep' ELSE 'change' END AS advice FROM t""")
def ag_weight_advice(spark, d):
    """The best weight, means of high and low ones, and whether to change the usual one (0.75)."""
    m = best_by_weight(spark, d).groupBy("weight").agg(F.avg("best").alias("mean"))
    w, mean = F.col("weight"), F.col("mean")
    t = m.agg(F.max_by("weight", F.struct(F.round("mean", 9), -w)).alias("best_weight"), F.max("mean").alias("best_mean"), F.max(F.when(w == 0.75, mean)).alias("usual"), F.avg(F.when(w >= 0.75, mean)).alias("high"), F.avg(F.when(w <= 0.5, mean)).alias("low"))
    keeps = (F.col("best_weight") == 0.75) | ((F.abs(F.col("best_weight") - 0.75) <= 0.05) & (F.col("best_mean") - F.col("usual") < 0.01))
    return t.select("best_weight", *(F.round(c, 6).alias(c) for c in ("best_mean", "high", "low")), F.when(keeps, "keep").otherwise("change").alias("advice"))


FORUM_SQL = _first(f"SELECT * FROM ({NEAR_SQL}) WHERE doc_id IN (SELECT doc_id FROM docs WHERE source_type = 'forum')", 5)
BARRED = "'faq', 'forum'"


@query(f"""WITH {hybrid_sql(5, BARRED)}, forum AS ({FORUM_SQL}), df AS (SELECT qid, score, doc_id FROM forum WHERE rank = 1), dr AS (SELECT qid, score FROM hits WHERE rank = 1),
 dc AS (SELECT qid, df.doc_id, dr.score IS NOT NULL AS ruled, df.score IS NOT NULL AS said, coalesce(CASE WHEN df.score > 1 THEN least(1, df.score - 1) ELSE df.score END, 0) AS fc, coalesce(CASE WHEN dr.score > 1 THEN least(1, dr.score - 1) ELSE dr.score END, 0) AS rc FROM asked LEFT JOIN df USING (qid) LEFT JOIN dr USING (qid)),
 ds AS (SELECT *, CASE WHEN NOT ruled AND NOT said THEN 'none' WHEN fc * 0.45 > rc * 0.55 THEN 'forum' WHEN ruled THEN 'rulebook' ELSE 'forum' END AS source FROM dc)
 SELECT qid, source, round(fc, 9) AS forum_confidence, round(rc, 9) AS rulebook_confidence, CASE WHEN source = 'rulebook' THEN coalesce(doc_id, -1) ELSE -1 END AS related FROM ds""")
def co_dual_source(spark, d):
    """Vector hits of the forum against hybrid hits of the rulebook: the source of the higher weighted confidence.

    related is the best forum question where the rulebook is chosen, else -1.
    """
    forum = nearest(spark, d, 5, R.allowed(chunks(spark, d), source_type="forum"))
    rules = hybrid_hits(spark, d, 5, exclude_forum=True)
    out = answer.arbitrated(asked(spark, d).select("qid"), forum, rules, "qid")
    best = forum.where("rank = 1").select("qid", F.col("doc_id").alias("related"))
    out = out.join(best, "qid", "left").withColumn("related", F.when(F.col("source") == "rulebook", F.coalesce("related", F.lit(-1).cast("long"))).otherwise(-1))
    return out.select("qid", "source", *(F.round(c, 9).alias(c) for c in ("forum_confidence", "rulebook_confidence")), "related")
