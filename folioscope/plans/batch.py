"""Batch evaluation: every question searched, answered and scored in one plan, and the summary of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import questions as Q
from ..functions import scores as C
from ..functions import text as T
from ..operators import answer
from ..operators.merge import token_set_likeness
from .qa import COMPLETE_SQL, KEY, NUM, TYPE_SQL
from .registry import query, read
from .search import BARRED, K, OVERLAP_SQL, PLAIN, asked, boosted, hybrid_hits, hybrid_sql, search_sql

NONE = "No chunks found"


def answers_sql(ranked: str, most: int = 15, budget: int = 800) -> str:
    """SQL for extractive answers (table answers: qid, answer) from rows qid, rank and t: whole texts, then sentences of the first that doesn't fit."""
    return rf"""ac AS (SELECT qid, rank, t, length(t) AS n, coalesce(sum(length(t) + 1) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM ({ranked}) WHERE rank <= {most} AND t <> ''),
 ao AS (SELECT qid, min(rank) AS stop FROM ac WHERE used + n > {budget} GROUP BY 1),
 asn AS (SELECT qid, rank, used, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM (SELECT qid, rank, used, regexp_split_to_array(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM ac JOIN ao USING (qid) WHERE rank = stop AND {budget} - used > 50)),
 au AS (SELECT *, used + length(s) + coalesce(sum(length(s) + 1) OVER (PARTITION BY qid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM asn),
 ap AS (SELECT qid, rank, 0 AS i, t AS part FROM ac LEFT JOIN ao USING (qid) WHERE stop IS NULL OR rank < stop UNION ALL SELECT qid, rank, i, s FROM au WHERE i < coalesce((SELECT min(b.i) FROM au b WHERE b.qid = au.qid AND b.upto > {budget}), 1e9)),
 ag AS (SELECT qid, trim(regexp_replace(string_agg(part, ' ' ORDER BY rank, i), '\s+', ' ', 'g')) AS answer FROM ap GROUP BY 1),
 answers AS (SELECT qid, coalesce(answer, 'No relevant information found.') AS answer FROM (SELECT DISTINCT qid FROM ({ranked})) LEFT JOIN ag USING (qid))"""


TRUTH_SQL = rf"regexp_split_to_array(regexp_replace({PLAIN.format('text')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1]"
SHARED = lambda x, y: f"CASE WHEN len({KEY(x)}) = 0 OR len({KEY(y)}) = 0 THEN 0 ELSE len(list_intersect({KEY(x)}, {KEY(y)})) / len(list_distinct(list_concat({KEY(x)}, {KEY(y)}))) END"
BATCH_SQL = f"""WITH {hybrid_sql(K, BARRED)}, {search_sql("0")}, {answers_sql("SELECT qid, rank, t FROM ranked")},
 bt AS (SELECT qid, doc_id, score FROM ranked WHERE rank = 1),
 bg AS (SELECT d.doc_id AS qid, {PLAIN.format("a.text")} AS q, {TRUTH_SQL.replace("text", "d.text")} AS truth, {PLAIN.format("answer")} AS a, t.doc_id AS chunk, score FROM asked a JOIN documents d ON d.doc_id = a.qid LEFT JOIN answers USING (qid) LEFT JOIN bt t USING (qid)),
 bk AS (SELECT *, {TYPE_SQL("q")} AS type, list_filter({KEY("q")}, lambda w: NOT list_contains([{", ".join("'" + w + "'" for w in C.COMMON)}], w)) AS wanted, {KEY("a")} AS had, length(a) AS n, {OVERLAP_SQL("q", "a")} AS o1, {OVERLAP_SQL("truth", "a")} AS o2, {SHARED("a", "truth")} AS j FROM bg),
 bl AS (SELECT *, {NUM(0)} AS lo, {NUM(1)} AS hi, 1 / (1 + exp(-(10 * o1 - 5) / 3)) AS relevance, 1 / (1 + exp(-(10 * o2 - 5) / 3)) AS pair FROM bk),
 bs AS (SELECT *, least(1.0, 0.5 + {COMPLETE_SQL} + CASE WHEN len(wanted) > 0 THEN len(list_intersect(wanted, had)) / len(wanted) * 0.3 ELSE 0 END) AS completeness,
 CASE WHEN n < lo THEN n / lo WHEN n > hi THEN greatest(0, 1 - (n - hi) / (hi * 2)) ELSE 1 END AS conciseness,
 greatest(CASE WHEN j > 0.7 THEN 0.6 * j + 0.25 * pair + 0.1 * o2 + 0.05 * j ELSE 0.45 * j + 0.25 * pair + 0.2 * o2 + 0.1 * j END, CASE WHEN j > 0.8 THEN 0.9 WHEN j > 0.7 THEN 0.85 WHEN j > 0.6 THEN 0.75 ELSE 0 END) AS accuracy FROM bl),
 batch AS (SELECT qid, q AS question, truth AS ground_truth, coalesce(a, '{NONE}') AS predicted, CASE WHEN a IS NULL THEN 0 ELSE round(relevance * 0.3 + completeness * 0.25 + accuracy * 0.4 + conciseness * 0.05, 6) END AS overall_score,
 CASE WHEN a IS NOT NULL THEN round(relevance, 6) END AS relevance_score, CASE WHEN a IS NOT NULL THEN round(completeness, 6) END AS completeness_score, CASE WHEN a IS NOT NULL THEN round(accuracy, 6) END AS accuracy_score,
 CASE WHEN a IS NOT NULL THEN round(conciseness, 6) END AS conciseness_score, CASE WHEN a IS NULL THEN 'none' ELSE type END AS question_type, chunk, 'rulebook' AS answer_source, 0.0::DOUBLE AS forum_confidence, coalesce(score, 0)::DOUBLE AS rulebook_confidence FROM bs)"""


def answered(spark, d) -> tuple[DataFrame, DataFrame]:
    """Questions (qid, question, truth) and their ranked chunks (qid, doc_id, score, rank, t)."""
    stated = read(spark, d, "documents").where(F.col("doc_id") % 100 == 0)  # only these are asked
    truth = stated.select(F.col("doc_id").alias("qid"), F.get(T.sentences(T.ascii_only(F.col("text"))), F.lit(0)).alias("truth"))
    questions = asked(spark, d).select("qid", T.ascii_only(F.col("text")).alias("question")).join(truth, "qid")
    ranked = boosted(spark, d, hybrid_hits(spark, d, source_type="rulebook"), keywords=False)
    return questions, ranked.select("qid", "doc_id", "score", "rank", "t")


def scored(rows: DataFrame) -> DataFrame:
    """rows (question, truth, answer) with the four dimensions and the whole; overlaps of key words stand in for models."""
    q, a, t = F.col("question"), F.col("answer"), F.col("truth")
    rows = rows.withColumns({"o1": C.word_overlap(a, q), "o2": C.word_overlap(a, t), "j": T.jaccard(T.key_words(a), T.key_words(t))})
    dims = {"relevance": C.relevance(10 * F.col("o1") - 5), "completeness": C.completeness(q, a), "accuracy": C.accuracy(F.col("j"), C.relevance(10 * F.col("o2") - 5), F.col("o2"), F.col("j")), "conciseness": C.conciseness(q, a)}
    return rows.withColumns(dims).withColumn("overall", C.overall({k: F.col(k) for k in dims})).drop("o1", "o2", "j")


def evaluated(spark, d) -> DataFrame:
    """A row for each question, also where nothing was found."""
    questions, ranked = answered(spark, d)
    listed = ranked.groupBy("qid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"]).alias("texts"), F.min_by("doc_id", "rank").alias("chunk"), F.min_by("score", "rank").alias("best")
    )
    x = questions.join(listed, "qid", "left").withColumn("answer", F.when(F.col("texts").isNotNull(), T.ascii_only(answer.extractive(F.col("texts")))))
    x = scored(x)
    there = F.col("answer").isNotNull()
    dims = ("relevance", "completeness", "accuracy", "conciseness")
    return x.select(
        "qid", "question", F.col("truth").alias("ground_truth"), F.coalesce("answer", F.lit(NONE)).alias("predicted"), F.when(there, F.round("overall", 6)).otherwise(0.0).alias("overall_score"), *(F.when(there, F.round(c, 6)).alias(f"{c}_score") for c in dims),
        F.when(there, Q.question_type(F.col("question"))).otherwise("none").alias("question_type"), "chunk", F.lit("rulebook").alias("answer_source"), F.lit(0.0).alias("forum_confidence"), F.coalesce("best", F.lit(0.0)).alias("rulebook_confidence"),
    )


@query(f"{BATCH_SQL} SELECT * FROM batch")
def co_batch(spark, d):
    """All questions searched, answered and scored: one row each."""
    return evaluated(spark, d)


@query(f"""{BATCH_SQL} SELECT answer_source, question_type, count(*) AS questions, round(avg(overall_score), 6) AS mean_overall, round(avg(relevance_score), 6) AS mean_relevance, round(avg(completeness_score), 6) AS mean_completeness,
 round(avg(accuracy_score), 6) AS mean_accuracy, round(avg(conciseness_score), 6) AS mean_conciseness, count(*) FILTER (overall_score >= 0.8) AS passed FROM batch GROUP BY ALL""")
def ag_batch(spark, d):
    """Means, passes and sources of a batch."""
    means = [F.round(F.avg(f"{c}_score"), 6).alias(f"mean_{c}") for c in ("overall", "relevance", "completeness", "accuracy", "conciseness")]
    return evaluated(spark, d).groupBy("answer_source", "question_type").agg(F.count("*").alias("questions"), *means, F.count_if(F.col("overall_score") >= 0.8).alias("passed"))


@query(f"""{BATCH_SQL} SELECT least(9, floor(overall_score * 10))::BIGINT AS bin, count(*) AS n, round(avg(length(predicted)), 6) AS mean_length, round(avg(length(ground_truth)), 6) AS truth_length, count(*) FILTER (overall_score < 0.7) AS mismatched FROM batch GROUP BY 1""")
def ev_scores(spark, d):
    """A run's scores in tenths, with lengths of answers and truths."""
    s = F.col("overall_score")
    return evaluated(spark, d).groupBy(F.least(F.lit(9).cast("long"), F.floor(s * 10)).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(F.length("predicted")), 6).alias("mean_length"), F.round(F.avg(F.length("ground_truth")), 6).alias("truth_length"), F.count_if(s < 0.7).alias("mismatched"))


@query()
def co_best_chunk(spark, d):
    """The first rank whose chunk holds the ground truth (token set ratio of 70 and more), else null."""
    questions, ranked = answered(spark, d)
    alike = ranked.join(questions.select("qid", "truth"), "qid").withColumn("ratio", token_set_likeness(F.col("t"), F.col("truth")))
    first = alike.where("ratio >= 70").groupBy("qid").agg(F.min("rank").alias("best_chunk_rank"))
    return questions.select("qid").join(first, "qid", "left")


@query(f"""WITH {hybrid_sql(K, BARRED)}, {search_sql("0")}, {answers_sql("SELECT qid, rank, t FROM ranked")} SELECT qid, answer FROM answers""")
def co_extractive(spark, d):
    """An extractive answer to each question from its 15 best chunks (a top-k report)."""
    _, ranked = answered(spark, d)
    listed = ranked.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"]).alias("texts"))
    return listed.select("qid", answer.extractive(F.col("texts")).alias("answer"))


@query()
def co_answers(spark, d):
    """An answer to each question in the style of its intent (its key words as verbs and concepts), with the extractive one where nothing fits."""
    questions, ranked = answered(spark, d)
    c = ranked.select("qid", F.col("t").alias("text"), (F.col("rank") - 1).alias("chunk_idx"), "score")
    q = questions.select("qid", "question", T.key_words(F.col("question")).alias("keywords"))
    overlap = lambda sentence, question: T.jaccard(T.key_words(question), T.key_words(T.ascii_only(sentence)))
    return answer.answered(q, c, "qid", overlap, verbs=F.col("keywords"), concepts=F.col("keywords"), keywords=F.col("keywords"))


