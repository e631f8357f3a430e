"""Questions answered in one plan: corrected, searched in three sources, answered from the better one and scored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import analysis as N
from ..functions import scores as C
from ..functions.text import clamped, jaccard, key_words
from . import answer
from . import retrieve as R
from .spelling import Lexicon, question_corrections


def ask(
    questions: DataFrame, chunks: DataFrame, vectors: DataFrame, *, lexicon: Lexicon | None = None, include_faq: bool = False, k: int = 25, weight: float = 0.85, forum_weight: float = 0.45, likeness: Callable[[Column, Column], Column] | None = None
) -> DataFrame:
    """A row for each question: the corrected question, source, answer, chunks used, confidences and scores to two places.

    questions holds qid, question and q (its vector); chunks holds doc_id, text, answer,
    source_type and priority; vectors holds vec_id (a doc_id) and embedding. likeness of
    two texts stands for the models (a pair model or embeddings by an Arrow UDF); by default the share of key words.
    """
    like = likeness or (lambda a, b: jaccard(key_words(a), key_words(b)))
    q = question_corrections(questions, lexicon) if lexicon is not None else questions.withColumn("corrections", F.array().cast("array<struct<original:string,correction:string>>"))
    asked = q.select("qid", F.col("question").alias("text"))

    def near(n: int, **source) -> DataFrame:
        held = vectors.join(R.allowed(chunks, **source).select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
        return R.vector_search(held, q.select("qid", "q"), n).withColumnRenamed("vec_id", "doc_id")

    words = R.keyword_search(chunks, asked, "doc_id", "qid").select("qid", "doc_id", "score")

    def both(n: int, **source) -> DataFrame:
        there = R.top(words.join(R.allowed(chunks, **source).select("doc_id"), "doc_id", "left_semi"), "qid", "doc_id", R.pool(n))
        return R.top(R.hybrid(near(R.pool(n), **source), there, "qid", "doc_id", weight), "qid", "doc_id", n)

    forum, rules = near(k, source_type="forum"), both(k, exclude_forum=True, include_faq=include_faq)
    chosen = answer.arbitrated(q, forum, rules, "qid", forum_weight)
    hits = chosen.select("qid", "source").join(forum.select("qid", "doc_id", "score", F.lit("forum").alias("source")).unionByName(rules.select("qid", "doc_id", "score", F.lit("rulebook").alias("source"))), ["qid", "source"])
    hits = R.top(R.priority_boosted(hits.join(chunks.select("doc_id", "text", "answer", "priority"), "doc_id")), "qid", "doc_id", k)
    t = F.col("question")
    read = q.select("qid", "question", N.verbs(t).alias("vs"), N.nouns(t).alias("ns")).withColumn("cs", N.concepts(t, F.transform(N.plain_words(t), N.lemma))).withColumn("ks", N.keywords(t, F.col("ns")))
    ruled = answer.answered(read, hits.where("source = 'rulebook'").select("qid", "text", (F.col("rank") - 1).alias("chunk_idx")), "qid", like, verbs=F.col("vs"), concepts=F.col("cs"), keywords=F.col("ks"))
    said = hits.where("source = 'forum' and rank = 1").select("qid", F.col("answer").alias("said"))
    found = hits.groupBy("qid").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))), 1, 5), lambda x: F.struct(x["doc_id"].alias("doc_id"), F.bround(x["score"], 2).alias("score"))).alias("chunks"))
    out = q.select("qid", "question", "corrections").join(chosen, "qid").join(ruled.select("qid", "answer", "used"), "qid", "left").join(said, "qid", "left").join(found, "qid", "left")
    text = F.when(F.col("source") == "forum", F.coalesce("said", F.lit("No answer found."))).otherwise(F.coalesce("answer", F.lit(answer.NOTHING)))
    best = lambda hits, name: hits.where("rank = 1").select("qid", F.col("score").alias(name))
    for name, part in (("faq", both(5, source_type="faq")), ("rulebook", both(5, source_type="rulebook"))):
        out = out.join(best(part, name), "qid", "left").withColumn(name, clamped(F.coalesce(name, F.lit(0.0))))
    out = out.withColumn("answer", text).withColumn("like", like(F.col("answer"), F.col("question")))
    dims = {"relevance": C.relevance(10 * F.col("like") - 5), "completeness": C.completeness(F.col("question"), F.col("answer")), "accuracy": F.col("like"), "conciseness": C.conciseness(F.col("question"), F.col("answer"))}
    out = out.withColumns(dims).withColumn("overall", C.overall({d: F.col(d) for d in dims}))
    two = lambda c: F.bround(c, 2).alias(c)
    return out.select("qid", "question", "corrections", "source", "answer", F.coalesce("used", F.array().cast("array<int>")).alias("used"), "chunks", two("forum_confidence"), two("rulebook_confidence"), two("faq"), two("rulebook"), *(two(d) for d in (*dims, "overall")))
