"""Searches that keep the best of a block, against all hits and against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import ranking
from folioscope.operators import retrieve as R


def made(spark, n=400):
    rng = random.Random(5)
    words = "a b c d e f g h".split()
    texts = [" ".join(rng.choices(words, weights=range(1, 9), k=rng.randint(1, 40))) for _ in range(n)]
    texts = texts[:-60] + ["g h f h"] * 60  # copies tie
    docs = spark.createDataFrame([(3 * i, t) for i, t in enumerate(texts)] + [(-1, None), (-2, "")], "doc_id long, text string").repartition(3)
    asked = ["g h", "h g f h", "e", "a b c d", "g g h", "z a", None, "h"]
    return docs, spark.createDataFrame(list(enumerate(asked)), "qid int, text string")


@pytest.mark.parametrize("every", [True, False])
def test_keyword_hits_of_k(spark, monkeypatch, every):
    """At most k hits of a question leave a block, and their best are the best of all hits, ties and sources included."""
    docs, asked = made(spark)
    best = lambda df: sorted(map(tuple, R.top(df.withColumn("score", F.round("score", 6)), "qid", "doc_id", 7).collect()))
    every_hit = R.keyword_search(docs, asked, "doc_id", "qid", every=every)
    want = best(every_hit)
    monkeypatch.setattr(ranking, "PLACES", 700)  # several blocks of a task
    monkeypatch.setattr(ranking, "ROWS", 10)
    few = R.keyword_search(docs, asked, "doc_id", "qid", every=every, k=7)
    assert best(few) == want and len({r[0] for r in want}) == 6 + (not every)
    assert best(R.keyword_search(docs, asked, "doc_id", "qid", every=every)) == want
    monkeypatch.undo()
    one = R.keyword_search(docs.coalesce(1), asked, "doc_id", "qid", every=every, k=7)
    per_block = [r["count"] for r in R.keyword_search(docs, asked, "doc_id", "qid", every=every, k=7).groupBy("qid", F.spark_partition_id()).count().collect()]
    assert max(per_block) <= 7 < every_hit.where("qid = 2").count() and best(one) == want
    some = R.keyword_search(docs, asked, "doc_id", "qid", every=every, k=7, among=F.col("doc_id") % 2 == 0)
    assert best(some) == best(every_hit.where("doc_id % 2 = 0"))


def test_questions_in_parts(spark, monkeypatch):
    docs, asked = made(spark, 150)
    rows = lambda df: sorted((r.qid, r.doc_id, round(r.score, 9)) for r in df.collect())
    want = rows(R.keyword_search(docs, asked, "doc_id", "qid"))
    monkeypatch.setattr(R, "SENT_ROWS", 6)
    assert rows(R.keyword_search(docs, asked, "doc_id", "qid")) == want and want


def test_vector_hits(spark, monkeypatch):
    """Against plain Python: copies, a zero vector, other lengths, nulls, several blocks and parts of the queries."""
    rng = random.Random(6)
    vs = [[rng.uniform(-1, 1) for _ in range(5)] for _ in range(120)]
    vs[50:90] = [vs[0]] * 40
    odd = [(900, None), (901, [1.0, 2.0]), (902, [1.0, None, 0.0, 0.0, 1.0]), (None, vs[3])]
    rows = list(enumerate(vs)) + odd
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    q = v.where("vec_id % 10 = 0 and vec_id < 200").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    want = set()
    for i in range(0, 120, 10):
        hits = sorted((-round(cos(vs[i], vs[j]) + 1, 6), j) for j in range(120) if j != i)
        want |= {(i, j, -s, k + 1) for k, (s, j) in enumerate(hits[:9])}
    for vectors, queries, sent in ((32_768, 64, 1_000_000), (20, 4, 300)):
        monkeypatch.setattr(ranking, "VECTORS", vectors)
        monkeypatch.setattr(ranking, "QUERIES", queries)
        monkeypatch.setattr(R, "SENT_ROWS", sent)
        assert {(r.qid, r.vec_id, r.score, r["rank"]) for r in R.vector_search(v, q, 9).collect()} == want
    zero = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = R.vector_search(zero, zero.where("vec_id = 1").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), 5).collect()
    assert len(got) == 2 and any(r.vec_id == 2 and r.score == 1 for r in got)
    assert R.vector_search(zero.where("false"), q, 5).count() == 0 and R.vector_search(v, q.where("false"), 5).count() == 0


def test_rounding_as_spark(spark):
    x = [0.0000005, 1.0000005, 2.5000015, 0.1234565, 1.9999995, 0.3, 12.3456785, 1.00000049999999]
    want = [r.r for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6).alias("r")).collect()]
    assert ranking.rounded(np.array(x), 6).tolist() == want
