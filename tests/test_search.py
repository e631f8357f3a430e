"""Search, answers and text quality against plain Python."""

import itertools
import math
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscope.functions import quality as Q
from folioscope.functions import text as T
from folioscope.operators import answer
from folioscope.operators import retrieve as R
from folioscope.operators.common import numbered
from folioscope.operators.merge import token_set_likeness, token_set_ratio

DIR = os.environ.get("QUERY_DIR", "/root/testdata/sf0.01")


def plain_quality(t):
    if not t or len(t) < 20:
        return 0.0
    letters = [c for c in t if c.isascii() and (c.isalpha() or c == " ")]
    penalty = 5 * len(re.findall(r"([a-z])\1{4,}", t.lower())) + 5 * len(re.findall(r"\.{6,}", t))
    if len(letters) > 20:
        share = sum(c in "aeiouAEIOU " for c in letters) / len(letters)
        penalty += 20 if share < 0.25 else 10 if share < 0.3 else 15 if share > 0.55 else 0
    bonus = min(20, 2 * sum(3 <= len(s.split()) <= 50 for s in re.split(r"[.!?]+", t)))
    ws = t.split()
    if len(ws) >= 5:
        penalty += 3 * sum(len(w) > 3 and any(map(str.isupper, w[1:])) and any(map(str.islower, w)) for w in ws)
    return float(max(0, min(100, 100 - penalty + bonus - (10 if len(t) < 100 else 0))))


def plain_corrupt(t):
    if len(t) < 20:
        return False
    low, letters = t.lower(), re.sub("[^a-zA-Z ]", "", t)
    if re.search(r"([a-z])\1{7,}", low) or re.search(r"\.{8,}", t) or len(re.findall(r"([a-z])\1{4,}", low)) >= 3:
        return True
    return len(letters) > 20 and len(re.sub("[^aeiouAEIOU ]", "", letters)) / len(letters) < 0.15


HARD = [None, "", "short", "HEllo ABCd thIS is mixed Up text for the count of words", "x" * 30, "bcdfg hjklm npqrs tvwxz bcdfg hjklm", "aeiou aeiou aeiou aeiou", "a......b......c enough text to be over twenty", "aaaaaa bbbbbb cccccc dddddd words go on and on", "AbcD eFgh IJKL mnop qrSt uvwx", "Éa éA ÀBc dÉf text of accents that is long enough", "1234567890 1234567890 12345"]


def test_quality_of_every_document(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("text").union(spark.createDataFrame([(t,) for t in HARD], "text string"))
    for r in docs.select("text", Q.text_quality(F.col("text")).alias("q"), Q.is_corrupt(F.coalesce("text", F.lit(""))).alias("c")).collect():
        assert r.q == plain_quality(r.text), r.text
        assert r.c == plain_corrupt(r.text or ""), r.text


def tokens(t):
    return re.findall(r"[^\W_]+", t.lower())


def test_keyword_search(spark):
    docs = ["the red fox runs", "a red big fox runs the hill", "fox red", "runs the red fox and the red fox runs", "red red red fox", "nothing here", "", "fox runs red the", "the quick red fox never runs"]
    asked = ["the red fox runs", "red fox", "fox", "absent red", "red red fox", ""]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    q = spark.createDataFrame(list(enumerate(asked)), "qid long, text string")
    bags = [Counter(tokens(t)) for t in docs]
    n, mean = len(docs), sum(map(len, map(tokens, docs))) / len(docs)
    idf = {w: math.log(1 + (n - k + 0.5) / (k + 0.5)) for w, k in Counter(w for b in bags for w in b).items()}
    fits = lambda f, b: f * 2.2 / (f + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean))

    def phrase(ws, ts):
        """Shortest runs of shifted places that hold all words, by trying all runs."""
        places = [[p - k for p, t in enumerate(ts) if t == w] for k, w in enumerate(ws)]
        whole = lambda s, e: all(any(s <= p <= e for p in ps) for ps in places)
        ends = sorted({p for ps in places for p in ps})
        return sum(1 / (1 + e - s) for s, e in itertools.product(ends, ends) if 0 <= e - s <= 2 and whole(s, e) and not whole(s + 1, e) and not whole(s, e - 1))

    want = {}
    for i, question in enumerate(asked):
        ws = tokens(question)
        for j, b in enumerate(bags):
            if ws and all(w in b for w in ws):
                m, f = sum(idf[w] * fits(b[w], b) for w in set(ws)), phrase(ws, tokens(docs[j]))
                want[i, j] = (m, f, 1.8 * m + (2 * sum(idf[w] for w in ws) * fits(f, b) if f else 0))
    got = {(r.qid, r.doc_id): (r.match, r.phrases, r.score) for r in R.keyword_search(d, q, "doc_id", "qid").collect()}
    assert got.keys() == want.keys() and len(got) > 15
    assert all(math.isclose(a, b, rel_tol=1e-9) for k in got for a, b in zip(got[k], want[k], strict=True))
    some = {(r.qid, r.doc_id): r.score for r in R.keyword_search(d, q, "doc_id", "qid", every=False).collect()}
    assert set(some) == {(i, j) for i, t in enumerate(asked) for j, b in enumerate(bags) if any(w in b for w in tokens(t))}
    assert math.isclose(some[3, 2], idf["red"] * fits(1, bags[2]))
    assert R.keyword_search(d.where("false"), q, "doc_id", "qid").count() == 0 and R.keyword_search(d, q.where("false"), "doc_id", "qid").count() == 0


def test_filters_and_boosts(spark):
    rows = [(1, "a", "faq", 60), (2, "b", "forum", 30), (3, "a", "rulebook", None), (4, None, None, 50)]
    c = spark.createDataFrame(rows, "doc_id long, section string, source_type string, priority int")
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(R.allowed(c)) == [2, 3, 4] and ids(R.allowed(c, exclude_forum=True)) == [3, 4] and ids(R.allowed(c, include_faq=True)) == [1, 2, 3, 4]
    assert ids(R.allowed(c, section="a", include_faq=True)) == [1, 3] and ids(R.allowed(c, source_type="forum", exclude_forum=True)) == [2]
    hits = c.select(F.lit(1).alias("qid"), "doc_id", "priority", F.lit(1.0).alias("score"), F.lit("Red foxes").alias("text"))
    x = R.keyword_boosted(hits, F.array(F.lit("red"), F.lit("fox"), F.lit("hen")), F.col("text")).first()
    assert x.keyword_matches == 2 and math.isclose(x.score, 1.4)
    assert [r.score for r in R.priority_boosted(hits).orderBy("doc_id").collect()] == [1.2, 0.6, 1.0, 1.0]
    e = lambda a, b: R.entity_boosted(hits, F.array(*map(F.lit, a)), F.array(*map(F.lit, b))).first().score
    assert e(["X:a", "X:b"], ["X:a"]) == 1.0 and e(["X:a", "X:b"], ["X:a", "X:b"]) == 1.2 and e(["X:a", "Y:b", "Z:c"], ["X:a", "Y:b", "Z:c"]) == 1.2
    ranked = R.reranked(R.top(hits.withColumn("score", F.col("doc_id") / 10), "qid", "doc_id", 4), F.lit(9.0), head=2)
    assert [(r.doc_id, r.pair) for r in ranked.orderBy("rank").collect()] == [(4, 9.0), (3, 9.0), (2, 0.2), (1, 0.1)]
    assert [r.doc_id for r in R.final_ranks(ranked, "qid", "doc_id", by_pair=True).orderBy("rank").collect()] == [3, 4, 2, 1]


def test_hits_and_numbers(spark):
    df = spark.createDataFrame([(1, 7.0)], "doc_id int, score double")
    assert R.as_hits(df, F.lit(0.5)).first().asDict() == {"doc_id": 1, "forum_quality_score": 7.0, "score": 0.5}
    assert R.as_hits(df.drop("score"), F.lit(0.5)).columns == ["doc_id", "score"]
    rows = [(k * k, None if k % 3 == 0 else f"s{k % 2}") for k in range(-40, 200)]
    rows = list({r[0]: r for r in rows}.values())
    got = {r.i: r.n for r in numbered(spark.createDataFrame(rows, "i long, s string"), "s", "i", "n", rows=20).collect()}
    want = {}
    for key in {s for _, s in rows}:
        want |= {i: n for n, i in enumerate(sorted(i for i, s in rows if s == key), 1)}
    assert got == want
    assert numbered(spark.createDataFrame([], "i long, s string"), "s", "i", "n").count() == 0


def test_embedding_by_a_model(spark):
    df = spark.createDataFrame([("red fox",), ("red fox",), ("hen",), (None,)], "t string")
    a, b, c, none = (r.v for r in df.select(R.embedded(F.col("t")).alias("v")).collect())
    assert a == b != c and math.isclose(sum(x * x for x in a), 1, rel_tol=1e-5) and not any(none)
    own = df.select(R.embedded(F.col("t"), lambda: lambda ts: [[len(t), 1.0] for t in ts]).alias("v")).first().v
    assert math.isclose(own[0] / own[1], 7, rel_tol=1e-5)


def plain_answer(question, style, chunks, terms, like):
    s = answer.STYLES[style]
    found = []
    for i, c in enumerate(chunks[: s.chunks]):
        for x in re.split(r"(?<=[.!?])\s+", c or ""):
            x = x.strip()
            if len(x.split()) < s.words or style == "sentence" and x.isupper() and len(x) < 50:
                continue
            low = x.lower()
            score = like(x, question) + s.position / (i + 1) + s.markers[0] * sum(m in low for m in s.markers[1]) + s.terms * sum(t in low for t in terms)
            found.append((score + (s.digits if re.search(r"\d", x) else 0), i, x))
    if not chunks or style == "sentence" and not found:
        return answer.NOTHING
    found.sort(key=lambda x: -x[0])
    out, seen, used = [], set(), 0
    for _, _, x in found[: s.top]:
        plain = re.sub(r"\s+", " ", x.lower()).strip()
        if plain in seen or used + len(x) > s.budget:
            continue
        out.append(x)
        seen.add(plain)
        used += len(x) + 1
        if len(out) >= s.most or s.enough and len(out) >= 3 and used > s.enough:
            break
    text = " ".join(out)
    return (re.sub(r"\s+", " ", text).strip() if style == "sentence" else text) if out else chunks[0][: s.budget]


QUESTIONS = {1: "how do foxes move over hills", 2: "what is the red fox", 3: "how many hens are there", 4: "tell of the fox", 5: "how do we win", 6: "fox", 7: "name the y"}


def test_answers_by_style(spark):
    docs = [r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").where("lang = 'en' and length(text) > 300").orderBy("doc_id").limit(40).collect()]
    chunks = {1: docs[:12], 2: docs[12:20], 3: docs[20:26], 4: [*docs[26:36], "", "RED FOX RUNS AWAY. The red fox runs away. the  red fox runs away."], 6: ["One two.", "RUN FOX RUN NOW."], 7: ["y" * 900 + " a b c d."]}
    key = lambda t: set(re.findall(r"\b[a-z]{4,}\b", t.lower()))
    jaccard = lambda a, b: len(key(a) & key(b)) / len(key(a) | key(b)) if key(a) and key(b) else 0.0
    ascii_ = lambda t: re.sub(r"[^\x00-\x7f]", " ", t)
    styles = {1: "procedural", 2: "definitional", 3: "quantitative", 5: "procedural"}
    q = spark.createDataFrame([(k, t) for k, t in QUESTIONS.items()], "qid int, question string").withColumn("k", T.key_words(F.col("question")))
    c = spark.createDataFrame([(k, i, ascii_(t)) for k, ts in chunks.items() for i, t in enumerate(ts)], "qid int, chunk_idx int, text string")
    out = answer.answered(q, c, "qid", lambda s, t: T.jaccard(T.key_words(t), T.key_words(s)), verbs=F.col("k"), concepts=F.col("k"), keywords=F.col("k"))
    got = {r.qid: r for r in out.collect()}
    for k, t in QUESTIONS.items():
        style = styles.get(k, "sentence")
        terms = [] if style == "quantitative" else list(key(t))
        assert (got[k].style, got[k].answer) == (style, plain_answer(t, style, list(map(ascii_, chunks.get(k, []))), terms, jaccard)), k
    assert got[5].answer == got[6].answer == answer.NOTHING and got[7].answer == "y" * 600 and got[1].n_sentences == 5


@pytest.mark.parametrize("a, b", [("the red fox", "fox red the"), ("", "x"), ("a b c", "a b d e"), ("one two", "three four")])
def test_token_set_likeness(spark, a, b):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(token_set_likeness(F.col("a"), F.col("b")).alias("x")).first().x == token_set_ratio(a, b)


def test_batch_rows(spark):
    from folioscope.plans.registry import QUERIES

    rows = QUERIES["co_batch"](spark, DIR).collect()
    ranks = {r.qid: r.best_chunk_rank for r in QUERIES["co_best_chunk"](spark, DIR).collect()}
    assert {r.qid for r in rows} == set(ranks) and len(rows) == 5
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    from folioscope.plans import batch

    _, ranked = batch.answered(spark, DIR)
    by = {}
    for r in ranked.collect():
        by.setdefault(r.qid, []).append((r["rank"], r.t))
        assert texts[r.doc_id] == r.t
    truth = {r.qid: r.ground_truth for r in rows}
    for qid, found in ranks.items():
        fits = [k for k, t in sorted(by.get(qid, [])) if token_set_ratio(t, truth[qid]) >= 70]
        assert found == (fits[0] if fits else None)
