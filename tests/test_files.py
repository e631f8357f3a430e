"""Readers, sinks, reports, parsing, merging of sources and asking on small tables."""

import json
import math
import os
import time

from pyspark.sql import functions as F

from folioscope.functions import layout as L
from folioscope.functions import questions as Q
from folioscope.functions import scores as C
from folioscope.functions import text as T
from folioscope.operators import learning, merge, parse, reports, retrieve, spelling, threads
from folioscope.operators.ask import ask
from folioscope.sources import readers, sinks


def one(spark, f, *row):
    names = "abc"[: len(row)]
    return spark.createDataFrame([tuple(row)], ", ".join(f"{n} string" for n in names)).select(f(*(F.col(n) for n in names)).alias("x")).first().x


def test_readers(spark, tmp_path):
    for k, rows in enumerate(([{"question": "a", "answer": "b"}, {"question": "c", "answer": "d"}], [{"question": "e", "answer": "f"}])):
        (tmp_path / f"faq{k}.json").write_text(json.dumps(rows))
    assert [r["faq_id"] for r in readers.faq(spark, str(tmp_path / "faq*.json")).orderBy("text").collect()] == ["faq_1", "faq_2", "faq_3"]
    (tmp_path / "q.csv").write_text("question,ground_truth\nx,nan\ny,1\nz,2\n")
    assert [tuple(r) for r in readers.questions(spark, str(tmp_path / "q.csv"), 2).collect()] == [("x", None), ("y", "1")]
    (tmp_path / "terms.csv").write_text("# c\n Bolt\n")
    assert {r.term for r in readers.terms(spark, str(tmp_path / "terms.csv"), comments=False, stripped=False).collect()} == {"# c", " bolt"}
    assert readers.pairs(spark, str(tmp_path / "none.json")).count() == 0 and readers.pairs(spark, str(tmp_path / "none.json")).columns[0] == "id"
    (tmp_path / "broken.json").write_text("{x")
    assert readers.pairs(spark, str(tmp_path / "broken.json")).count() == 0
    assert readers.config(spark, str(tmp_path / "broken.json")) == readers.config(spark, str(tmp_path / "no.json")) == {"character_map": {}, "word_patterns": []}
    (tmp_path / "a.bin").write_bytes(b"one\x0ctwo")
    (tmp_path / "b.bin").write_bytes(b"\xff")
    pages = readers.pages(spark, str(tmp_path / "*.bin"), lambda b: b.decode().split("\x0c"))
    assert [(os.path.basename(r.file), r.page, r.text) for r in pages.orderBy("page").collect()] == [("a.bin", 1, "one"), ("a.bin", 2, "two")]
    urls = spark.createDataFrame([("u",), ("v",)], "url string")
    got = readers.cached_pages(urls, spark.createDataFrame([("u", "<p>")], "url string, html string"), "url", F.concat(F.lit("got "), F.col("url")))
    assert {r.url: r.html for r in got.collect()} == {"u": "<p>", "v": "got v"}


def test_sinks(spark, tmp_path):
    p = lambda name: str(tmp_path / name)
    chunks = spark.createDataFrame([("a", "faq"), ("b", None)], "text string, source_type string")
    written = sinks.write_chunks(chunks, p("chunks"), p("old"))
    assert len(written) == 4 and all(os.path.exists(w) for w in written) and spark.read.json(written[1]).count() == 2
    df, n = readers.unified(spark, written[0])
    assert df.count() == 2 and {tuple(r) for r in n.collect()} == {("faq", 1), ("rulebook", 1)}
    sinks.write_headers(spark.createDataFrame([("B",), ("A",), ("B",), (None,)], "header string"), p("headers"))
    assert [r.value for r in spark.read.text(p("headers")).collect()] == ["A", "B"]
    archive = sinks.write_results(spark.createDataFrame([("q", 1.0)], "question string, score double"), p("res"), p("archive"), time.time() - 5)
    assert archive.endswith("5s.csv") and spark.read.csv(archive, header=True).count() == 1
    kept = sinks.write_rejects(spark.createDataFrame([("x", None), ("y", "short")], "text string, skip_reason string"), p("rejects"))
    assert [tuple(r) for r in kept.collect()] == [("x",)] and spark.read.json(p("rejects")).first().skip_reason == "short"
    index = sinks.with_fields(chunks, {"priority": "int", "text": "int"})
    assert index.dtypes[-1] == ("priority", "int") and [r.source_type for r in sinks.filled(index, "source_type", "rulebook").orderBy("text").collect()] == ["faq", "rulebook"]
    assert sinks.backup(spark, p("nothing")) is None
    first = sinks.update_config(spark, p("config"), {"0": "o"}, [{"pattern": "a", "replacement": "b"}])
    again = sinks.update_config(spark, p("config"), {"0": "x", "1": "l"}, [{"pattern": "a", "replacement": "c"}, {"pattern": "d", "replacement": "e"}])
    assert first["character_map"] == {"0": "o"} and again["character_map"] == {"0": "o", "1": "l"} and [w["replacement"] for w in again["word_patterns"]] == ["b", "e"]
    assert readers.config(spark, p("config")) == again and len([f for f in os.listdir(tmp_path) if f.startswith("config.")]) == 1
    t = spark.createDataFrame([("1", "en", [(1,), (2,)])], "thread_id string, language string, posts array<struct<n:int>>")
    sinks.write_threads(t, p("threads"))
    assert spark.read.json(p("threads_manifest")).first().posts == 2
    sinks.write_pairs(chunks, chunks.agg(F.count("*").alias("n")), p("pairs"), p("pairs_old"))
    assert spark.read.json(p("pairs_summary")).first().n == 2 and spark.read.json(p("pairs")).count() == 2


def test_index_fields(spark):
    rows = [(0, "a", [1.0], None, 3, None, None, None), (1, "b", [1.0], "forum", 3, "q1", None, "said"), (2, "c", [1.0], "faq", None, None, None, None)]
    c = spark.createDataFrame(rows, "idx int, text string, embedding array<double>, source_type string, page int, qa_id string, section string, answer string")
    got = {r.idx: r.asDict() for r in sinks.index_documents(c, 1)[0].collect()}
    assert [got[k]["_id"] for k in range(3)] == ["rulebook_3_0", "forum_q1", "faq_2"]
    assert (got[0]["page"], got[0]["section"], got[0]["chunk_index"], got[0]["semantic_variant"], got[0]["answer"]) == (3, "", 0, False, None)
    assert (got[1]["page"], got[1]["section"], got[1]["answer"], got[1]["thread_id"], got[1]["faq_id"]) == (None, None, "said", "", None)
    assert (got[2]["faq_id"], got[2]["section"], got[2]["answer"], got[2]["url"], got[2]["priority"]) == ("faq_2", "", "", None, 50)
    old, new = (spark.createDataFrame(x, "pattern string, replacement string") for x in ([("a", "b")], [("a", "c"), ("d", "e")]))
    assert sorted(map(tuple, learning.merged(old, new, "pattern").collect())) == [("a", "b"), ("d", "e")]


def pair(k, question, answer, score, n=1, url="https://x.com/thread/1", language="en"):
    return (f"f{k}", "forum", "t", url, question, answer, [(score,)] if score is not None else [], (n, 3, language, "", "d"), (question,))


PAIR = "id string, source string, thread_id string, thread_url string, question string, answer string, raw_answers array<struct<score:int>>, metadata struct<useful_answer_count:int,answer_count:int,language:string,scraped_date:string,processed_date:string>, raw_question struct<content:string>"


def test_validation(spark):
    rows = [pair(1, "Can I move twice in a turn?", "Yes you can always do that, friend.", 9, 2), pair(2, "can i move TWICE, in a turn", "No, and that is it for this one.", 5), pair(3, "", "x", 1), pair(4, "Why?", "Because", 0, 1, "ftp://y/z", "de"), pair(5, "Is it long enough to be asked?", "It is, as far as I can see it here.", 3)]
    qa = spark.createDataFrame(rows, PAIR)
    r = reports.validation(threads.checked(qa, "x.com")).first()
    assert (r.total_pairs, r.valid_pairs, r.invalid_pairs, r.single_answers, r.multiple_answers, r.high_scores, r.low_scores) == (5, 4, 1, 3, 1, 1, 2)
    assert r.warning_details == ["f2: duplicate of f1", "f4: language de"] and r.warnings == 2
    assert [e.split(":")[0] for e in r.error_details] == ["f3", "f4", "f4", "f4"] and r.errors == 4 and all(i.startswith(("f2", "f4")) for i in r.issue_details)
    m = {x.name: (x.least, x.most, round(x.mean, 3), x["median"]) for x in reports.upper_medians(qa, reports.pair_values()).collect()}
    scores = sorted([9, 5, 1, 0, 3])
    assert m["answer_score"] == (0, 9, 3.6, scores[len(scores) // 2]) and m["question_length"][3] == sorted(len(x[4]) for x in rows)[2]
    many = spark.createDataFrame([pair(k, "Can I move this many times?" if k % 10 else "Can I", "Yes you can move as many times as you like.", k % 12) for k in range(200)], PAIR)
    got = reports.review_sample(many)
    assert {x.stratum: x["count"] for x in got.groupBy("stratum").count().collect()} == {"edge": 3, "high": 10, "medium": 10, "low": 10}
    assert {x.id for x in got.collect()} == {x.id for x in reports.review_sample(many.repartition(5)).collect()} != {x.id for x in reports.review_sample(many, seed=1).collect()}
    partly = threads.checked(qa.drop("source").withColumn("metadata", F.struct("metadata.language")), "x.com").where("id = 'f1'").first().errors
    assert partly == ["missing source", *(f"missing metadata {f}" for f in threads.REQUIRED_METADATA[1:])]
    posts = spark.createDataFrame([("1", "en", [("a", "en"), ("b", "de"), ("c", None)]), ("2", "de", [])], "thread_id string, language string, posts array<struct<content:string,language:string>>")
    assert [[p.content for p in r.posts] for r in threads.in_language(posts).collect()] == [["a"]] and threads.in_language(posts, None).count() == 2
    metrics = reports.answer_metrics(spark.createDataFrame([("hi @a @b",), ("x" * 501,)], "answer string")).first()
    assert (metrics.total_mentions, metrics.answers_over_500_chars, metrics.answers_with_mentions_pct) == (2, 1, 50.0)
    changed = {x.metric: x.percent for x in reports.metric_changes(spark.sql("select 0 as a, 4 as b"), spark.sql("select 1 as a, 5 as b")).collect()}
    assert changed == {"a": None, "b": 25.0}


def test_chunk_reports(spark):
    rows = [("rulebook", 50, 90.0, 0.9, "pdf"), ("rulebook", 50, 70.0, 0.7, "ocr"), (None, 50, 10.0, 0.1, "ocr"), ("faq", 45, None, None, None)]
    c = spark.createDataFrame(rows, "source_type string, priority int, quality_score double, extraction_confidence double, extraction_method string")
    r = {x.source_type: x for x in reports.chunk_report(c).collect()}
    assert (r["rulebook"].chunks, r["rulebook"].high, r["rulebook"].medium, r["rulebook"].low, r["rulebook"].pdf, r["rulebook"].ocr, r["rulebook"].sure) == (3, 1, 1, 1, 1, 2, 1)
    assert r["faq"].mean_quality == 0 and r["faq"].boost == 0.9
    lines = [x.line for x in reports.report_lines(reports.chunk_report(c)).orderBy("source_type", "number").collect()]
    assert lines[0] == "faq: 1 chunks (priority: 45, boost: 0.9x)" and "  Methods: PDF 1, OCR 2" in lines
    f = reports.chunk_format(c.withColumn("n", F.monotonically_increasing_id()), ["n"]).first()
    assert f.has_rulebook and f.has_faq and not f.has_forum and f.has_pdf and f.has_ocr and f.has_quality_scores and f.has_priority and f.total_chunks == 4
    assert not reports.chunk_format(c.where("false").select("priority"), ["priority"]).first().has_priority
    h = spark.createDataFrame([(1, 1, "forum", "q?", "said", 1.5, 3, "s", "ann", "u", 11.5, None), (1, 2, None, "t", None, 0.5, 4, None, None, None, None, None), (1, 6, "faq", "t", "a", 0.5, 4, None, None, None, None, None)], "qid int, rank int, source_type string, text string, answer string, score double, page int, section string, answer_user string, url string, forum_quality_score double, faq_id string")
    d = reports.chunk_details(h, "qid").orderBy("rank").collect()
    assert len(d) == 2 and (d[0].text, d[0].score, d[0].answered_by, d[0].quality_score, d[0].page) == ("said", 0.5, "ann", 10, None) and (d[1].text, d[1].page, d[1].section) == ("t", 4, "Unknown")
    for columns, want in (("0.5 as overall_score, 9.0 as similarity", 50.0), ("0.25 as score", 25.0), ("7.0 as similarity", 7.0)):
        df = spark.sql(f"select {columns}")
        assert df.select(reports.canonical_score(df).alias("x")).first().x == want


def test_significance(spark):
    assert math.isclose(reports.student_p(2.0, 10), 0.07338803477074039, rel_tol=1e-9) and math.isclose(reports.student_p(0.5, 1), 0.7048327646991335, rel_tol=1e-9)
    assert math.isclose(reports.student_p(12.706204736174698, 1), 0.05, rel_tol=1e-9) and reports.student_p(0.0, 5) == 1.0
    d = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 2.0)], "d double")
    got = reports.paired_t(d)
    assert got["n"] == 4 and math.isclose(got["t"], 2 / (math.sqrt(2 / 3) / 2)) and got["p"] < 0.02
    assert reports.paired_t(d.where("false"))["p"] == 1.0


def test_text_functions(spark):
    assert one(spark, lambda a: T.language(a, F.lit("de")), "short") == "en" and one(spark, lambda a: T.language(a, F.lit("de")), "x" * 30) == "de" and one(spark, lambda a: T.language(a, F.lit(None).cast("string")), "x" * 60) == "en"
    fix = lambda a: T.whole_words_replaced(a, F.array(F.struct(F.lit("teh").alias("original"), F.lit("the").alias("correction")), F.struct(F.lit("c.t").alias("original"), F.lit(r"\$1").alias("correction"))))
    assert one(spark, fix, "Teh tehran teh c.t cat") == r"the tehran the \$1 cat"
    assert one(spark, Q.all_questions, "Doors?", "") == ["Doors?"] and one(spark, Q.all_questions, None, None) == []
    assert one(spark, Q.all_questions, "doors", "the red one opens how far?") == ["Doors: The red one opens how far?"]
    assert one(spark, lambda a: Q.needs(Q.intent(a)), "how many dice").needs_quantitative is True
    parts = {k: F.lit(0.5) for k in C.WEIGHTS}
    text = one(spark, lambda a: C.explained(parts, a), "abc")
    assert text.startswith("Overall Score: 0.500\n") and "  Accuracy:     0.500 (weight: 40%)" in text and "Answer length: 3 characters" in text and text.endswith("Interpretation: Fair - Some improvement needed")
    assert one(spark, lambda a, b: C.sequence_likeness(a, b), "abcd", "abxd") == 0.75
    for text, name in (("1. Setup of it", "Setup of it"), ("| The Name | x", "The Name"), ("GAME SETUP\nput it", "GAME SETUP"), ("put it down then\nend of scoring here\n", "end of scoring here"), ("nothing", None)):
        assert one(spark, L.section_name, text) == name, text
    assert one(spark, lambda a: L.section_name(a, F.lit("before")), "nothing") == "before"


def test_parsing(spark):
    body = "This is a sentence of the rules that is long enough to be kept here."
    page = "\n".join(["HEAD LINE", "MOVING AROUND TOWN", "", body, "", "tiny", "", "Thank you all for playing our game so much", "", "7"])
    contents = "\n\n".join(["Moving around the board of it 12", body])
    pages = spark.createDataFrame([(1, 1, contents), (1, 2, page), (2, 1, None), (3, 9, "bcdfghjklmnpqrstvwxzbcdfghjklmnpqrstvwxz")], "doc int, page int, text string")
    reasons = {(r.doc, r.page, r.para_idx): r.skip_reason for r in parse.paragraphs(pages, "doc").collect()}
    assert reasons[1, 1, 0] == "contents" and reasons[1, 1, 1] is None and reasons[1, 2, 2] == "short" and reasons[1, 2, 3] == "front matter" and reasons[2, 1, 0] == "short"
    got = parse.parsed(pages, "doc", "pdf").orderBy("doc", "chunk_index").collect()
    assert {r.doc for r in got} == {1} and all(body in r.text or r.text == body for r in got) and got[0].extraction_method == "pdf" and got[0].corrections == 0
    fixed = parse.parsed(pages, "doc", "ocr", lexicon=spelling.Lexicon({"sentence": 9, "rules": 5}, typos={"kept": "held"})).collect()
    assert all("held here" in r.text for r in fixed) and fixed[0].corrections >= 1


def test_all_sources(spark):
    text = "The player draws a card and then moves to the next space of the board. "
    rule = "book int, chunk_index long, page long, text string, section string"
    pdf = spark.createDataFrame([(1, 0, 2, text * 3, "Turn"), (1, 1, 1, "Something else is told in this paragraph of the book.", None)], rule)
    ocr = spark.createDataFrame([(1, 0, 2, (text * 3).replace("l", "1"), "Turn"), (1, 5, 7, "Only the scan has this sentence about dice and luck.", None)], rule)
    faq = spark.createDataFrame([("q", "a", "faq", 45, "faq_1")], "text string, answer string, source_type string, priority int, faq_id string")
    out = merge.in_order(merge.all_sources(pdf, ocr, faq)).collect()
    assert [(r.source_type, r.page, r.extraction_method) for r in out] == [("faq", None, None), ("rulebook", 1, "pdf"), ("rulebook", 2, "pdf"), ("rulebook", 7, "ocr")]
    assert out[2].alt_source_available and out[2].similarity_to_alt > 80 and list(out[0].asDict()) == list(merge.UNIFIED)
    alone = merge.all_sources(ocr=ocr).collect()
    assert {r.extraction_method for r in alone} == {"ocr"} and all(r.quality_score > 0 for r in alone)


def test_asking(spark):
    lex = spelling.Lexicon({"how": 9, "does": 9, "the": 9, "player": 9, "move": 9, "tokens": 4, "what": 3, "is": 5, "a": 5})
    q = spark.createDataFrame([(1, "How does teh player moev?"), (2, "What is a Borsuk"), (3, "zzz")], "qid int, question string")
    fixed = {r.qid: r for r in spelling.question_corrections(q, lex).collect()}
    assert fixed[1].question == "How does the player move?" and [tuple(c) for c in fixed[1].corrections] == [("teh", "the"), ("moev", "move")] and fixed[2].corrections == []
    rows = [(1, "First the player must move a token to the next space. Then the player draws.", None, "rulebook", 50), (2, "How does a player move", "You just move ahead.", "forum", 30), (3, "Move of players", "Official move.", "faq", 45), (4, "Other text on dice that nobody asked for.", None, "rulebook", 50)]
    chunks = spark.createDataFrame(rows, "doc_id int, text string, answer string, source_type string, priority int")
    vectors = chunks.select(F.col("doc_id").alias("vec_id"), retrieve.embedded(F.col("text")).alias("embedding")).cache()
    out = {r.qid: r for r in ask(q.where("qid < 3").withColumn("q", retrieve.embedded(F.col("question"))), chunks, vectors, lexicon=lex).collect()}
    assert set(out) == {1, 2} and out[1].question == "How does the player move?" and out[1].source in ("forum", "rulebook")
    assert out[1].answer == ("You just move ahead." if out[1].source == "forum" else rows[0][1]) and 0 <= out[1].overall <= 1 and len(out[1].chunks) >= 1
    assert out[1].forum_confidence == round(out[1].forum_confidence, 2)
