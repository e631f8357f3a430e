"""Questions, answers, layout, chunks, spelling, merging, threads, readers and sinks on literal rows."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioscope.functions import answers as A
from folioscope.functions import layout as L
from folioscope.functions import questions as Q
from folioscope.functions import scores as C
from folioscope.operators import answer, chunk, learning, merge, spelling, threads
from folioscope.plans.registry import QUERIES
from folioscope.sources import html, readers, sinks


def values(spark, f, *rows):
    """f of each row's columns a, b, ..."""
    names = "abc"[: len(rows[0])]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + ", ".join(f"{n} string" for n in names))
    return [r["x"] for r in df.select("k", f(*(F.col(n) for n in names)).alias("x")).orderBy("k").collect()]


def test_questions(spark):
    asked = [("How many dice do I roll",), ("How do I move",), ("What is a ghost",), ("When is it over",), ("Where to go",), ("Who starts",), ("Why so",), ("May I pass",), ("Move",), ("",)]
    assert values(spark, Q.intent, *asked) == ["how_many", "how_to", "what_is", "when", "where", "who", "why", "can", "general", "general"]
    assert values(spark, Q.question_type, *asked)[:3] == ["procedural", "procedural", "definitional"]
    assert values(spark, Q.with_mark, ("can I",), ("go there? ",), ("so you should stay",), ("stay",)) == ["can I?", "go there?", "so you should stay?", "stay"]
    assert values(spark, Q.cleaned, ("hello, can I  go thanks!",), ("",)) == ["Can I go", ""]
    two = "How far can I go in one turn? Also where do I stop then?"
    assert values(spark, Q.split_questions, (two,), ("no.",)) == [["How far can I go in one turn?", "Also where do I stop then?"], ["no."]]
    long = "word " * 40
    assert values(spark, Q.core, ("a, can I go",), (long,), ("Yes. Is it so? No.",)) == ["can I go?", ("word " * 29 + "word").strip(), "Is it so?"]


@pytest.mark.parametrize(
    ("title", "content", "question"),
    [
        ("Can I move twice?", "text", "Can I move twice?"),
        ("Movement: doors", "Can I open a door from far away? Thanks", "Movement: Can I open a door from far away?"),
        ("doors", "I wonder. can I open one from here. ok", "Doors: Can I open one from here?"),
        ("opening of doors", "opening of doors is hard. Why is that so hard?", "Opening of doors is hard. Why is that so hard?"),
        ("what about this long title without content here", "", "What about this long title without content here?"),
        ("", "", None),
        (None, None, None),
    ],
)
def test_extract(spark, title, content, question):
    assert values(spark, Q.extract, (title, content)) == [question]


def test_answers(spark):
    tail = "the answer is that you may always move again after a fight"
    assert values(spark, A.last_of_quotes, (f"@a said @b {tail}",), ("@a and @b short",)) == [tail, "@a and @b short"]
    assert values(spark, A.without_attributions, ("John Smith@smith yes",), ("no. @bob  says it",)) == ["yes", "nosays it"]
    assert values(spark, A.without_fillers, ("Well, you can. Hope that helps!",), ("I think so",)) == ["You can.", "So"]
    assert values(spark, A.without_question, ("Can I move twice? Yes you can.", "Can I move twice?"), ("Q: what A: that", "x")) == ["Yes you can.", "that"]
    s = "x" * 299 + "."
    assert values(spark, A.shortened, ("short",), (f"{s} {s}",), ("y" * 600,)) == ["short", s, "y" * 497 + "..."]
    rate = lambda c, q: A.usefulness(c, q, F.lit(False))
    got = values(spark, rate, ("ok", "q"), ("thank you!!", "q"), ("Yes, the rulebook on page 12 says you must always do it that way.", "May I?"), ("I'm not sure, is that so? or that? or what?", "Q"), (None, None))
    assert [g["score"] for g in got] == [0, 0, 2 + 4 + 3 + 1 + 2, 0, 0]
    assert values(spark, lambda c, q: A.usefulness(c, q, F.lit(True)), ("Move the token to the next space of the board now.", "How?"))[0]["score"] == 2 + 4 - 2


def test_scores(spark):
    assert values(spark, C.completeness, ("Can Stalker move", "You may move if the stalker is ready")) == [pytest.approx(0.5 + 0.3 + 0.2 + 0.3 - 0.3)]
    assert values(spark, C.conciseness, ("xyz", "a" * 100), ("xyz", "a" * 300), ("xyz", "a" * 1200)) == [0.5, 1.0, 0.5]
    row = spark.range(1).select(C.accuracy(F.lit(0.65), F.lit(0.5), F.lit(0.5), F.lit(0.5)).alias("a"), C.consistency(F.lit("The red fox runs. ok"), F.array(F.lit("a red fox"))).alias("c"), C.consistency(F.lit(""), F.array(F.lit("x"))).alias("e")).first()
    assert (row["a"], row["c"], row["e"]) == (0.75, 0.5, 0.5)
    with pytest.raises(ValueError):
        C.overall({}, {"relevance": 0.5})


def test_headings(spark):
    texts = [("GAME SETUP",), ("SETUP",), ("RANGE OF FIRE",), ("(PLAYER TURNS)",), ("A B",), ("Game Setup",), ("Design: John",), ("Bolts and",), ("going to the Zone",), ("",)]
    assert values(spark, L.caps_heading, *texts) == [True, False, False, True, False, False, False, False, False, False]
    assert values(spark, L.title_heading, *texts) == [False, False, True, False, False, True, False, False, False, False]
    assert values(spark, lambda t: L.title_heading(t, strict=False), ("Design: John",)) == [True]
    assert values(spark, L.is_skipped, ("Credits",), ("Production: x",), ("3x  dice",), ("Move on",)) == [True, True, True, False]
    assert values(spark, L.is_example, ("Example: x",), ("So. Example: x",), ("no example: x",)) == [True, True, False]
    assert values(spark, L.body_lines, ("a\nb\nc\nd\ne",), ("a\nb",)) == ["b\nc\nd", "a\nb"]
    assert values(spark, L.spaced_table, ("•a\n•b\nx\n•c",), ("•a",)) == ["•a\n•b\n\nx\n•c\n", "•a"]
    assert values(spark, L.same_topic, ("the enemy", "a turn"), ("enemy", "enemy turn"), ("x", "turn")) == [False, False, True]


def test_chunks(spark):
    text = " ".join(f"Sentence number {k} has some words in it." for k in range(60))
    parts = chunk.pieces(text, 300, 80)
    assert all(len(p) <= 300 + 80 for p in parts) and parts[0].startswith("Sentence number 0 ") and parts[-1].endswith("59 has some words in it.")
    for a, b in zip(parts, parts[1:], strict=False):
        assert b.split(". ")[0] in a and f"{b.split('. ')[0]}." in a
    assert chunk.pieces("x" * 2000) == ["x" * 1000, "x" * 1000, "x" * 300]
    assert chunk.pieces("") == [""]
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {}
    for r in chunk.overlapping(docs, "doc_id", size=300, overlap=80).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append(r["chunk"])
    assert got == {1: parts, 3: [""]}


def test_sections(spark):
    body = "You must place all of the tokens on the board first."
    ps = ["", "intro words are here", "GAME SETUP", body, "LOST CARD", "OTHER CARD", "First Steps", body, "Example: skipped text", "Credits Writing: someone", "left out", "PLAYER TURN", body]
    docs = spark.createDataFrame([(1, ps), (2, None), (3, [])], "doc_id long, paragraphs array<string>")
    rows = chunk.sections(docs, "doc_id").orderBy("chunk_index").collect()
    assert [(r["doc_id"], r["text"], r["section"], r["subsection"]) for r in rows] == [
        (1, "intro words are here", None, None), (1, body, "GAME SETUP", None), (1, f"First Steps\n\n{body}", "OTHER CARD", "First Steps"), (1, body, "PLAYER TURN", None),
    ]
    long = chunk.sections(spark.createDataFrame([(1, ["para one of text. " * 60])], docs.schema), "doc_id").collect()
    assert len(long) == 2


def test_spelling(spark):
    lex = spelling.Lexicon({"house": 3, "mouse": 2, "stale": 1, "move": 1}, terms=("Stalker",), typos={"teh": "the"}, fragments={"mov": "move"})
    c = spelling.Corrector(lex)
    assert [c.correct(w) for w in ("Teh", "TEH", "stalkr", "Stalkers", "mov", "house", "huose", "Hose", "xqzzkw", "a1", "STALKER")] == ["The", "THE", "stalker", "Stalker", "move", "house", "house", "House", "xqzzkw", "a1", "STALKER"]
    near = {w for w in lex.known for x in spelling._edits("mose") if w in spelling._edits(x)}
    assert near >= c.candidates("mose") == {"mouse", "move"}
    docs = spark.createDataFrame([(1, "Teh huose, teh end."), (2, ""), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["corrections"]) for r in spelling.corrected(docs, lex, "doc_id").collect()}
    assert got == {1: ("The house, the end.", 3), 2: ("", 0), 3: (None, 0)}


def test_spelling_of_all_words(spark, tmp_path):
    known = [f"{a}{b}{c}ing{d}" for a in "bdfgk" for b in ("ra", "lo", "umi", "ent") for c in "mnprstvz" for d in "aeioumprstvxyzwq"]  # 2560 words
    texts = [(k, 0, "user", f"the {w} {w.upper()} the") for k, w in enumerate(known)] + [(-1, 0, "user", "Teh zzqqxxjj braming\u00e9s"), (-2, 0, "user", None)]
    spark.createDataFrame(texts, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["word"]: r["correction"] for r in QUERIES["op_spelling"](spark, str(tmp_path)).collect()}
    whole = spelling.Corrector(spelling.Lexicon(dict.fromkeys([*known, "the"], 2)))
    want = {w: whole.correct(w) for w in (*known, "the", "Teh", "zzqqxxjj", "braming\u00e9s")}
    assert got == {w: c for w, c in want.items() if w != c} and got["Teh"] == "The" and set(got) <= {"Teh", "braming\u00e9s"}


def test_ratios():
    for a, b in (("abcde", "abxde"), ("", ""), ("abc", ""), ("kitten", "sitting"), ("aab", "baa")):
        n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
        assert merge.indel_ratio(a, b) == (200 * n[-1][-1] / (len(a) + len(b)) if a or b else 100)
    assert merge.token_set_ratio("a b c", "c b") == 100 and merge.token_set_ratio("", "a") == 0
    assert merge.token_set_ratio("red fox", "red cat") == merge.indel_ratio("red", "red fox") == 60


def test_merge(spark):
    kind = "book int, idx int, text string, section string"
    p = spark.createDataFrame([(1, 0, "place all tokens on the board", "Setup"), (1, 1, "something else entirely", None), (1, 2, "enemy attack water loot", None), (2, 0, None, None)], kind)
    o = spark.createDataFrame([(1, 0, "place all tokens on the board now", "Setup"), (1, 1, "radiation", None), (1, 2, "enemy attack water loot card tile round turn", None)], kind)
    rows = {(r["idx"], r["method"]): r for r in merge.merge(p, o).where("book = 1").collect()}
    assert set(rows) == {(0, "pdf"), (1, "pdf"), (2, "pdf"), (1, "ocr"), (2, "ocr")}
    assert rows[0, "pdf"]["similarity"] == 100 and rows[0, "pdf"]["alternative"]
    assert rows[2, "pdf"]["variant"] and not rows[2, "pdf"]["alternative"] and rows[2, "pdf"]["similarity"] is None
    assert not rows[1, "ocr"]["alternative"]


def test_learning(spark):
    pairs = spark.createDataFrame([("]talker", "Stalker")] * 2 + [("]tone", "Stone")] * 2 + [("moves", "moved")] * 3 + [("a", "a"), (None, "x"), ("", "y")], "original string, corrected string")
    assert {tuple(r) for r in learning.characters(pairs).collect()} == {("]", "S", 4), ("s", "d", 3)}
    assert [tuple(r) for r in learning.starts(pairs).collect()] == [("]", "S", 2)]
    assert [tuple(r) for r in learning.whole_words(pairs).collect()] == [("moves", "moved", 3)]
    fix = lambda t: learning.repaired(t, {"0": "o", "ß": "ss"}, [{"pattern": r"\]\w+", "type": "prefix_replace", "prefix": "]", "prefix_replacement": "S"}, {"pattern": "teh", "replacement": "the"}])
    assert values(spark, fix, ("]talker teh m0ve ß",), (None,)) == ["Stalker the move ss", None]


def test_assembly(spark):
    rows = spark.range(1).select(
        answer.extractive(F.array(F.lit("a" * 500), F.lit(""), F.lit("Bb. " + "c" * 400), F.lit("d"))).alias("part"), answer.extractive(F.array().cast("array<string>")).alias("none"),
    ).first()
    assert rows["part"] == "a" * 500 + " Bb." and rows["none"] == answer.NOTHING
    f = spark.createDataFrame([(1, 1, 1.9), (2, 1, 1.1), (4, 1, 1.2)], "q int, rank int, score double")
    r = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.5), (3, 1, 0.2)], "q int, rank int, score double")
    q = spark.range(1, 6).withColumnRenamed("id", "q")
    assert {x["q"]: x["source"] for x in answer.arbitrated(q, f, r, "q").collect()} == {1: "forum", 2: "rulebook", 3: "rulebook", 4: "forum", 5: "none"}


POSTS = [
    {"post_id": "1", "author": "ann", "date": "d", "content": "Can I move again after I attack an enemy?", "position": 0, "language": "en"},
    {"post_id": "2", "author": "bob", "date": "d", "content": "ok", "position": 1, "language": "en"},
    {"post_id": "3", "author": "cid", "date": "d", "content": "Yes, the rules on page 7 say that you may always move again.", "position": 2, "language": "en"},
    {"post_id": "4", "author": "dan", "date": "d", "content": "You move the token to the next space again after that.", "position": 3, "language": "en"},
]


def test_bounds_of_matches():
    r = random.Random(5)
    ws = ["move", "moves", "card", "the", "a", "draw", "red", "token", "tokens", "of", "space", "dice"]
    texts = [" ".join(r.choices(ws, k=r.randint(0, 12))) for _ in range(60)] + ["", "x", "the the the"]
    bounds = merge._Candidates(texts)
    for t in texts:
        for o, b in zip(texts, bounds.bounds(t), strict=True):
            assert merge.token_set_ratio(t, o) <= b
    rows = lambda ts: pd.DataFrame({"idx": range(len(ts)), "norm": ts, "topics": [[] for _ in ts]})
    a, b = rows(texts[:30]), rows(texts[30:])
    free, want = list(range(len(b))), []
    for i, t in enumerate(texts[:30]):  # all pairs, the first of the best
        rated = [(merge.token_set_ratio(t, texts[30 + j]), -j) for j in free]
        best, j = max(rated, default=(0, 0))
        if best >= 80:
            want.append((i, -j, best))
            free.remove(-j)
    assert merge._claims(a, b, 80.0) == want and len(want) > 5


def test_threads_and_files(spark, tmp_path):
    folder = tmp_path / "threads"
    folder.mkdir()
    thread = {"thread_id": "9", "url": "https://f.example.com/thread/9", "title": "moving", "language": "en", "posts": POSTS}
    (folder / "9.json").write_text(json.dumps(thread, indent=1))
    (folder / "8.json").write_text(json.dumps(thread | {"thread_id": "8", "url": "ftp://x/y"}))
    (folder / "7.json").write_text("{broken")
    (folder / "6.json").write_text(json.dumps(thread | {"thread_id": "6", "language": "de"}))
    (folder / "manifest.json").write_text('{"thread_id": "m"}')
    t = readers.threads(spark, str(folder))
    assert sorted(r["thread_id"] for r in t.collect()) == ["6", "8", "9"]
    p = threads.pairs(t)
    rows = {r["id"]: r for r in threads.checked(p, "example.com").collect()}
    assert set(rows) == {"forum_8", "forum_9"}
    nine, eight = rows["forum_9"], rows["forum_8"]
    assert nine["question"] == "Moving: Can I move again after I attack an enemy?" and nine["answer"] == POSTS[2]["content"]
    assert [(a["rank"], a["author"]) for a in nine["raw_answers"]] == [(1, "cid"), (2, "dan")]
    assert (nine["errors"], nine["duplicate_of"], eight["errors"]) == ([], "forum_8", ["scheme", "domain", "path"])
    assert threads.summary(p).first()["pairs"] == 2 and threads.question_pairs(t).count() == 2
    p.where("thread_id = '9'").write.json(str(tmp_path / "forum"))
    f = readers.forum(spark, str(tmp_path / "forum")).first()
    assert (f["quality_score"], f["extraction_confidence"], f["answer_user"]) == (20.0, 0.2, "cid")


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "faq.json").write_text(json.dumps([{"question": "a", "answer": "b"}, {"question": "c", "answer": "d", "faq_id": "own", "quality_score": 9}]))
    assert [(r["faq_id"], r["quality_score"]) for r in readers.faq(spark, str(tmp_path / "faq.json")).collect()] == [("faq_1", 75.0), ("own", 9.0)]
    (tmp_path / "terms.csv").write_text("# comment\n Stalker \nbolt\nBolt\n")
    assert {r["term"] for r in readers.terms(spark, str(tmp_path / "terms.csv")).collect()} == {"stalker", "bolt"}
    (tmp_path / "fr.csv").write_text("fragment,full_word\nmov,move\nmov,moved\n")
    assert [tuple(r) for r in readers.fragments(spark, str(tmp_path / "fr.csv")).collect()] == [("mov", "moved")]
    (tmp_path / "page_012.txt").write_text("one\ntwo")
    assert [tuple(r) for r in readers.page_texts(spark, str(tmp_path)).collect()] == [(12, "one\ntwo")]
    (tmp_path / "run_20240102_030405.csv").write_text("question,score\nx,1\n")
    assert str(readers.runs(spark, str(tmp_path / "run_*.csv")).first()["run_ts"]) == "2024-01-02 03:04:05"
    (tmp_path / "q.csv").write_text('question,ground_truth\n"a, ""b""","c\nd"\n')
    assert [tuple(r) for r in readers.questions(spark, str(tmp_path / "q.csv")).collect()] == [('a, "b"', "c\nd")]
    spark.createDataFrame([("[1.0, 2.0]",)], "embedding string").write.parquet(str(tmp_path / "e"))
    assert readers.embeddings(spark, str(tmp_path / "e")).first()["embedding"] == [1.0, 2.0]
    c = spark.createDataFrame([(0, "t", [1.0], "forum", "q7"), (1, "", [1.0], "faq", None), (2, "t", None, None, None), (3, "t", [2.0], None, None)], "idx int, text string, embedding array<double>, source_type string, qa_id string")
    sinks.write_index(c, str(tmp_path / "index"), str(tmp_path / "bad"), 1)
    assert {r["_id"] for r in spark.read.parquet(str(tmp_path / "index")).collect()} == {"forum_q7", "rulebook_0_3"}
    assert {r["reject_reason"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()} == {"empty text", "invalid embedding"}
    sinks.delete_source(spark.read.parquet(str(tmp_path / "index")), "forum", str(tmp_path / "index2"))
    assert spark.read.parquet(str(tmp_path / "index2")).count() == 1
    terms = spark.createDataFrame([("B",), ("a",)], "term string")
    sinks.write_terms(terms, str(tmp_path / "terms"))
    sinks.write_terms(terms.limit(0), str(tmp_path / "terms"))
    assert spark.read.csv(str(tmp_path / "terms")).count() == 2


def test_html(spark):
    page = """<html><title>Rules | Forum</title><script>var x = "<b>";</script><article id="p1"><span class="username">Ann</span><time datetime="2024"></time>
    <div class="post_content">Hello <b>there</b><br>friend &amp; foe</div></article><article><p>short</article><article>no author but long enough</article></html>"""
    assert html.parse_posts(page) == [("p1", "Ann", "2024", "Hellotherefriend & foe", 0), ("post_2", "User_2", "", "no author but long enough", 2)]
    assert html.parse_posts('<div class="comment">ten characters</div>') == [("post_0", "User_0", "", "ten characters", 0)]
    pages = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    assert html.posts(pages).count() == 2
    assert [r["t"] for r in pages.orderBy("page_id").select(html.title(F.col("html")).alias("t")).collect()] == ["Rules", "", ""]
