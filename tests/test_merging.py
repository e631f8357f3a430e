"""Merging puts texts together in one shuffle and compares only what follows common words."""

import random

from pyspark.sql import functions as F

from folioscope.operators import merge


def test_one_shuffle(spark):
    """Chunks are made and sent once; those of no book match none, books of one side are kept."""
    kind = "book int, idx int, text string, section string"
    p = spark.createDataFrame([(1, 0, "place the tokens on the board", None), (None, 0, "place the tokens", None), (2, 0, None, None), (4, 1, "b", "Setup"), (4, 0, "a", None)], kind)
    o = spark.createDataFrame([(1, 5, "place the tokens on the board", None), (None, 0, "place the tokens", None), (3, 0, "alone", None)], kind)
    out = merge.merge(p, o)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    rows = sorted(map(str, ((r.book, r.idx, r.text, r.method, r.alternative) for r in out.collect())))
    assert rows == sorted(map(str, [(1, 0, "place the tokens on the board", "pdf", True), (None, 0, "place the tokens", "pdf", False), (None, 0, "place the tokens", "ocr", False), (2, 0, "", "pdf", False), (3, 0, "alone", "ocr", False), (4, 0, "a", "pdf", False), (4, 1, "b", "pdf", False)]))
    none = merge.merge(p.where("false"), o.where("false"))
    assert none.count() == 0 and none.withColumn("x", F.lit(1)).columns[0] == "book"


def test_ratio_without_common_words():
    """The ratio of what follows common words is that of the whole strings."""
    rng, ws = random.Random(9), "aa ab ba abc cab b c bca".split()
    for _ in range(500):
        a, b = (" ".join(rng.choices(ws, k=rng.randint(1, 6))) for _ in "ab")
        x, y = set(a.split()), set(b.split())
        common, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
        whole = [f"{common} {s}".strip() for s in (left, right)]
        parts = [merge.indel_ratio(common, w) for w in whole] if common else []
        assert merge.token_set_ratio(a, b) == (100.0 if common and not (left and right) else max(*parts, merge.indel_ratio(*whole)) if parts else merge.indel_ratio(*whole))
