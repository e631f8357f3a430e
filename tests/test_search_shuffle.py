"""Whole search queries shuffle hits, not the places of tokens, however frequent the words are."""

import random

import pytest

from folioscope.plans.registry import QUERIES

NAMES = ["co_sources", "co_answers", "co_dual_source", "co_search", "co_weight_sweep", "co_best_chunk", "co_batch", "ev_mismatches", "ag_weight_advice", "ag_batch", "ag_weight_runs", "co_extractive", "ev_scores"]
TEXTS, WORDS = 600, 120


@pytest.fixture(scope="module")
def frequent(spark, tmp_path_factory):
    """Texts of five words that stand in nearly all of them, and a vector for each."""
    rng, path = random.Random(3), str(tmp_path_factory.mktemp("frequent"))
    texts = [". ".join(" ".join(rng.choices("alpha bravo candle dawn echo".split(), k=10)) for _ in range(WORDS // 10)) for _ in range(TEXTS)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2).write.parquet(f"{path}/documents.parquet")
    vectors = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(TEXTS)]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").coalesce(2).write.parquet(f"{path}/embeddings.parquet")
    return path


def stages(spark, after=-1):
    """Stages with an id over after: the highest id, rows and bytes that they wrote to shuffles."""
    gateway, sc = spark.sparkContext._gateway, spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(60_000)
    listed = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    some = [s for s in (listed.apply(i) for i in range(listed.size())) if s.stageId() > after]
    return max((s.stageId() for s in some), default=after), sum(s.shuffleWriteRecords() for s in some), sum(s.shuffleWriteBytes() for s in some)


def shuffled(spark, name, path):
    """Rows out, then rows and bytes that a query shuffles."""
    spark.catalog.clearCache()
    last = stages(spark)[0]
    rows = QUERIES[name](spark, path).collect()
    return len(rows), *stages(spark, last)[1:]


@pytest.mark.parametrize("name", NAMES)
def test_fewer_rows_than_tokens(spark, frequent, name):
    """Six questions of four tokens, which stand in nearly all texts: what is shuffled is fewer rows than the texts have tokens."""
    _, rows, _ = shuffled(spark, name, frequent)
    assert 0 < rows < TEXTS * WORDS / 2
