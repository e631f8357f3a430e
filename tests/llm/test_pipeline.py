"""The composed stages of the pipeline against plain Python."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from test_methods import links_of, near_family, text
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from folioscope.llm import mixing, quality, tokens  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    good = [text(k, 60 + k) for k in range(40)] + near_family(500, 8, 100, 1) + near_family(501, 5, 150, 2) + [text(3, 63)] * 3
    item = text(900, 25)
    good += [f"{text(700 + k, 30)} {item if k % 2 else ' '.join(item.split()[:9])} {text(800 + k, 30)}" for k in range(10)]
    junk = [" ".join(f"{w}&&&" for w in text(1000 + k, 50).split()) for k in range(30)]
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(x for pair in zip(good + junk, range(999), strict=False) for x in pair[:1])]
    rows += [(900, None, "en", None, 0), (901, "", None, "s1", 0), (None, text(44, 80), "en", "s2", 5)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(k < len(good))) for k in range(0, len(good) + len(junk), 2)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, {t for t in junk}, item


def test_stages(spark, tables):
    path, rows, junk, item = tables
    # 1: by a model fitted on the same labels, scored text by text
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)

    def scored(t):
        idx = quality.gram_ids(t, quality.Memo(), model.bits)
        dot = model.scale * sum(float(model.weights[i]) for i in idx) / len(idx) if len(idx) else 0.0
        return 1 / (1 + math.exp(-(model.bias + dot)))

    kept = [r for r in rows if scored(r[1]) >= 0.5]
    assert not junk & {r[1] for r in kept} and len(kept) >= len(rows) - len(junk) - 3
    # 2: the least id of each class
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    links = links_of([r[1] for r in kept])
    root = list(range(len(kept)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in sorted(links):
        root[max(top(a), top(b))] = min(top(a), top(b))
    kept = [r for k, r in enumerate(kept) if top(k) == k]
    # 3: no ten words of the item
    windows = {tuple(item.split()[k : k + 10]) for k in range(16)}
    holds = lambda t: any(tuple(w[k : k + 10]) in windows for w in [(t or "").lower().split()] for k in range(len(w)))
    assert any(holds(r[1]) for r in kept)
    kept = [r for r in kept if not holds(r[1])]
    # 4: as often as the mix takes each of what is left
    left = spark.createDataFrame(kept, "doc_id long, text string, lang string, source string, n_chars long")
    taken, sources = mixing.shares(left)
    copies = {r.doc_id: r.taken // r["size"] if r["size"] else 0 for r in taken.collect()}
    assert set(copies.values()) <= {0, 1, 2}
    assert abs(sum(copies[r[0]] * len((r[1] or "").split()) for r in kept) - sum(s.target for s in sources.collect())) < 60 * 3
    # 5: token ids of each copy, in order
    whole = Tokenizer.from_file(tokens.vocabulary_path())
    want, at = [], 0
    for i, t, *_ in sorted(kept, key=lambda r: (r[0] is not None, r[0] or 0)):
        for _ in range(copies[i]):
            ids = np.array(whole.encode(t, add_special_tokens=False).ids + [0], "<u4")
            want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, path).collect()]
    assert Counter(got) == Counter(want)


def test_stages_bear_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
