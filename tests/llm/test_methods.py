"""Methods of the operators against plain versions of them, and cases that each has to bear."""

import itertools
import math
import os
import re
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import common, decontaminate, hmm, mixing, neardup, quality, secrets, sharding, tokens, urls, winnow

ROOT = str(Path(__file__).resolve().parents[2])


def text(seed, n, words=400):
    return " ".join(f"w{k}" for k in np.random.default_rng(seed).integers(0, words, n))


def test_ftrl_against_plain_loops():
    r = np.random.default_rng(3)
    rows = [(np.sort(r.choice(40, 6, replace=False)), r.integers(1, 5, 6) / 3.0, int(r.integers(0, 2))) for _ in range(50)]
    alpha, beta, l1, l2, epochs = 0.7, 0.3, 0.2, 0.05, 3
    w, bias = quality.ftrl(rows, 64, alpha, beta, l1, l2, epochs)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if i != "bias" and abs(z[i]) <= l1:
            return 0.0
        pull = 0.0 if i == "bias" else math.copysign(l1, z[i])
        return -(z[i] - pull) / ((beta + math.sqrt(n[i])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            idx, x, y = rows[k]
            values = {**dict(zip(idx.tolist(), x.tolist(), strict=True)), "bias": 1.0}
            ws = {i: weight(i) for i in values}
            p = 1 / (1 + math.exp(-sum(ws[i] * v for i, v in values.items())))
            for i, v in values.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * ws[i]
                n[i] += g * g
    assert np.allclose(w, [weight(i) for i in range(64)]) and math.isclose(bias, weight("bias"), rel_tol=1e-9)


def test_score_is_a_sparse_dot_product(spark):
    r = np.random.default_rng(9)
    bits = 10
    model = quality.QualityModel(r.normal(0, 1, 1 << bits).astype(np.float32), 0.25, bits, 20.0)
    texts = [None, "", "a", "A b, c!! a a", text(1, 5000), "  \n ", "é😀 x1 _"]
    got = {x.k: x.p for x in quality.score(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), model, "p").collect()}
    for k, t in enumerate(texts):
        counts = Counter(quality.gram_ids(t, quality.Memo(), bits).tolist())
        dot = sum(float(model.weights[i]) * c / sum(counts.values()) for i, c in counts.items()) * 20 + 0.25
        assert math.isclose(got[k], 1 / (1 + math.exp(-dot)), rel_tol=1e-6)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secrets_ownership(spark):
    r = np.random.default_rng(4)
    hexes = ["".join(r.choice(list("0123456789abcdef"), 32)) for _ in range(6)]
    keys = ["".join(r.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), 40)) for _ in range(6)]
    forms = ["see {} here", "token={} and more", "\U0001f600 API_KEY: '{}'", "x{}", "{}\n{}", "AKIA" + "Q" * 16 + " {}", "aAKIA" + "9" * 30 + "{}", "secret:{}=="]
    rows = []
    for k in range(300):
        value = (hexes + keys)[int(r.integers(0, 12))] if k % 3 else "".join(r.choice(list("abcdefGHIJ0123456789"), 30))
        rows.append((k, forms[int(r.integers(0, len(forms)))].format(value, value), f"o{int(r.integers(0, 8))}"))
    rows += [(None, None, None), (300, "", "o1"), (301, "token=" + "a" * 5, None), (301, "token=" + "a" * 5, None), (302, "x " * 60_000 + "password = hunter22", "o2"), (303, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame([(*x, "clash", 1) for x in rows], "doc_id long, text string, source string, found string, kind int")
    owners, repos = defaultdict(set), defaultdict(set)
    for _, t, o in rows:
        for _, _, _, v in secrets.candidates(t or ""):
            owners[v].add(o)
            repos[v].add(t)
    want = []
    for i, t, _ in rows:
        t, found = t or "", []
        for k, s, e, v in secrets.candidates(t):
            example = len(owners[v]) >= 3 and len(repos[v]) >= 3
            if k < 3 or not example:
                found.append((secrets.KINDS[k], s, e, len(repos[v]), len(owners[v]), example))
        want.append((i or -1, tuple(found)))
        assert [(s, k, e) for k, s, e, _ in secrets.candidates(t) if k < 3] == base_spans(t)
    got = [(x.doc_id or -1, tuple((f.kind, f.start, f.end, f.repositories, f.owners, f.example) for f in x.findings)) for x in secrets.scan(docs).collect()]
    assert Counter(got) == Counter(want)
    assert any(f[5] for _, fs in got for f in fs) and any(f[0] == "key" for _, fs in got for f in fs)
    assert secrets.scan(docs.where("false")).count() == 0


def test_flow_against_all_flows():
    r = np.random.default_rng(8)
    for _ in range(40):
        sets = [("a",), ("b",), ("a", "b")]
        patterns = {"".join(s): (list(s), int(r.integers(0, 4))) for s in sets if r.random() < 0.8}
        targets = {"a": float(r.integers(0, 6)), "b": float(r.integers(0, 6))}
        best = None
        for given in itertools.product(*(range(2 * n + 1) for _, n in patterns.values())):
            cost = sum(max(0, g - n) for g, (_, n) in zip(given, patterns.values(), strict=True))  # the second pass over a pattern costs 1 a word
            own = {s: g for s, g in zip(patterns, given, strict=True)}
            a, b, both = own.get("a", 0), own.get("b", 0), own.get("ab", 0)
            if a <= targets["a"] and b <= targets["b"] and both <= targets["a"] - a + targets["b"] - b:
                best = max(best or (-1, 0), (sum(given), -cost))
        got = mixing.route(patterns, targets, 2)
        assert (sum(got.values()), -sum(max(0, got[p] - n) for p, (_, n) in patterns.items())) == best


def test_mix_of_overlapping_sources(spark):
    r = np.random.default_rng(12)
    member = [["a"], ["b"], ["a", "b"], ["b", "a"], ["c"], [None], ["c", None]]
    rows = [(k, text(k, int(r.integers(1, 60))), member[int(r.integers(0, len(member)))]) for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    taken, sources = mixing.shares(docs, members=F.col("sources"))
    got = taken.collect()
    size = sum(x["size"] for x in got)
    assert math.isclose(sum(x.target for x in sources.collect()), 1.5 * size, rel_tol=1e-9)  # documents of two sources count once in the whole
    assert abs(sum(x.taken for x in got) - 1.5 * size) < 0.01 * size
    of = {s.source: 0.0 for s in sources.collect()}
    for x in got:
        assert x.taken in (0, x["size"], 2 * x["size"]) and x.members == sorted(x.members, key=lambda s: (s is not None, s or ""))
        if len(x.members) == 1:
            of[x.members[0]] += x.taken
    for s in sources.collect():
        assert of[s.source] <= s.target + 60
    again = mixing.shares(docs.repartition(7), members=F.reverse("sources"))[0].collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_past_a_long_document(spark):
    rows = [(0, text(0, 20_000), "a")] + [(k, text(k, 50), "a") for k in range(1, 401)] + [(k, text(k, 100), "b") for k in range(401, 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, sources = mixing.shares(docs, cycle=(1, 40))
    words = {r[0]: r[1] for r in taken.groupBy(F.col("members")[0]).agg(F.sum("taken")).collect()}
    for s in sources.collect():
        assert abs(words[s.source] - s.target) <= 50, (s, words)


def links_of(texts, n=5):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    where = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            where[x].append(k)
    out = set()
    for k, s in enumerate(sets):
        for j, c in Counter(j for x in s for j in where[x] if j < k).items():
            if 5 * c >= 4 * (len(s) + len(sets[j]) - c):
                out.add((j, k))
    return out


def near_family(seed, size, n, changes):
    """Texts that differ from a base by a few words, many at likeness close to 0.8."""
    r, base = np.random.default_rng(seed), text(seed, n, 5000).split()
    out = []
    for k in range(size):
        t = list(base)
        for p in r.choice(n, changes, replace=False):
            t[p] = f"c{seed}x{k}x{p}"
        out.append(" ".join(t))
    return out


def checked_classes(spark, texts, least):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in neardup.classes(docs).collect()}
    links, n = links_of(texts), Counter()
    root = list(range(len(texts)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        n[a] += 1
        n[b] += 1
        root[max(top(a), top(b))] = min(top(a), top(b))
    assert all(got[k].n_links <= n[k] for k in got)  # none that isn't one
    found = sum(x.n_links for x in got.values())
    assert found >= least * 2 * len(links), (found, 2 * len(links))
    if least == 1:
        assert all(got[k].class_id == top(k) for k in got)
    return len(links), found / 2


def test_recall_of_near_families(spark):
    texts = [t for s in range(60) for t in near_family(s, 6, 100 + 3 * s, 2)] + [t for s in range(100, 140) for t in near_family(s, 2, 90, 1)] + [text(s, 80) for s in range(300, 500)]
    links, found = checked_classes(spark, texts, 0.99)
    print(f"{found} of {links} links found, {found / links:.4f}")
    assert links > 300


def test_salted_nodes_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "NODE", 8)
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", 5)
    texts = near_family(1, 60, 300, 2) + near_family(2, 30, 40, 1) + ["a b"] * 20 + [text(9, 50)] * 3 + [None, "", " "]
    checked_classes(spark, texts, 1)


def test_depth_of_small_sets():
    for n in range(1, 60):
        want = min((c / (n + m - c) for m in range(1, 100) for c in range(1, min(n, m) + 1) if not c == n == m and 5 * c >= 4 * (n + m - c)), default=1.0)
        assert math.isclose(neardup.least_likeness(n, 4, 5), want)
    assert neardup.depth_for(1.0, 32, 8, 0.999) == 8 and neardup.depth_for(0.8, 32, 8, 0.999) == 7
    below = np.array([[1, 1], [1, 2], [1, 2], [3, 1], [3, 1]], ">u4")
    assert sorted(neardup.climbed(below, np.array([8, 8, 8, 8, 8]), 6)) == [(1, 3), (3, 5)]  # whole signatures
    assert sorted(neardup.climbed(below, np.array([7, 8, 8, 8, 8]), 6)) == [(0, 3), (3, 5)]  # the first text shortens by one
    assert sorted(neardup.climbed(below, np.array([8, 8, 8, 8, 6]), 6)) == [(0, 5)]


def test_large_common_counts_are_exact():
    x = [np.arange(0, 400_000, dtype=np.uint64), np.arange(44_444, 444_444, dtype=np.uint64), np.arange(44_445, 444_445, dtype=np.uint64)]
    import pyarrow as pa

    names = ["comp", "i", "j", "uid", "copies", "block", "x"]
    columns = [pa.array([1] * 3), pa.array([0] * 3), pa.array([0] * 3), pa.array([7, 8, 9]), pa.array([1, 1, 1]), pa.array([0] * 3), pa.array([v.tobytes() for v in x], pa.binary())]
    out = next(iter(neardup.verify(iter([pa.RecordBatch.from_arrays(columns, names=names)]), 4, 5)))
    links = {a: n for a, b, n in zip(*(out.column(k).to_pylist() for k in range(3)), strict=True) if b is None}
    pairs = [(a, b) for a in range(3) for b in range(3) if a < b and 5 * len(np.intersect1d(x[a], x[b])) >= 4 * len(np.union1d(x[a], x[b]))]
    assert links == {k: n for k, n in Counter(7 + i for p in pairs for i in p).items()}


def test_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", 0.5, 1, "x")], "doc_id long, text string, source string, score double, slot int, found string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    model = quality.QualityModel(np.zeros(4, np.float32), 0.0, 2, 1.0)
    for call in (lambda: quality.score(docs, model), lambda: sharding.place(docs, ["a"], slots=2), lambda: decontaminate.contamination(docs, items), lambda: decontaminate.contamination(docs, items.where("false"), out="SCORE")):
        with pytest.raises(ValueError):
            call()
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and decontaminate.remove_contaminated(docs, items).columns == docs.columns
    assert decontaminate.remove_contaminated(docs, items).count() == 0 and neardup.keep_one(docs).collect() == docs.collect()


@pytest.mark.parametrize("weights, names", [([0, 0], ["a", "b"]), ([1], ["a", "b"]), ([-1, 2], ["a", "b"]), (None, ["a", "b", "c"])])
def test_shards_that_cannot_be(weights, names):
    with pytest.raises(ValueError):
        sharding.fill(names, 2, weights)


def test_shards_take_turns():
    names, slots = [f"s{k}" for k in range(5)], 103
    orders = []
    for n in names:
        start, step = sharding._draw(n, "start", slots), sharding._draw(n, "step", slots - 1) + 1
        orders.append([(start + k * step) % slots for k in range(slots)])
        assert len(set(orders[-1])) == slots  # a permutation
    owner = [None] * slots
    while None in owner:
        for k, order in enumerate(orders):
            free = next((s for s in order if owner[s] is None), None)
            if free is not None:
                owner[free] = k
    assert sharding.fill(names, slots) == owner
    weighted = Counter(sharding.fill(names, slots, [1, 1, 2, 0, 1]))
    assert weighted[3] == 0 and abs(weighted[2] - 2 * weighted[0]) <= 2


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, n_chars long, extra string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(docs, labels, bits=8)
    assert quality.score(docs, model).count() == 0 and quality.keep_good(docs, labels).count() == 0
    assert secrets.scan(docs).count() == 0 and sharding.place(docs, ["a", "b"], slots=13).count() == 0 and winnow.edits(docs).count() == 0
    assert hmm.score(docs, held_out=F.lit(False)).count() == 0
    assert decontaminate.contamination(docs, docs.select(F.col("doc_id").alias("item_id"), "text")).count() == 0
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string, host string"), ()).count() == 0
    assert mixing.mix(docs).count() == 0 and neardup.keep_one(docs).count() == 0 and tokens.digests(spark, docs).count() == 0


def test_hard_rows(spark):
    """Nulls in every column, empty, long and repeated texts, for every operator that takes documents."""
    long = text(5, 120_000)
    rows = [(None, None, None), (None, None, None), (1, "", "a"), (2, long, None), (2, long, None), (3, long + " end", "b"), (4, "  x\x00y", "b"), (4, "z" * 300_000, "a")]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, source string, size string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    model = quality.train(docs, labels, bits=10)
    for out in (quality.score(docs, model), secrets.scan(docs), sharding.place(docs, ["a", "b"], slots=13), winnow.edits(docs), hmm.score(docs, held_out=F.col("doc_id") == 3), decontaminate.contamination(docs, labels.select(F.col("doc_id").alias("item_id"), F.lit(None).cast("string").alias("text"))), mixing.shares(docs)[0], neardup.classes(docs), tokens.digests(spark, docs)):
        assert len(out.collect()) == len(rows)
    by = {(r.doc_id, r.n): r for r in neardup.classes(docs).collect()}
    assert {r.class_id for (i, n), r in by.items() if i in (2, 3)} == {2}
    same = {r.doc_id: r.score for r in hmm.score(docs, held_out=F.col("doc_id") == 3).collect() if r.doc_id == 2}
    assert same and all(math.isfinite(x) for x in same.values())


def test_sequences_and_masks(spark, tmp_path):
    docs = spark.createDataFrame([(k, text(k, 7 + k)) for k in range(20)], "doc_id long, text string")
    files = tokens.write(docs, f"file://{tmp_path}/t", shards=2, seq_len=16, rows=4)
    flat = [i for r in tokens.read_documents(spark, files).orderBy("start").collect() for i in np.frombuffer(r.ids, "<u4").tolist()]
    got = []
    for part in range(2):
        seqs = []
        for k in itertools.count():
            try:
                seqs.append(tokens.sequence(files, part, k))
            except (IndexError, ValueError, KeyError):
                break
        ids, mask = (np.concatenate([np.asarray(s[j]) for s in seqs]) for j in (0, 1))
        n = int(mask.sum())
        assert mask[:n].all() and not mask[n:].any() and len(mask) - n < 16  # padded at a part's end only
        got += ids[mask.astype(bool)].tolist()
    assert got == flat


def test_written_tables_can_be_cleared(spark):
    table = common.materialise(spark.range(3), "test")
    path = table.inputFiles()[0].removeprefix("file:")
    assert os.path.exists(path)
    common.clear(spark)
    assert not os.path.exists(path)


SCRIPT = """
import sys
sys.path.insert(0, {root!r})  # the driver has the package, workers don't
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
def there(batches):
    import importlib.util
    import pandas as pd
    for b in batches:
        yield pd.DataFrame({{"x": [importlib.util.find_spec("folioscope") is not None]}})
assert not any(r.x for r in spark.range(4).mapInPandas(there, "x boolean").collect())
for name, f in __spark_entry__.queries().items():
    if name[:2] == "op" and name[2].isdigit() or name == "pipeline":
        assert f(spark, "/root/testdata/sf0.001").count(), name
        print(name, "ran")
"""


def test_workers_need_no_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    keep = [p for p in os.environ.get("PYTHONPATH", "").split(":") if p and not os.path.exists(f"{p}/folioscope")]
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], cwd=tmp_path, env=env | {"PYTHONPATH": ":".join(keep)}, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.count(" ran") == 11
