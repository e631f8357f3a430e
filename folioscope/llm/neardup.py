"""N-gram Jaccard join with a MinHash LSH forest, then exact verification.

Texts are sets of n-word shingles (lower-cased A-Z, words between ASCII white
space; fewer words make one shingle). Each distinct text has a signature of depth
minima in each tree. A tree is a trie of its sorted signatures. Each text's search
starts at its whole signatures and shortens the matched prefix until the chance to
meet any text that it can be linked to reaches the target recall: the least
likeness at or above the threshold that a set of its size can have sets how far, so
small sets stop at longer prefixes. What shares the prefix are its candidates.

Candidates are never listed as pairs. In each trie node texts of an estimated
likeness of 0.71 and more (0.8 less three and a half standard errors) are connected
and each is tied to the least text it is connected with. What these ties connect is
compared exactly, in blocks of bounded size, which report counts of links and trees
of bounded degree that connect what is linked, never all pairs. Components of
these trees are the classes. Nodes of many texts are salted into parts before they
are shuffled, all of which hold the node's least text; texts that are not connected
with it go to all parts in a second pass.

Cases: texts without words have no shingles, are alone and have no links; exact
copies (equal words) are one text; rows that repeat id and text count as copies;
null ids are kept and never name a class unless all its ids are null; further
columns are not touched; an empty table gives no rows; a text of any length is a
set of shingles in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import array_slices, coded_words, materialise, sent, small_batches, text_key, tidied

#: Shingles and texts of a block of exact comparison.
BLOCK_SHINGLES, BLOCK_TEXTS = 1_000_000, 768
#: Bytes of texts whose words are held at once.
SLICE = 2_000_000
#: Members of a forest node beyond which it is salted.
NODE = 4096
ALIKE = 0.71


def depth_for(likeness: float, trees: int, most: int, target: float) -> int:
    """The longest prefix by which texts of that likeness meet in some tree with chance target."""
    d = most
    while d > 1 and 1 - (1 - likeness**d) ** trees < target:
        d -= 1
    return d


def least_likeness(n: int, num: int, den: int) -> float:
    """The least likeness, num / den or more, of a set of n elements and any other set; 1 where only equal sets reach it."""
    if n * (den - num) >= den * num:
        return num / den
    unions = range(max(1, n), n * den // num + 1)
    return min((c / u for u in unions if (c := -(-num * u // den)) <= n and not c == u == n), default=1.0)


def word_hashes(texts: pa.Array) -> list[np.ndarray]:
    """64-bit hashes of each text's words, in order."""
    words, codes, bounds = coded_words(texts)
    h = np.append(pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False), np.uint64(0))[codes]
    return [h[s : e - 1] for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of words' hashes h; fewer words make one shingle."""
    if not len(h):
        return h
    n = min(n, len(h))
    x = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        x ^= h[k : k + len(x)]
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x.sort()
    return x[np.append(True, x[1:] != x[:-1])]


class Forest:
    def __init__(self, trees: int, depth: int, base: int) -> None:
        r = np.random.default_rng(20)
        self.trees, self.depth, self.base = trees, depth, base
        self.a = r.integers(1 << 63, size=trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.mix = r.integers(1 << 63, size=(trees, base), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def minima(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), np.uint64(0xFFFFFFFFFFFFFFFF))
        for k in range(0, len(x), 128):  # rows by minima, so that the least are found along whole rows
            np.minimum(out, (x[k : k + 128, None] * self.a).min(axis=0), out=out)
        return out >> np.uint64(32)

    def nodes(self, minima: np.ndarray) -> np.ndarray:
        """Of each tree, the trie node of the shortest prefix that any search comes down to, as one number."""
        m = minima.reshape(self.trees, self.depth)[:, : self.base]
        x = (m * self.mix).sum(axis=1, dtype=np.uint64) + np.arange(self.trees, dtype=np.uint64) * np.uint64(0x94D049BB133111EB)
        x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ x >> np.uint64(30)).view(np.int64)

    def below(self, minima: np.ndarray) -> bytes:
        """Of each tree, the minima below that node, in bytes that sort as they do."""
        return minima.reshape(self.trees, self.depth)[:, self.base :].astype(">u4").tobytes()


def sketch(docs: DataFrame, n: int, forest: Forest, wanted) -> DataFrame:
    """doc_id, tk (the row's key), digest (of its words), n (shingles), depth (wanted of n), nodes, below and sig of each row, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tidied(batches):
            digests, counts, depths, nodes, below, sigs = [], [], [], [], [], []
            for texts in array_slices(b.column("text"), SLICE):
                for h in word_hashes(texts):
                    x = shingles(h, n)
                    digests.append(hashlib.md5(h).digest())
                    counts.append(len(x))
                    depths.append(wanted(len(x)))
                    m = forest.minima(x)
                    nodes.append(forest.nodes(m) if len(x) else np.empty(0, np.int64))
                    below.append(forest.below(m))
                    sigs.append(m.astype(np.uint8).tobytes())
            ends = np.cumsum([0, *map(len, nodes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(nodes)))
            columns = {"doc_id": b.column("doc_id"), "tk": b.column("tk"), "digest": pa.array(digests, pa.binary()), "n": pa.array(counts, pa.int64()), "depth": pa.array(depths, pa.int32()), "nodes": lists, "below": pa.array(below, pa.binary()), "sig": pa.array(sigs, pa.binary())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = docs.select("doc_id").schema.add("tk", "binary").add("digest", "binary").add("n", "long").add("depth", "integer").add("nodes", ArrayType(LongType())).add("below", "binary").add("sig", "binary")
    return materialise(docs.select("doc_id", text_key().alias("tk"), "text").mapInArrow(run, schema), "near-sketch")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of rows that share keys, over batches in which such rows are neighbours."""
    now, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy() for k in keys]
        new = np.zeros(b.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(int(c[s]) for c in columns)
            if key != now:
                if held:
                    yield now, held
                now, held = key, []
            held.append(b.slice(s, e - s))
    if held:
        yield now, held


def climbed(below: np.ndarray, depths: np.ndarray, base: int) -> Iterator[tuple[int, int]]:
    """Runs of sorted rows of a trie node that share the prefix down to which a text of the run shortens its own."""
    runs = [(0, len(depths), base)]
    while runs:
        s, e, level = runs.pop()
        if e - s < 2:
            continue
        if level - base == below.shape[1] or depths[s:e].min() <= level:
            yield s, e
        else:
            x = below[s:e, level - base]
            cuts = [s, *(np.flatnonzero(x[1:] != x[:-1]) + s + 1).tolist(), e]
            runs += [(a, b, level + 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def likeness(sigs: np.ndarray, leader: np.ndarray) -> np.ndarray:
    """Estimates from one byte of each minimum."""
    return ((sigs == leader).mean(axis=1) - 1 / 256) / (1 - 1 / 256)


EDGE = "a long, b long, node long"


class Edges:
    """Rows of EDGE, sent when there are enough."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, a: np.ndarray, b: np.ndarray, node: int | None = None) -> None:
        self.parts.append((a, b, np.full(len(b), node or 0), np.full(len(b), node is None)))
        self.held += len(b)

    def sent(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if self.held > least:
            a, b, node, none = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            self.parts, self.held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(node, mask=none)], names=["a", "b", "node"])


def matrix(column: pa.ChunkedArray, dtype: str, rows: int) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype).reshape(rows, -1) if raw else np.empty((rows, 0), dtype)


def connected(sigs: np.ndarray) -> np.ndarray:
    """Of texts, the first one that chains of likeness connect each with: a text is compared with those not yet reached."""
    root, left = np.arange(len(sigs)), np.arange(len(sigs))
    while len(left):
        queue, first, left = [int(left[0])], left[0], left[1:]
        while queue and len(left):
            near = likeness(sigs[left], sigs[queue.pop()]) >= ALIKE
            root[left[near]] = first
            queue += left[near].tolist()
            left = left[~near]
    return root


def tie(batches: Iterator[pa.RecordBatch], base: int) -> Iterator[pa.RecordBatch]:
    """Of each trie node (or part of a salted one): texts with the least they are connected with; and, with the node, those of a salted one not connected with its least."""
    out = Edges()
    for (node, _, parts), rows in grouped(batches, ["node", "part", "parts"]):
        t = pa.Table.from_batches(rows)
        if parts > 1:  # the least text, which all parts of the node hold, comes first
            t = t.take(pa.array(np.unique(t["uid"].to_numpy(), return_index=True)[1]))
        ids, sigs = t["uid"].to_numpy(), matrix(t["sig"], "u1", t.num_rows)
        for s, e in [(0, len(ids))] if parts > 1 else climbed(matrix(t["below"], ">u4", t.num_rows), t["depth"].to_numpy(), base):
            name, root = ids[s:e], connected(sigs[s:e])
            tied = root != np.arange(e - s)
            out.add(name[root[tied]], name[tied])
            if parts > 1:
                out.add(name[root > 0], name[root > 0], node)
        yield from out.sent(50_000)
    yield from out.sent()


def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part of a salted node: its texts tied to those sent to all parts (they come first) that they are like."""
    out = Edges()
    for _, rows in grouped(batches, ["node", "part"]):
        t = pa.Table.from_batches(rows)
        ids, sigs, all_ = t["uid"].to_numpy(), matrix(t["sig"], "u1", t.num_rows), t["to_all"].to_numpy().astype(bool)
        texts, x = ids[~all_], sigs[~all_]
        for k in np.flatnonzero(all_):
            near = likeness(x, sigs[k]) >= ALIKE
            out.add(np.full(np.count_nonzero(near), ids[k]), texts[near])
            yield from out.sent(50_000)
    yield from out.sent()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """id and root (the least id of its component) of every node of edges (a, b), by large and small stars."""
    e = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "near-edges")
    state = None
    for _ in range(most):
        both = e.union(e.select("v", "u"))
        low = sent(materialise(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "near-low"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "near-large")
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "near-low")
        small = large.join(sent(low), "u")
        e = materialise(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "near-stars")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            return e.select(F.col("u").alias("id"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        state = now
    raise RuntimeError("components did not settle")


def verify(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """For each block pair: (a, b) of trees that connect what is linked, and (a, null, number of documents linked)."""

    def linked_texts(x: list[np.ndarray], strip: int = 256) -> np.ndarray:
        """Which texts are linked, by their common shingles; products of strips, so that little is held at once."""
        flat = np.concatenate(x)
        flat.sort()
        often = flat[1:][flat[1:] == flat[:-1]]
        often = often[np.append(True, often[1:] != often[:-1])] if len(often) else often
        row = np.repeat(np.arange(len(x), dtype=np.int32), [len(v) for v in x])
        flat = np.concatenate(x)
        column = np.searchsorted(often, flat).astype(np.int32)
        held = column < len(often)
        held[held] = often[column[held]] == flat[held]
        row, column = row[held], column[held]
        by = np.argsort(column, kind="stable")
        row, column = row[by], column[by]
        common = np.zeros((len(x), len(x)), np.int32)
        step = max(64, 3_000_000 // len(x))  # below the numbers that float32 counts exactly
        for k in range(0, len(often), step):
            lo, hi = np.searchsorted(column, [k, k + step])
            m = np.zeros((len(x), step), np.float32)
            m[row[lo:hi], column[lo:hi] - k] = 1
            for s in range(0, len(x), strip):
                common[s : s + strip] += (m[s : s + strip] @ m.T).astype(np.int32)
        size = np.array([len(v) for v in x])
        out = np.zeros(common.shape, bool)
        for s in range(0, len(x), strip):
            out[s : s + strip] = common[s : s + strip].astype(np.int64) * (num + den) >= num * (size[s : s + strip, None] + size[None, :])
        np.fill_diagonal(out, False)
        return out

    for (_, i, j), parts in grouped(batches, ["comp", "i", "j"]):
        t = pa.Table.from_batches(parts)
        t = t.take(pa.array(np.unique(t["uid"].to_numpy(), return_index=True)[1]))
        if t.num_rows < 2:
            continue
        x, ids, block = [np.frombuffer(v, np.uint64) for v in t["x"].to_pylist()], t["uid"].to_numpy(), t["block"].to_numpy()
        linked = linked_texts(x)
        if i != j:
            linked &= block[:, None] != block[None, :]
        links = np.array([int(t["copies"].to_numpy()[n].sum()) for n in linked])
        seen, a, b = np.zeros(len(x), bool), [], []
        for s in np.flatnonzero(links):
            if seen[s]:
                continue
            seen[s], queue, met = True, [s], []
            while queue:
                u = queue.pop()
                met.append(u)
                new = np.flatnonzero(linked[u] & ~seen)
                seen[new] = True
                queue += new.tolist()
            names = ids[met]
            a += names[1:].tolist()
            b += names[(np.arange(1, len(met)) - 1) // 2].tolist()
        told = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(a + ids[told].tolist(), pa.int64()), pa.array(b + [None] * len(told), pa.int64()), pa.array([0] * len(a) + links[told].astype(np.int64).tolist(), pa.int64())], names=["a", "b", "links"])


def met_in_forest(texts: DataFrame, forest: Forest, parts: int) -> DataFrame:
    """Edges (a, b) that connect what is alike in any trie node."""
    member = texts.select("uid", F.posexplode("nodes").alias("tree", "node"))
    full = member.groupBy("node").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("uid")).alias("x"), F.min("uid").alias("low")).where("size > 1")
    full = full.groupBy("size", "x", "low").agg(F.min("node").alias("node"))  # of nodes that hold the same texts, one
    ways = F.when(F.col("size") > NODE, F.ceil(F.col("size") / F.lit(NODE / 2))).otherwise(1).cast("long")
    full = materialise(full.select("node", ways.alias("parts"), "low"), "near-nodes")
    salted = materialise(full.where("parts > 1"), "near-salted")
    width = 4 * (forest.depth - forest.base)
    below = F.substring("below", F.col("tree") * width + 1, F.lit(width)).alias("below")
    met = member.join(sent(full.drop("low")), "node").withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    lows = salted.select("node", "parts", F.col("low").alias("uid"), each).select("uid", F.lit(0).alias("tree"), "node", "parts", "part")
    met = met.select("uid", "tree", "node", "parts", "part").union(lows)
    met = met.join(texts.select("uid", "depth", "sig", "below"), "uid").select("node", "part", "parts", "uid", "depth", below, "sig")
    rows = met.repartition(parts, "node", "part").sortWithinPartitions("node", "part", "below", "uid")
    tied = materialise(rows.mapInArrow(lambda batches: tie(tidied(batches), forest.base), EDGE), "near-tied")
    edges = tied.where("node is null").select("a", "b")
    if salted.isEmpty():
        return edges
    alone = tied.where("node is not null").select("node", F.col("a").alias("uid")).distinct().join(sent(salted.drop("low")), "node").join(texts.select("uid", "sig"), "uid")
    alone = alone.select("node", each, "uid", "sig", F.lit(1).alias("to_all"))
    rows = alone.union(met.where("parts > 1").select("node", "part", "uid", "sig", F.lit(0))).repartition(parts, "node", "part").sortWithinPartitions("node", "part")
    return edges.union(materialise(rows.mapInArrow(lambda batches: link(tidied(batches)), EDGE), "near-linked").select("a", "b"))


def classes(docs: DataFrame, *, words: int = 5, similarity: tuple[int, int] = (4, 5), trees: int = 32, depth: int = 8, target: float = 0.999) -> DataFrame:
    """A row for each row of docs: doc_id, tk, n (shingles), class (a number), class_id (its least doc_id) and n_links.

    n_links counts the documents that a document is linked to, copies included.
    similarity is a fraction, so the comparison with it is exact.
    """
    spark = docs.sparkSession
    small_batches(spark, 1000)
    num, den = similarity
    forest = Forest(trees, depth, depth_for(num / den, trees, depth, target))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    depths = [depth_for(least_likeness(n, num, den), trees, depth, target) for n in range(den * num + 1)]  # larger sets search as deep as the last
    rows = sketch(docs, words, forest, lambda n: depths[min(n, len(depths) - 1)])
    of_text = [F.first(c).alias(c) for c in ("n", "depth", "nodes", "below", "sig")]
    texts = rows.where("n > 0").groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"), F.min("tk").alias("tk"), *of_text)
    texts = materialise(texts.withColumn("uid", F.monotonically_increasing_id()), "near-texts")
    met = components(met_in_forest(texts, forest, parts))

    # exact comparison within what is connected, in blocks
    known = met.select(F.col("id").alias("uid"), F.col("root").alias("comp")).join(texts.select("uid", "tk", "n", "copies"), "uid")
    known = materialise(known, "near-known")
    sized = known.groupBy("comp").agg(F.greatest(F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)), F.ceil(F.count("*") / F.lit(BLOCK_TEXTS))).alias("blocks"))
    known = known.join(sent(materialise(sized, "near-sized")), "comp").withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks"))).drop("n")
    known = materialise(known, "near-blocks")

    kept = ["uid", "comp", "copies", "blocks", "block"]

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # rows that repeat id and text are one text: it is sent once a task
        for b in tidied(batches):
            at = 0
            for texts in array_slices(b.column("text"), SLICE):
                part, at = b.slice(at, len(texts)), at + len(texts)
                part = part.take(pa.array([k for k, u in enumerate(part.column("uid").to_pylist()) if u not in done and not done.add(u)], pa.int64()))
                x = [shingles(h, words).tobytes() for h in word_hashes(part.column("text"))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(x, pa.binary())], names=[*kept, "x"])

    sets = docs.select(text_key().alias("tk"), "text").join(sent(known), "tk").select(*kept, "text").mapInArrow(shingled, "uid long, comp long, copies long, blocks long, block long, x binary")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = sets.select("comp", "uid", "block", "copies", "x", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    chosen = dealt.drop("other").repartition(parts, "comp", "i", "j").sortWithinPartitions("comp", "i", "j", "uid")
    found = materialise(chosen.mapInArrow(lambda batches: verify(tidied(batches), num, den), "a long, b long, links long"), "near-links")

    root = components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy(F.col("a").alias("uid")).agg(F.sum("links").alias("links"))
    named = (
        texts.select("uid", "digest", "first", "copies").join(root, F.col("uid") == F.col("id"), "left").withColumn("class", F.coalesce("root", "uid"))
        .join(links, "uid", "left").select("digest", "class", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    named = materialise(named, "near-named")
    least = materialise(named.groupBy("class").agg(F.min("first").alias("class_id")), "near-least")
    named = materialise(named.drop("first").join(sent(least), "class"), "near-classed")
    out = rows.select("doc_id", "tk", "digest", "n").join(sent(named), "digest", "left")
    return out.select("doc_id", "tk", "n", "class", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each class, that of the least doc_id; columns as they were."""
    found = materialise(classes(docs, **options), "near-classes").where("n > 0")
    kept = found.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "tk")).alias("k")).select("class", F.col("k.tk").alias("kept"))
    judged = found.join(sent(materialise(kept, "near-kept")), "class")
    dropped = materialise(judged.where("tk <> kept").select(F.col("tk").alias("__fs_tk")).distinct(), "near-dropped")
    twice = materialise(judged.where("tk = kept").groupBy(F.col("tk").alias("__fs_tk")).count().where("count > 1").select("__fs_tk"), "near-twice")
    columns = docs.columns
    keyed = docs.withColumn("__fs_tk", text_key()).join(sent(dropped), "__fs_tk", "left_anti")
    if not twice.isEmpty():
        again = sent(twice)
        keyed = keyed.join(again, "__fs_tk", "left_anti").unionByName(keyed.join(again, "__fs_tk", "left_semi").dropDuplicates(["__fs_tk"]))
    return keyed.select(*columns)
