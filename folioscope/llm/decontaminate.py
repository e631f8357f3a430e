"""Benchmark decontamination with suffix arrays of the training shards.

Each block of documents in a task is a shard: its words become numbers, its
suffixes that could begin a match are sorted, and every suffix of every
benchmark item is looked up by binary search. What lies between the two bounds
are all occurrences; runs of them on a diagonal are the longest verbatim
matches. Words are lower-cased (A-Z) runs of digits, letters and anything
beyond ASCII; suffixes are compared over window words.

The benchmark reaches the tasks in blocks of at most block_chars characters, which
a shard is searched for one after the other; a worker holds all of them, so the
benchmark (not the documents) must fit there, about 100 bytes a word.

Cases: null and empty texts have no words and are clean; items without words
never match; items that repeat a text all count; an item shorter than the
window is one window; ids of items may repeat and count once, null ids count as
the empty id; repeated documents are reported each; long texts are searched as a
whole; a column of the result's name raises, other columns are kept; an empty
table gives no rows and an empty benchmark no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_of, small_batches, tidied

#: Each byte's lower-case form if it is part of a word, else a space.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


#: Benchmark items made ready for search, as tasks get them (plain values): ids (of the items of each text), vocabulary,
#: and of each window its low and high keys, length, item (text) and offset.
Block = tuple[list[list[str]], dict[bytes, int], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def prepare(items: list[tuple[str, list[bytes]]], window: int) -> Block:
    ids: list[list[str]] = []
    texts: dict[tuple[bytes, ...], int] = {}
    for item_id, w in items:
        if w:
            k = texts.setdefault(tuple(w), len(texts))
            if k == len(ids):
                ids.append([])
            ids[k].append(item_id)
    vocabulary: dict[bytes, int] = {}
    for w in texts:
        for x in w:
            vocabulary.setdefault(x, len(vocabulary) + 1)
    spans = [(k, p, min(window, len(w))) for w, k in texts.items() for p in range(max(1, len(w) - window + 1))]
    low, high = np.zeros((len(spans), window), ">u4"), np.full((len(spans), window), 0xFFFFFFFF, ">u4")
    coded = [np.array([vocabulary[x] for x in w], ">u4") for w in texts]
    for row, (k, p, n) in enumerate(spans):
        low[row, :n] = high[row, :n] = coded[k][p : p + n]
    item, offset, length = np.array(spans, np.int64).reshape(-1, 3).T
    return ids, vocabulary, *(x.reshape(-1).view(f"S{4 * window}") for x in (low, high)), length, item, offset


def search(texts: list[str | None], block: Block, window: int) -> tuple[list[int], list[np.ndarray], list[list[tuple[int, int, int, int]]]]:
    """Of each text: its number of words, the places of hit words, and (item, offset, place, length) of the longest matches."""
    _, vocabulary, low, high, lengths, items, offsets = block
    get = vocabulary.get
    coded, bounds = [], [0]
    for t in texts:
        coded.append(np.array([get(w, 0) for w in words(t)] + [0], np.uint32))  # 0: a word no item has, or a text's end
        bounds.append(bounds[-1] + len(coded[-1]))
    flat, edges = np.concatenate(coded), np.array(bounds)
    counts = (np.diff(edges) - 1).tolist()
    none = [np.empty(0, np.int64)] * len(texts), [[] for _ in texts]
    if not len(lengths):
        return counts, *none
    breaks = np.flatnonzero(flat == 0)
    known = np.flatnonzero(flat)
    run = breaks[np.searchsorted(breaks, known)] - known
    starts, run = known[run >= lengths.min()], run[run >= lengths.min()]
    if not len(starts):
        return counts, *none
    within = np.arange(window)
    keys = np.where(within < run[:, None], flat[np.minimum(starts[:, None] + within, len(flat) - 1)], 0).astype(">u4").reshape(-1).view(f"S{4 * window}")
    order = np.argsort(keys, kind="stable")
    suffixes, keys = starts[order], keys[order]  # the shard's suffix array
    lo, hi = np.searchsorted(keys, low, "left"), np.searchsorted(keys, high, "right")
    found = np.flatnonzero(hi > lo)
    n = (hi - lo)[found]
    at = np.repeat(found, n)
    places = suffixes[np.repeat(lo[found], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    item, offset, length = items[at], offsets[at], lengths[at]
    cover = np.zeros(len(flat) + 1, np.int64)
    np.add.at(cover, places, 1)
    np.add.at(cover, places + length, -1)
    hit = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
    doc_of_hit = np.searchsorted(edges, hit, "right") - 1
    hits = [h - edges[i] for i, h in enumerate(np.split(hit, np.searchsorted(doc_of_hit, np.arange(1, len(texts)))))]
    matches: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    if len(places):
        doc = np.searchsorted(edges, places, "right") - 1
        by = np.lexsort((places, places - offset, item, doc))
        doc, item, offset, places, length = (x[by] for x in (doc, item, offset, places, length))
        new = np.ones(len(by), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (places[1:] - offset[1:] != places[:-1] - offset[:-1]) | (places[1:] != places[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(by)) - 1
        for d, k, o, p, e in zip(doc[first].tolist(), item[first].tolist(), offset[first].tolist(), places[first].tolist(), (places[last] + length[last]).tolist(), strict=True):
            matches[d].append((k, o, p - int(edges[d]), e - p))
    return counts, hits, matches


FOUND = "struct<n_words:bigint,hits:array<int>,matches:array<struct<item_id:string,item_start:int,start:int,length:int>>>"


def _found(blocks: list[Block], window: int, spark, text: Column) -> Column:
    small_batches(spark)
    sent = [spark.sparkContext.broadcast(b) for b in blocks]
    match = pa.struct([("item_id", pa.string()), ("item_start", pa.int32()), ("start", pa.int32()), ("length", pa.int32())])

    def united(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, list[dict]]]:
        places, named, counts = [[] for _ in texts], [[] for _ in texts], []
        for b in sent:
            counts, hits, matches = search(texts, b.value, window)
            for i, (h, m) in enumerate(zip(hits, matches, strict=True)):
                if len(h):
                    places[i].append(h)
                    named[i] += [{"item_id": x, "item_start": o, "start": p, "length": n} for k, o, p, n in m for x in b.value[0][k]]
        for i, n in enumerate(counts):
            yield n, np.unique(np.concatenate(places[i])) if places[i] else np.empty(0, np.int64), named[i]

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in tidied(parts):
            out: list[tuple] = []
            texts: list[str | None] = []
            size = 0
            for i in range(len(col)):
                texts.append(col[i].as_py())
                size += len(texts[-1] or "")
                if size > 6_000_000 or i == len(col) - 1:
                    out += united(texts)
                    texts, size = [], 0
            counts, hits, named = zip(*out, strict=True) if out else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(named, pa.list_(match))], names=["n_words", "hits", "matches"])

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, FOUND)(text)


def blocks_of(benchmark: DataFrame, window: int, block_chars: int) -> Iterator[Block]:
    items, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string"), "text").orderBy("item_id", "text").toLocalIterator():
        items.append((r[0] or "", words(r[1])))
        size += len(r[1] or "")
        if size >= block_chars:
            yield prepare(items, window)
            items, size = [], 0
    if items:
        yield prepare(items, window)


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, block_chars: int = 4_000_000, out: str = "found") -> DataFrame:
    """docs with column out: n_words, hits (places of hit words) and matches (item_id, item_start, start, length)."""
    free_of(docs, out)
    blocks = list(blocks_of(benchmark, window, block_chars)) or [prepare([], window)]
    return docs.withColumn(out, _found(blocks, window, docs.sparkSession, F.col("text")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those in which any window of an item occurs; columns as they were."""
    return contamination(docs, benchmark, out="__fs_found", **options).where(F.size("__fs_found.hits") == 0).drop("__fs_found")
