"""Scores and exact best hits of many questions within a block of documents or vectors (numpy); only these leave the block."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Places of asked tokens, vectors, and queries that a worker holds at once; rows of a batch it returns.
PLACES, VECTORS, QUERIES, ROWS = 2_000_000, 32_768, 64, 100_000


def rounded(score: np.ndarray, places: int) -> np.ndarray:
    """Half up by the shortest decimal of a number, as Spark rounds."""
    with np.errstate(invalid="ignore"):
        scaled = score * 10.0**places
        out = np.floor(scaled + 0.5)
        for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3 + 1e-15 * np.abs(scaled)):
            out[i] = float(Decimal(repr(float(score[i]))).scaleb(places).to_integral_value(ROUND_HALF_UP))
        return out / 10.0**places


def best(score: np.ndarray, order: np.ndarray, k: int | None, places: int) -> np.ndarray:
    """Where the k best of the rounded scores are, ties by order; no k: all."""
    near = np.arange(len(score))
    if k is None:
        return near
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(~(score < least - 2 * 10.0**-places))
    r = rounded(score[near], places)
    return near[np.lexsort((order[near], np.where(np.isnan(r), -np.inf, -r)))[:k]]


class Question(NamedTuple):
    row: int
    tokens: np.ndarray  # numbers of its distinct tokens
    places: list[tuple[int, int]] | None  # place and token; none where it has no phrase
    weight: float


class Asked(NamedTuple):
    """What workers need of all questions."""

    ids: pa.Array
    vocabulary: pa.Array
    questions: list[Question]
    idf: np.ndarray
    worth: Callable[[np.ndarray, np.ndarray], np.ndarray]  # a frequency saturated by a length
    every: bool
    slop: int
    phrase: float
    either: float
    k: int | None
    places: int


class Postings:
    """Places of asked tokens in a block of documents, by token, then document."""

    def __init__(self, asked: Asked, doc: np.ndarray, token: np.ndarray, place: np.ndarray, lengths: np.ndarray) -> None:
        by = np.argsort(token, kind="stable")
        doc, token, place = doc[by], token[by], place[by]
        longest = max((q.places[-1][0] for q in asked.questions if q.places), default=0)
        pad = longest + asked.slop + 1  # so that runs which would begin before a document stay in it
        self.asked, self.lengths, self.doc = asked, lengths, doc
        self.wide = int(place.max(initial=0)) + 2 * pad + 2
        self.key = doc.astype(np.int64) * self.wide + place + pad
        starts = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])]) if len(doc) else np.zeros(0, np.int64)
        numbers = np.arange(len(asked.idf) + 1)
        self.ends, self.pair_ends = np.searchsorted(token, numbers), np.searchsorted(token[starts], numbers)
        self.pair_doc = doc[starts]
        self.part = asked.idf[token[starts]] * asked.worth(np.diff(np.r_[starts, len(doc)]), lengths[self.pair_doc])

    def phrases(self, question: Question, docs: np.ndarray) -> np.ndarray:
        """Sloppy frequency in each of docs: from each place of the rarest token, the next ones of the others."""
        there = np.zeros(len(self.lengths), bool)
        there[docs] = True
        order = sorted(question.places, key=lambda x: self.ends[x[1] + 1] - self.ends[x[1]])
        qp, t = order[0]
        a, b = self.ends[t], self.ends[t + 1]
        s = np.unique((self.key[a:b][there[self.doc[a:b]]] - qp)[:, None] - np.arange(self.asked.slop + 1))
        width, later = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
        for qp, t in order:
            key = self.key[self.ends[t] : self.ends[t + 1]]
            at = np.searchsorted(key, s + qp)
            gap = np.where(at < len(key), key[np.minimum(at, len(key) - 1)] - s - qp, self.wide)
            after = at + 1
            further = np.where(gap > 0, gap, np.where(after < len(key), key[np.minimum(after, len(key) - 1)] - s - qp, self.wide))
            fits = gap <= self.asked.slop
            s, width, later = s[fits], np.maximum(width, gap)[fits], np.maximum(later, further)[fits]
        worth = np.where((width == 0) | (later > width), 1.0 / (1 + width), 0.0)
        return np.bincount(s // self.wide, worth, len(self.lengths))[docs].astype(float)  # of no places it counts in whole numbers

    def hits(self, question: Question) -> tuple[np.ndarray, ...]:
        """Documents with score, match and phrases."""
        asked, n = self.asked, len(self.lengths)
        spans = [(self.pair_ends[t], self.pair_ends[t + 1]) for t in question.tokens]
        if asked.every and any(a == b for a, b in spans):
            return (np.zeros(0, np.int64), *[np.zeros(0)] * 3)
        match, found = np.zeros(n), np.zeros(n, np.int32)
        for a, b in spans:
            match[self.pair_doc[a:b]] += self.part[a:b]
            found[self.pair_doc[a:b]] += 1
        docs = np.flatnonzero(found == len(spans) if asked.every else found)
        match, none = match[docs], np.zeros(len(docs))
        if not asked.every:
            return docs, match, match, none
        phrases = self.phrases(question, docs) if question.places and len(docs) else none
        near = np.where(phrases > 0, question.weight * asked.worth(phrases, self.lengths[docs]), 0.0)
        return docs, match * (1 + asked.either) + near * asked.phrase, match, phrases


def occurrences(ts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, token number and place of all asked tokens in a column of token lists; lengths of the lists (null: 0)."""
    lengths = pc.fill_null(pc.list_value_length(ts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    token = pc.fill_null(pc.index_in(pc.list_flatten(ts), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(token >= 0)
    row = np.repeat(np.arange(len(lengths)), lengths)[at]
    return row, token[at], at - (np.cumsum(lengths) - lengths)[row], lengths


def counted(vocabulary: pa.Array) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """token and n: documents of each asked token; -1: all documents, -2: those with text, -3: their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rest = np.zeros(len(vocabulary), np.int64), np.zeros(3, np.int64)
        for batch in batches:
            ts = batch.column(0)
            row, token, _, lengths = occurrences(ts, vocabulary)
            pairs = np.unique(row * len(vocabulary) + token)
            n += np.bincount(pairs % max(1, len(vocabulary)), minlength=len(vocabulary))
            rest += [len(ts), len(ts) - ts.null_count, lengths.sum()]
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.arange(len(n)), -1, -2, -3]), pa.array(np.r_[n, rest])], ["token", "n"])

    return run


def searched(asked: Asked, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows of an id, whether it may be a hit and its tokens: the hits of each question within a block."""

    def scored(ids: list, parts: list) -> Iterator[pa.RecordBatch]:
        id_ = pa.concat_arrays(ids)
        order = pc.rank(id_, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        postings = Postings(asked, *(np.concatenate(x) for x in zip(*parts, strict=True)))
        out, n = [], 0

        def packed() -> pa.RecordBatch:
            q, docs, *rest = (np.concatenate(x) for x in zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([asked.ids.take(pa.array(q)), id_.take(pa.array(docs)), *map(pa.array, rest)], names)

        for question in asked.questions:
            docs, *rest = postings.hits(question)
            if len(docs):
                top = best(rest[0], order[docs], asked.k, asked.places)
                out.append((np.full(len(top), question.row), docs[top], *(x[top] for x in rest)))
                n += len(top)
            if n >= ROWS:
                yield packed()
                out, n = [], 0
        if n:
            yield packed()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, docs, n = [], [], 0, 0
        for batch in batches:
            batch = batch.filter(batch.column(1))
            row, token, place, lengths = occurrences(batch.column(2), asked.vocabulary)
            ids.append(batch.column(0))
            parts.append((row.astype(np.int32) + np.int32(docs), token.astype(np.int32), place.astype(np.int32), lengths))
            docs, n = docs + len(lengths), n + len(row)
            if n >= PLACES:
                yield from scored(ids, parts)
                ids, parts, docs, n = [], [], 0, 0
        if docs:
            yield from scored(ids, parts)

    return run


def nearest(query_ids: pa.Array, queries: list, k: int, places: int, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows of an id and a vector: the k of the highest cosine + 1 to each query, others than itself, within a block."""

    def scored(ids: list, vectors: list) -> Iterator[pa.RecordBatch]:
        id_ = pa.concat_arrays(ids)
        order = pc.rank(id_, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        of = np.array([len(v) if v is not None else -1 for v in vectors])
        held = {n: np.flatnonzero(of == n) for n in set(of.tolist()) if n >= 0}
        unit = {n: _units(np.array([vectors[i] for i in rows], np.float64).reshape(len(rows), n)) for n, rows in held.items()}
        for low in range(0, len(queries), QUERIES):
            some = queries[low : low + QUERIES]
            score = np.full((len(some), len(of)), -np.inf)  # no cosine: last
            for n, rows in held.items():
                alike = [i for i, q in enumerate(some) if q is not None and len(q) == n]
                if alike:
                    score[np.ix_(alike, rows)] = _units(np.array([some[i] for i in alike], np.float64).reshape(len(alike), n)) @ unit[n].T + 1
            out = []
            for i in range(len(some)):
                other = np.flatnonzero(pc.fill_null(pc.not_equal(id_, query_ids[low + i]), False).to_numpy(zero_copy_only=False))
                top = other[best(score[i][other], order[other], k, places)]
                out.append((np.full(len(top), low + i), top, score[i][top]))
            q, at, s = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(q)), id_.take(pa.array(at)), pa.array(s, mask=np.isneginf(s))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = [], []
        for batch in batches:
            ids.append(batch.column(0))
            vectors += _rows(batch.column(1))
            if len(vectors) >= VECTORS:
                yield from scored(ids, vectors)
                ids, vectors = [], []
        if vectors:
            yield from scored(ids, vectors)

    return run


def _rows(vectors: pa.Array) -> list:
    """Vectors as arrays; one that is null or holds nulls as None."""
    flat, ends = vectors.flatten(), np.cumsum(pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False))
    values = flat.to_numpy(zero_copy_only=False)
    rows = np.split(values, ends[:-1]) if len(ends) else []
    holes = np.r_[0, np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))] if flat.null_count else None
    there = vectors.is_valid().to_numpy(zero_copy_only=False)
    return [r if ok and (holes is None or holes[e] == holes[e - len(r)]) else None for r, e, ok in zip(rows, ends, there, strict=True)]


def _units(x: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
