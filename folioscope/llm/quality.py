"""Quality classifier: hashed word n-gram logistic regression.

Training follows the regularised leader (FTRL-proximal, per-coordinate rates);
a score is the logistic function of a sparse dot product of n-gram frequencies
and weights. Tokens are runs of word characters and runs of other marks, case
kept. Features are hashed 1- and 2-grams, 2-grams of token shapes (case, digits,
marks), which carry over to words never seen, and a token's return after 1 to 4
tokens, which shows repetition of any word.

Cases: a null or empty text scores by the bias alone; labels other than 0 and 1
and labels of absent documents are left out; of rows that share an id, one is
learnt from; without labels every text scores 0.5, which keeps it; equal texts
score alike; texts of any length are scored as a whole; a column of the score's
name raises, other columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_of, small_batches, tidied

TOKEN = re.compile(r"\w+|[^\w\s]+")


def shape(token: str) -> int:
    first = token[0]
    if not (first.isalnum() or first == "_"):
        return 5 if len(token) > 1 and token.count(first) == len(token) else 4
    if not token.isalpha():
        return 3
    return 2 if len(token) > 1 and token.isupper() else 1 if first.isupper() else 0


class Memo(dict):
    """Hashes of tokens with their shapes in the low bits, forgotten when there are too many."""

    most = 150_000

    def __missing__(self, token: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = (zlib.crc32(token.encode("utf-8", "surrogatepass")) + 1) * 0x9E3779B97F4A7C15
        x = self[token] = h & 0xFFFFFFFFFFFFFFF8 | shape(token)
        return x


#: The first buckets are those of shapes (8 by 8) and of returns.
SHAPES, RETURNS, KEPT = 64, 4, 128


def gram_ids(text: str | None, memo: Memo, bits: int) -> np.ndarray:
    """Bucket of each n-gram, repeats kept."""
    tokens = TOKEN.findall(text or "")
    h = np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))
    pairs = (h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ h[1:]) * np.uint64(0x165667B19E3779F9)
    words = np.maximum((np.concatenate([h, pairs]) >> np.uint64(64 - bits)).astype(np.int64), KEPT)
    s = (h & np.uint64(7)).astype(np.int64)
    back = [np.full(np.count_nonzero(h[d:] == h[:-d]), SHAPES + d) for d in range(1, RETURNS + 1)]
    return np.concatenate([words, s[:-1] * 8 + s[1:], *back])


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float
    bits: int
    scale: float


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], size: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, float]:
    """Weights and bias after epochs passes over (buckets, values, label)."""
    z, n, bias_z, bias_n = np.zeros(size), np.zeros(size), 0.0, 0.0
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            idx, x, y = rows[k]
            zi, ni = z[idx], n[idx]
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))
            b = -bias_z / ((beta + np.sqrt(bias_n)) / alpha + l2)
            p = 1 / (1 + np.exp(-np.clip(w @ x + b, -35, 35)))
            g = (p - y) * x
            z[idx] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[idx] = ni + g * g
            bias_z += (p - y) - (np.sqrt(bias_n + (p - y) ** 2) - np.sqrt(bias_n)) / alpha * b
            bias_n += (p - y) ** 2
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    return w, float(-bias_z / ((beta + np.sqrt(bias_n)) / alpha + l2))


def train(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", eligible: Column | None = None, max_rows: int = 6000, bits: int = 18, scale: float = 20.0, alpha: float = 1.0, beta: float = 0.1, l1: float = 1e-4, l2: float = 1e-4, epochs: int = 4) -> QualityModel:
    """Fit on at most max_rows labelled documents, those of the least hashed ids.

    eligible: a condition on doc_id that rows to learn from meet. The bound keeps
    the one training task small; the scan for their texts covers all documents.
    """
    small_batches(docs.sparkSession)
    chosen = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull())
    if eligible is not None:
        chosen = chosen.where(eligible)
    chosen = chosen.groupBy("doc_id").agg(F.max(label_col).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for b in tidied(batches):
            out = []
            for t in b.column("text"):
                idx, count = np.unique(gram_ids(t.as_py(), memo, bits), return_counts=True)
                out.append(np.stack([idx, count]).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(out, pa.binary())], names=["doc_id", "y", "f"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [x for b in batches for x in zip(b.column("h").to_pylist(), b.column("f").to_pylist(), b.column("y").to_pylist(), strict=True)]
        parsed = []
        for _, f, y in sorted(rows):
            idx, count = np.frombuffer(f, "<u4").reshape(2, -1).astype(np.int64)
            parsed.append((idx, count * (scale / max(1, count.sum())), y))
        w, bias = ftrl(parsed, 1 << bits, alpha, beta, l1, l2, epochs) if parsed else (np.zeros(1 << bits), 0.0)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int64()), pa.array([bias, *w[at]], pa.float64())], names=["at", "w"])

    found = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_rows rows
        .select("doc_id", "y", "text").mapInArrow(features, docs.select("doc_id").schema.add("y", "integer").add("f", "binary"))
        .groupBy("doc_id").agg(F.max("y").alias("y"), F.min("f").alias("f"))
        .select(F.xxhash64("doc_id").alias("h"), "f", "y").repartition(1).mapInArrow(fit, "at long, w double").toArrow()
    )
    weights, bias = np.zeros(1 << bits, np.float32), 0.0
    at, w = found["at"].to_numpy(), found["w"].to_numpy()
    weights[at[at >= 0]] = w[at >= 0]
    bias = float(w[at < 0].sum())
    return QualityModel(weights, bias, bits, scale)


def score(docs: DataFrame, model: QualityModel, out: str = "score") -> DataFrame:
    """docs with the model's probability of label 1 for each whole text, in column out."""
    free_of(docs, out)
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.bits, model.scale))  # 2**bits floats

    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo, (weights, bias, bits, scale) = Memo(), sent.value
        for part in tidied(parts):
            s = np.empty(len(part))
            for i, t in enumerate(part):
                idx = gram_ids(t, memo, bits)
                s[i] = bias + (scale * float(weights[idx].sum(dtype=np.float64)) / len(idx) if len(idx) else 0.0)
            yield pd.Series(1 / (1 + np.exp(-np.clip(s, -35, 35))))

    scored.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(out, F.pandas_udf(scored, "double")(F.col("text")))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """docs without those that score below threshold; columns as they were."""
    model = train(docs, labels, **options)
    return score(docs, model, "__fs_score").where(F.col("__fs_score") >= threshold).drop("__fs_score")
