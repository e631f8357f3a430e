"""Hidden Markov language model of whole texts.

States emit word classes and a class emits its words: P(w | state) is
P(class | state) * (c + 1) / (N_class + V_class + 1), c the word's count in
training, the last 1 a share for words never seen. Words of a count of own_from
and more are classes of their own; others share as many classes by a hash of
their last three characters; a text's end is a token and a class. That count is
at least N^(2/3) / 1000, N all training tokens, so classes grow with the corpus
and are no more than 2000 times the cube root of N: that bounds the model, which
is broadcast. Counts cover every training text. Baum-Welch starts from these
counts; it takes passes over a hashed share of the texts (it grows with them)
until their likelihood settles, then over all of them until that settles.
Expected counts are those of whole texts, uncut, and are summed across
partitions in blocks of classes. Scores come from the scaled forward recursion
over each whole text, so they are exact likelihoods.

Words that are not among the commonest (nor classes of their own) are looked up by
a shuffle join with the table of counts, so the whole vocabulary is never sent around.

Cases: a null text is empty: one end token; null ids are trained on; words of
equal counts are treated alike; repeated rows count as often as they stand;
without training texts every word has c = 0 and the model is its prior; an
empty table gives no rows; long texts are held as class numbers and as the
messages of SEGMENT tokens at a time.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .common import array_slices, coded_words, materialise, small_batches, text_key, tidied

END = "\n"
#: Tokens whose messages are held at once; messages of what is before them are computed again.
SEGMENT = 600_000
#: Classes whose expected counts travel together.
CLASS_BLOCK = 2048
#: The model: start (states), step (state, next state) and emit (class, state). Plain arrays, as tasks get them.
Model = tuple[np.ndarray, np.ndarray, np.ndarray]


def tokens_of(text: str) -> list[str]:
    """Lower-cased (A-Z) words between ASCII white space, then the end."""
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").lower().split()] + [END]


def first_guess(states: int, share: np.ndarray, seed: int = 6) -> Model:
    r = np.random.default_rng(seed)
    emit = (share[:, None] + 1e-7) * np.exp(r.normal(0, 1, (len(share), states)))
    step = np.full((states, states), 0.08 / max(1, states - 1)) + np.eye(states) * (0.92 - 0.08 / max(1, states - 1))
    return np.full(states, 1 / states), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)


def bundles(texts: list[np.ndarray], most: int = 400_000) -> Iterator[list[int]]:
    """Indices by falling length, about most tokens at a time."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    part, size = [], 0
    for i in order:
        part.append(i)
        size += len(texts[i])
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of texts (by falling length) place by place, and how many texts have each place."""
    lengths = np.array([len(t) for t in texts])
    live = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), "right")
    starts = np.concatenate([[0], np.cumsum(live)])
    out = np.empty(starts[-1], np.int32)
    for k, t in enumerate(texts):
        out[starts[: len(t)] + k] = t
    return out, starts


def log10_likelihoods(texts: list[np.ndarray], model: Model) -> np.ndarray:
    """Of each whole sequence of classes, by the scaled forward recursion."""
    start, step, emit = model
    out = np.zeros(len(texts))
    for part in bundles(texts):
        flat, starts = laid_out([texts[i] for i in part])
        scale = np.empty(len(flat))
        for k in range(len(starts) - 1):
            e = emit[flat[starts[k] : starts[k + 1]]]
            a = start * e if not k else (a[: len(e)] @ step) * e
            c = a.sum(axis=1)
            scale[starts[k] : starts[k + 1]] = c
            a /= c[:, None]
        np.log10(scale, out=scale)
        who = np.arange(len(flat)) - np.repeat(starts[:-1], np.diff(starts))
        out[part] = np.bincount(who, weights=scale, minlength=len(part))
    return out


def held(batches: Iterator[pa.RecordBatch], most: int = 2_500_000) -> Iterator[tuple[list[np.ndarray], list[pa.RecordBatch]]]:
    """Texts (last column) and rows of neighbouring batches, about most tokens at a time: long texts then share their places' steps."""
    texts, rows, size = [], [], 0
    for b in batches:
        for x in b.column(b.num_columns - 1):
            texts.append(np.frombuffer(x.as_buffer(), "<u4"))
            size += len(texts[-1])
        rows.append(b)
        if size >= most:
            yield texts, rows
            texts, rows, size = [], [], 0
    if texts:
        yield texts, rows


def segments(starts: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of places that hold at most so many tokens each (one place at least)."""
    out, k, last = [], 0, len(starts) - 1
    while k < last:
        stop = max(k + 1, int(np.searchsorted(starts, starts[k] + most, "right")) - 1)
        out.append((k, min(stop, last)))
        k = out[-1][1]
    return out


def expected(texts: list[np.ndarray], model: Model, most: int = SEGMENT) -> np.ndarray:
    """Rows of states: expected starts, steps and emissions of whole texts, then their log-likelihood (first of its row)."""
    start, step, emit = model
    states, classes = len(start), len(emit)
    firsts, steps, emits, likelihood = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states)), np.zeros((1, states))
    for part in bundles(texts):
        flat, starts = laid_out([texts[i] for i in part])
        runs = segments(starts, most)

        def forward(run: tuple[int, int], a: np.ndarray | None, keep: bool, flat: np.ndarray = flat, starts: np.ndarray = starts) -> tuple:
            """Last messages of a run of places that a comes into; if kept, emissions, messages and scales of all its places."""
            origin = starts[run[0]]
            e = emit[flat[origin : starts[run[1]]]]
            alpha, scale = (np.empty_like(e), np.empty(len(e))) if keep else (None, None)
            for k in range(*run):
                s = slice(starts[k] - origin, starts[k + 1] - origin)
                a = start * e[s] if a is None else (a[: s.stop - s.start] @ step) * e[s]
                c = a.sum(axis=1)
                a /= c[:, None]
                if keep:
                    alpha[s], scale[s] = a, c
            return a, e, alpha, scale

        into = [None]
        for run in runs[:-1]:
            into.append(forward(run, into[-1], False)[0])
        beta = np.ones((0, states))
        for run, before in zip(reversed(runs), reversed(into), strict=True):
            _, e, alpha, scale = forward(run, before, True)
            origin = starts[run[0]]
            likelihood[0, 0] += np.log(scale).sum()
            for k in range(run[1] - 1, run[0] - 1, -1):
                s = slice(starts[k] - origin, starts[k + 1] - origin)
                n = s.stop - s.start
                if len(beta) < n:
                    beta = np.vstack([beta, np.ones((n - len(beta), states))])
                if k:
                    b = e[s] * beta / scale[s][:, None]
                    last = before[:n] if k == run[0] else alpha[starts[k - 1] - origin : starts[k - 1] - origin + n]
                    steps += step * (last.T @ b)
                    alpha[s] *= beta  # now what is expected of each state
                    beta = b @ step.T
                else:
                    alpha[s] *= beta
                    firsts += alpha[s].sum(axis=0)
            here = flat[origin : starts[run[1]]]
            for k in range(states):
                emits[:, k] += np.bincount(here, weights=alpha[:, k], minlength=classes)
    return np.concatenate([firsts[None], steps, emits, likelihood])


def maximised(counts: np.ndarray, states: int, prior: np.ndarray) -> Model:
    """The model that expected counts give, each class with a little of its share beforehand."""
    start, step, emit = counts[0] + 1, counts[1 : states + 1] + 1, counts[states + 1 :]
    emit = emit + (prior[:, None] + 1e-7) * 20
    return start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)


def count_words(docs: DataFrame) -> DataFrame:
    """word (its bytes) and c of every token of docs' texts, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tidied(batches):
            for texts in array_slices(b.column("text")):
                words, codes, bounds = coded_words(texts)
                counts = np.bincount(codes, minlength=len(words) + 1)
                counts, at = counts[counts > 0], np.flatnonzero(counts)
                words = pa.concat_arrays([words, pa.array([END])])
                yield pa.RecordBatch.from_arrays([words.take(pa.array(at)), pa.array(counts)], names=["word", "c"])

    return materialise(docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), "lm-counts")


def least_count(counts: DataFrame, most: int) -> int:
    """A count that at most so many words reach: from a histogram of a few hundred rows, no sort of words."""
    band = F.floor(F.log2("c") * 8 + 1e-9).alias("band")
    bands = sorted(counts.groupBy(band).agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).collect(), reverse=True)
    total, least = 0, bands[0].high + 1 if bands else 1
    for r in bands:
        total += r.n
        if total > most:
            return least
        least = r.low
    return 1


class Words:
    """Counts and classes of words that are sent to tasks, and the classes of all others."""

    def __init__(self, sent: pa.Array, count: np.ndarray, own: int, size: int, ends: int) -> None:
        self.sent, self.count, self.own, self.size, self.ends = sent, count, own, size, ends

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of words and the end after them: counts (-1: not sent) and classes (the end's is 0)."""
        at = pc.fill_null(pc.index_in(words, value_set=self.sent), -1).to_numpy(zero_copy_only=False)
        count = np.where(at >= 0, self.count[at], -1) if len(self.count) else np.full(len(words), -1)
        tails = pc.utf8_slice_codeunits(words, -3).dictionary_encode()
        shared = np.array([1 + self.own + zlib.crc32(t.encode()) % (self.size - self.own - 1) for t in tails.dictionary.to_pylist()], np.int64)
        k = shared[tails.indices.to_numpy()] if len(words) else np.empty(0, np.int64)
        k = np.where((at >= 0) & (at < self.own), at + 1, k)
        return np.append(count, self.ends), np.append(k, 0)


def score(
    docs: DataFrame, *, held_out: Column, states: int = 8, own_from: int = 20, own_classes: int | None = None, classes: int | None = None,
    lookup_words: int = 150_000, tolerance: float = 2e-4, warm: int = 8, passes: int | None = None,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row; it learns from rows not held out.

    Passes end when one raises the log-likelihood by less than tolerance of it: first
    those over one text in warm, then those over all; passes fixes the number of the
    latter (without the former) instead. own_classes bounds the words that are classes of their own
    further and classes sets the number of all classes. lookup_words bounds the counts of
    words that are sent to tasks beside those.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.shiftrightunsigned(F.xxhash64(text_key()), 1).alias("part"), "text")
    counts = count_words(rows.where("not held_out"))
    n_all, v_all = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    words = counts.where(F.col("word") != F.lit(END))
    own_least = max(own_from, math.ceil(n_all ** (2 / 3) / 1000))
    if own_classes is not None:
        own_least = max(1, least_count(words, own_classes))
    sent_least = min(own_least, least_count(words, lookup_words))
    common = words.where(F.col("c") >= sent_least).toArrow()
    common = common.sort_by([("c", "descending"), ("word", "ascending")])
    ends = counts.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    own = int(np.count_nonzero(common["c"].to_numpy() >= own_least))
    classes = classes or 2 * (own + 1)
    plain = (common["word"].combine_chunks().to_pylist(), common["c"].to_numpy(), own, classes, ends)
    sent = spark.sparkContext.broadcast(plain)  # lookup_words or the bound of own classes, whichever is more

    def known_words() -> Words:
        words, count, *rest = sent.value
        return Words(pa.array(words, pa.string()), count, *rest)

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, v = known_words(), np.zeros(classes, np.int64), np.zeros(classes, np.int64)
        for b in tidied(batches):
            word = b.column("word")
            k = np.where(np.asarray(pc.equal(word, END)), 0, known.of(word)[1][:-1])
            n += np.bincount(k, weights=b.column("c").to_numpy(), minlength=classes).astype(np.int64)
            v += np.bincount(k, minlength=classes)
        at = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(v[at])], names=["k", "n", "v"])

    per_class = counts.mapInArrow(by_class, "k long, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toArrow()
    class_n, class_v = np.zeros(classes), np.zeros(classes)
    class_n[per_class["k"].to_numpy()], class_v[per_class["k"].to_numpy()] = per_class["n"].to_numpy(), per_class["v"].to_numpy()
    below = np.log10(class_n + class_v + 1)
    prior = class_n / max(1, n_all)
    prior[0] = max(prior[0], 1e-7)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, top = known_words(), below
        for b in tidied(batches):
            done = 0
            for texts in array_slices(b.column("text")):
                words, codes, bounds = coded_words(texts)
                c, k = known.of(words)
                n, starts = len(texts), bounds[:-1]
                rare = np.flatnonzero((c < 0)[codes])
                cuts = np.searchsorted(rare, bounds).astype(np.int32)
                raw = k.astype("<u4")[codes]
                stops = pa.py_buffer((bounds * 4).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    *(b.column(x).slice(done, n) for x in ("doc_id", "held_out", "part")), pa.array(np.diff(bounds).astype(np.int64)),
                    pa.array(np.add.reduceat((c > 0).astype(np.int64)[codes], starts)), pa.array(np.add.reduceat(np.log10(np.maximum(c, 0) + 1.0)[codes], starts)),
                    pa.array(np.add.reduceat(top[k][codes], starts)), pa.Array.from_buffers(pa.binary(), n, [None, stops, pa.py_buffer(raw)]),
                    pa.ListArray.from_arrays(pa.array(cuts), words.take(pa.array(codes[rare]))),
                ], names=["doc_id", "held_out", "part", "n_tokens", "sure", "logs", "below", "k", "rare"])
                done += n

    schema = docs.select("doc_id").schema.add("held_out", "boolean").add("part", "long").add("n_tokens", "long").add("sure", "long").add("logs", "double").add("below", "double").add("k", "binary").add("rare", ArrayType(StringType()))
    table = materialise(rows.mapInArrow(coded, schema).withColumn("row", F.monotonically_increasing_id()), "lm-coded")

    # Baum-Welch
    size = 1 + states + classes + 1

    def one_pass(texts: DataFrame, model: Model) -> tuple[Model, float]:
        now = spark.sparkContext.broadcast(model)

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for texts, _ in held(tidied(batches)):
                more = expected(texts, now.value)
                total = more if total is None else np.add(total, more, out=total)
            if total is not None:
                blocks = [total[i : i + CLASS_BLOCK] for i in range(0, size, CLASS_BLOCK)]
                at = [i for i, x in enumerate(blocks) if x.any()]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([blocks[i].astype(np.float32 if i else np.float64).tobytes() for i in at], pa.binary())], names=["i", "v"])

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for i, v in zip(b.column("i").to_pylist(), b.column("v"), strict=True):
                    x = np.frombuffer(v.as_buffer(), np.float32 if i else np.float64)
                    total[i] = total[i] + x if i in total else x.astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["i", "v"])

        got = texts.select("k").mapInArrow(gather, "i long, v binary").repartition("i").mapInArrow(summed, "i long, v binary").toArrow()
        total = np.zeros((size, states))
        for i, v in zip(got["i"].to_pylist(), got["v"].to_pylist(), strict=True):
            x = np.frombuffer(v, np.float64).reshape(-1, states)
            total[i * CLASS_BLOCK : i * CLASS_BLOCK + len(x)] += x
        now.unpersist()
        return (maximised(total[:-1], states, prior) if got.num_rows else model), total[-1, 0]

    model = first_guess(states, prior)
    learnt = table.where("not held_out")
    if passes is None:
        few = spark.sparkContext.defaultParallelism
        for texts in (learnt.where(F.col("part") % warm == 0).coalesce(few), learnt):
            before = None
            while True:
                model, reached = one_pass(texts, model)
                if not reached or before is not None and reached - before <= tolerance * abs(reached):
                    break  # no texts, or settled
                before = reached
    for _ in range(passes or 0):
        model, _ = one_pass(learnt, model)

    final = spark.sparkContext.broadcast(model)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, held_batches in held(tidied(batches)):
            path = log10_likelihoods(texts, final.value)
            for b in held_batches:
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(path[: b.num_rows])], names=[*b.schema.names[:-1], "path"])
                path = path[b.num_rows :]

    lean = table.drop("rare", "part")
    paths = lean.select(*[c for c in lean.columns if c != "k"], "k")
    scored = paths.mapInArrow(forward, paths.drop("k").schema.add("path", "double"))
    rare = table.where(F.size("rare") > 0).select("row", F.explode("rare").alias("word"))
    found = rare.join(counts, "word").groupBy("row").agg(F.sum(F.log10(F.col("c") + 1)).alias("more"), F.count("*").alias("also"))
    logs = F.col("logs") + F.coalesce("more", F.lit(0.0))
    return scored.join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("sure") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(math.log10(n_all + v_all + 1))).alias("base_score"), (F.col("path") + logs - F.col("below")).alias("score"),
    )
