"""Merging two extractions of the same books: the best unused match of each chunk, then the better of the two."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.layout import TOPICS
from ..functions.quality import confidence, text_quality
from ..functions.text import normalised
from .common import lower_batches, tasks

ALIKE = 80.0


def indel_ratio(a: str, b: str) -> float:
    """0 to 100: twice the longest common subsequence over both lengths. Runs of bits stand for rows of the table."""
    return 200.0 * _shared(a, b) / (len(a) + len(b)) if a or b else 100.0


def _shared(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    open_ = full
    for c in b:
        if places := where.get(c):
            met = open_ & places
            open_ = ((open_ + met) | (open_ - met)) & full
    return len(a) - open_.bit_count()


def token_set_ratio(a: str, b: str, least: float = 0.0) -> float:
    """The best indel ratio among common words, and common words with either text's own; 0 where a text is empty or all are under least.

    Common words begin both longer strings, so only those two need comparing, and only what follows there, where their lengths allow it.
    """
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if common and not (left and right):
        return 100.0
    head = len(common) + 1 if common else 0
    m, n = head + len(left), head + len(right)
    best = 200.0 * len(common) / (len(common) + min(m, n)) if common else 0.0
    possible = 200.0 * min(m, n) / (m + n)
    if possible >= max(best, least):
        best = max(best, 200.0 * (head + _shared(left, right)) / (m + n))
    return best if best >= least else 0.0


def token_set_likeness(a: Column, b: Column) -> Column:
    """token_set_ratio of two columns by an Arrow UDF; nulls count as empty."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([token_set_ratio(p or "", q or "") for p, q in zip(x, y, strict=True)], dtype=float)

    return F.pandas_udf(run, "double")(a, b)


class _Candidates:
    """Texts of a book with what bounds their ratio to another: lengths of their distinct words, these words' places and their characters."""

    def __init__(self, texts: Sequence[str]) -> None:
        plain = [" ".join(sorted(set(t.split()))) for t in texts]
        self.alphabet = np.unique(_codes("".join(plain)))
        self.length = np.array([len(t) for t in plain], np.int64)
        self.chars = np.stack([self.counted(t) for t in plain])
        self.at: dict[str, list[int]] = {}
        for k, t in enumerate(plain):
            for w in t.split():
                self.at.setdefault(w, []).append(k)

    def counted(self, text: str) -> np.ndarray:
        codes = _codes(text)
        at = np.searchsorted(self.alphabet, codes)
        at = at[self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == codes] if len(self.alphabet) else at[:0]
        return np.bincount(at, minlength=len(self.alphabet))

    def bounds(self, text: str) -> np.ndarray:
        """What token_set_ratio of text and each can be at most: by the words they share, their lengths and their common characters."""
        words = sorted(set(text.split()))
        plain = " ".join(words)
        there = [(len(w) + 1, ks) for w in words if (ks := self.at.get(w))]
        where = np.fromiter((k for _, ks in there for k in ks), np.int64)
        shared = np.bincount(where, np.repeat([n for n, _ in there], [len(ks) for _, ks in there]), len(self.length)) if there else np.zeros(len(self.length))
        shared = np.maximum(shared - 1, 0)
        short, both = np.minimum(self.length, len(plain)), np.maximum(self.length + len(plain), 1)
        by_words = np.where(shared > 0, 200.0 * shared / np.maximum(shared + short, 1), 0.0)
        by_chars = 200.0 * np.minimum(np.minimum(self.chars, self.counted(plain)).sum(axis=1), short) / both
        return np.maximum(by_words, by_chars) + 1e-9


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _matched(pdf: Sequence[tuple], ocr: Sequence[tuple], least: float) -> tuple[list[tuple], list[bool]]:
    """Of two lists (norm, topics) in order: place in pdf, place in ocr, similarity and whether topics are the same; which of ocr stay free.

    In order each pdf chunk claims its best free match; ties go to the first. Only pairs whose bound allows it are compared.
    """
    free, out = np.ones(len(ocr), bool), []
    candidates = _Candidates([t for t, _ in ocr]) if pdf and ocr else None
    for i, (norm, topics) in enumerate(pdf if ocr else ()):
        bound, ratio, k = candidates.bounds(norm), 0.0, -1
        for j in np.flatnonzero(free & (bound >= least)).tolist():
            if bound[j] > ratio:
                r = token_set_ratio(norm, ocr[j][0], max(least, ratio))
                if r > ratio:
                    ratio, k = r, j
        if k >= 0:
            same = _same(topics, ocr[k][1])
            out.append((i, k, ratio, same))
            free[k] = not same
    return out, free.tolist()


def _claims(pdf: pd.DataFrame, ocr: pd.DataFrame, least: float) -> list[tuple]:
    """pdf index, ocr index and similarity of the matches of two tables of a book (idx, norm, topics)."""
    p, o = pdf.sort_values("idx"), ocr.sort_values("idx")
    rows = lambda df: list(zip(df["norm"], df["topics"], strict=True))
    found, _ = _matched(rows(p), rows(o), least)
    return [(p["idx"].iloc[i], o["idx"].iloc[k], ratio) for i, k, ratio, _ in found]


def _same(a: Sequence[str], b: Sequence[str]) -> bool:
    x, y = set(a), set(b)
    return not x or not y or len(x & y) / max(len(x), len(y)) >= 0.6


def merge(pdf: DataFrame, ocr: DataFrame, book: str = "book", least: float = ALIKE) -> DataFrame:
    """book, idx, text, method, quality, confidence, variant, alternative and similarity of the merged chunks.

    Chunks match within their book, which is a row of one task (a rulebook's chunks, not a corpus):
    texts are shuffled once, matched and put together there. pdf and ocr hold book, idx (unique
    within it), text and section. A match of other topics keeps both and stays free. A null text
    counts as empty; chunks of no book match none.
    """
    lower_batches(pdf.sparkSession)
    pattern = rf"\b({'|'.join(TOPICS)})\b"
    topics = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(pattern), F.lit(1)))

    def ready(df: DataFrame, side: int) -> DataFrame:
        rows = df.select(F.col(book).alias("book"), F.col("idx"), F.coalesce("text", F.lit("")).alias("text"), F.col("section"))
        return rows.select("book", F.lit(side).alias("side"), F.struct("idx", "text", F.coalesce("section", F.lit("")).alias("named"), text_quality(F.col("text")).alias("quality")).alias("x"))

    both = ready(pdf, 0).unionByName(ready(ocr, 1)).repartition(tasks(pdf), "book").groupBy("book")
    books = both.agg(*(F.array_sort(F.collect_list(F.when(F.col("side") == k, F.col("x")))).alias(c) for k, c in enumerate("po")))
    lists = [F.transform(c, lambda x: normalised(x["text"])).alias(f"{c}_norm") for c in "po"] + [F.transform(c, lambda x: topics(x["text"])).alias(f"{c}_topics") for c in "po"]
    schema = books.select("*", *(F.array().cast(t).alias(c) for c, t in (("at", "array<int>"), ("similarity", "array<double>"), ("same", "array<boolean>"), ("free", "array<boolean>")))).schema

    def claim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[list] = [[], [], [], []]
            for name, *rest in zip(*(b.column(c).to_pylist() for c in ("book", "p_norm", "p_topics", "o_norm", "o_topics")), strict=True):
                p, o = (list(zip(*rest[k : k + 2], strict=True)) for k in (0, 2))
                claims, free = _matched(p if name is not None else [], o, least)
                by = {i: x for i, *x in claims}
                for out, k, none in zip(found, range(3), (-1, None, None), strict=False):
                    out.append([by[i][k] if i in by else none for i in range(len(p))])
                found[3].append(free)
            kinds = (pa.int32(), pa.float64(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("book", "p", "o")), *(pa.array(x, pa.list_(t)) for x, t in zip(found, kinds, strict=True))], schema.names)

    met = books.select("*", *lists).mapInArrow(claim, schema)

    def merged(x: Column) -> Column:
        p, o = x["p"], F.when(x["at"] >= 0, F.get("o", x["at"]))
        variant = F.coalesce(~x["same"], F.lit(False))
        take = F.coalesce(x["same"] & (p["quality"] < o["quality"]), F.lit(False))
        return F.struct(F.when(take, o).otherwise(p).alias("x"), F.when(take, "ocr").otherwise("pdf").alias("method"), variant.alias("variant"), F.coalesce(x["same"], F.lit(False)).alias("alternative"), F.when(~variant, x["similarity"]).alias("similarity"))

    alone = lambda x: F.struct(x["o"].alias("x"), F.lit("ocr").alias("method"), F.lit(False).alias("variant"), F.lit(False).alias("alternative"), F.lit(None).cast("double").alias("similarity"))
    rest = F.transform(F.filter(F.arrays_zip("o", "free"), lambda x: x["free"]), alone)
    out = met.select("book", F.explode(F.concat(F.transform(F.arrays_zip("p", "at", "similarity", "same"), merged), rest)).alias("m")).select("book", "m.*")
    x = F.col("x")
    return out.select(
        F.col("book").alias(book), x["idx"].alias("idx"), x["text"].alias("text"), x["quality"].alias("quality"), "method", "variant", "alternative", "similarity",
        confidence(x["quality"], F.col("method"), x["named"], F.col("variant")).alias("confidence"),
    )


UNIFIED = {
    "text": "string", "answer": "string", "source_type": "string", "extraction_method": "string", "priority": "int", "quality_score": "double", "extraction_confidence": "double", "page": "bigint", "section": "string", "chunk_index": "bigint",
    "doc_type": "string", "thread_id": "string", "url": "string", "answer_user": "string", "qa_id": "string", "faq_id": "string", "semantic_variant": "boolean", "alt_source_available": "boolean", "similarity_to_alt": "double",
}


def _unified(df: DataFrame) -> DataFrame:
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in UNIFIED.items()))


def all_sources(pdf: DataFrame | None = None, ocr: DataFrame | None = None, faq: DataFrame | None = None, forum: DataFrame | None = None, book: str = "book", least: float = ALIKE) -> DataFrame:
    """Chunks of all given sources with the columns of UNIFIED; two extractions are merged, one alone is kept as it is.

    pdf and ocr hold book, chunk_index (unique within it), page, text and section. Order by page and
    chunk_index (missing ones as 0) gives the merged document's.
    """
    if pdf is None and ocr is None and faq is None and forum is None:
        raise ValueError("at least one source is needed")
    parts = []
    rules = [(m, df) for m, df in (("pdf", pdf), ("ocr", ocr)) if df is not None]
    if len(rules) == 2:
        lean = lambda df: df.select(book, F.col("chunk_index").alias("idx"), "text", "section")
        m = merge(lean(pdf), lean(ocr), book, least).withColumnRenamed("idx", "chunk_index")
        places = pdf.select(book, "chunk_index", "page", "section", F.lit("pdf").alias("method")).unionByName(ocr.select(book, "chunk_index", "page", "section", F.lit("ocr").alias("method")))
        m = m.join(places, [book, "chunk_index", "method"]).withColumnsRenamed({"method": "extraction_method", "quality": "quality_score", "confidence": "extraction_confidence", "variant": "semantic_variant", "alternative": "alt_source_available", "similarity": "similarity_to_alt"})
        parts.append(m.withColumns({"source_type": F.lit("rulebook"), "priority": F.lit(50)}))
    for method, df in rules if len(rules) == 1 else []:
        q = text_quality(F.col("text"))
        parts.append(df.withColumns({"source_type": F.lit("rulebook"), "priority": F.lit(50), "extraction_method": F.lit(method), "quality_score": q, "extraction_confidence": confidence(q, F.lit(method), F.coalesce("section", F.lit("")), F.lit(False))}))
    parts += [df for df in (faq, forum) if df is not None]
    out = _unified(parts[0])
    for part in parts[1:]:
        out = out.unionByName(_unified(part))
    return out


def in_order(merged: DataFrame) -> DataFrame:
    """Merged chunks by page and chunk_index, missing ones as 0."""
    return merged.orderBy(F.coalesce("page", F.lit(0)), F.coalesce("chunk_index", F.lit(0)))
