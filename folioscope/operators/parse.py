"""Documents from pages to chunks: lines and paragraphs left out with their reason, sections packed, words corrected, corrupt chunks dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.layout import body_lines, is_contents_line, is_skipped
from ..functions.quality import is_corrupt, skip_reason
from .chunk import sections
from .spelling import Lexicon, corrected


def paragraphs(pages: DataFrame, doc: str) -> DataFrame:
    """doc, page, para_idx, text and skip_reason (null: kept) of each paragraph of pages (doc, page, text).

    First and last lines of longer pages are left out; paragraphs are split at empty lines.
    """
    p = pages.select(doc, "page", F.posexplode(F.split(body_lines(F.coalesce("text", F.lit(""))), r"\n\s*\n")).alias("para_idx", "p"))
    p = p.select(doc, "page", "para_idx", F.trim("p").alias("text"))
    t = F.col("text")
    reason = F.when(F.length(t) < 20, "short").when(is_skipped(t), "front matter").when(is_contents_line(t, F.col("page")), "contents").otherwise(skip_reason(t))
    return p.withColumn("skip_reason", F.when(reason != "corrupt", reason))  # corrupt text is looked for in whole chunks


def parsed(pages: DataFrame, doc: str, method: str, doc_type: str = "rulebook", lexicon: Lexicon | None = None, strict: bool = True) -> DataFrame:
    """doc, chunk_index, text, page, section, subsection, doc_type, extraction_method (pdf or ocr), created_at and corrections of each document's chunks.

    A document's paragraphs are one row (a book); with a lexicon its words are corrected.
    """
    kept = paragraphs(pages, doc).where("skip_reason is null")
    listed = kept.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("page", "para_idx", "text"))).alias("ps"))
    listed = listed.select(doc, F.transform("ps", lambda x: x["text"]).alias("paragraphs"), F.transform("ps", lambda x: x["page"].cast("bigint")).alias("pages"))
    out = sections(listed, doc, pages="pages", strict=strict)
    if lexicon is not None:
        keyed = out.withColumn("_id", F.struct(doc, "chunk_index"))
        out = keyed.drop("text").join(corrected(keyed, lexicon, "_id"), "_id").drop("_id")
    else:
        out = out.withColumn("corrections", F.lit(0).cast("long"))
    columns = [doc, "chunk_index", "text", "page", "section", "subsection", F.lit(doc_type).alias("doc_type"), F.lit(method).alias("extraction_method"), F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("created_at"), "corrections"]
    return out.where(~is_corrupt(F.col("text"))).select(*columns)
