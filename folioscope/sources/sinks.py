"""Writers of chunks, indexes, reports and learnt settings."""

from __future__ import annotations

import json
import time
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX_DEFAULTS = {"quality_score": 50.0, "extraction_confidence": 0.5, "extraction_method": "unknown", "priority": 50, "doc_type": ""}
#: Fields that only documents of a source have, with what a missing value becomes (None: stays missing).
SOURCE_FIELDS = {
    "rulebook": {"page": ("bigint", None), "section": ("string", ""), "chunk_index": ("bigint", "idx"), "semantic_variant": ("boolean", False), "alt_source_available": ("boolean", False)},
    "forum": {"answer": ("string", ""), "thread_id": ("string", ""), "url": ("string", ""), "answer_user": ("string", ""), "qa_id": ("string", "")},
    "faq": {"faq_id": ("string", "faq_idx"), "source_file": ("string", ""), "answer": ("string", ""), "section": ("string", "")},
}


def index_documents(chunks: DataFrame, dims: int) -> tuple[DataFrame, DataFrame]:
    """Documents of an index with ids and defaults, and the rejected rows with their reason.

    chunks holds text, embedding, idx (unique) and source_type; further columns keep their values.
    Fields of one source are null in documents of the others.
    """
    c = chunks.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in chunks.columns else F.lit(v) for k, v in INDEX_DEFAULTS.items()})
    c = c.withColumn("source_type", F.coalesce("source_type", F.lit("rulebook")))
    known = lambda name, kind: F.col(name).cast(kind) if name in chunks.columns else F.lit(None).cast(kind)
    named = lambda kind, key: F.concat_ws("_", F.lit(kind), F.coalesce(known(key, "string"), F.col("idx").cast("string")))
    page = F.concat_ws("_", F.lit("rulebook"), F.coalesce(known("page", "bigint"), F.lit(0)).cast("string"), F.col("idx").cast("string"))
    c = c.withColumn("_id", F.when(F.col("source_type") == "forum", named("forum", "qa_id")).when(F.col("source_type") == "faq", named("faq", "faq_id")).otherwise(page))
    default = {"idx": F.col("idx").cast("bigint"), "faq_idx": F.concat(F.lit("faq_"), F.col("idx").cast("string"))}
    fields: dict[str, Column] = {}
    for source, own in SOURCE_FIELDS.items():
        for name, (kind, value) in own.items():
            filled_in = known(name, kind) if value is None else F.coalesce(known(name, kind), default[value] if value in ("idx", "faq_idx") else F.lit(value))
            fields[name] = F.when(F.col("source_type") == source, filled_in).otherwise(fields.get(name, F.lit(None).cast(kind)))
    c = c.withColumns(fields)
    reason = F.when(F.coalesce("text", F.lit("")) == "", "empty text").when(F.coalesce(F.size("embedding"), F.lit(-1)) != dims, "invalid embedding")
    c = c.withColumn("reject_reason", reason)
    return c.where("reject_reason is null").drop("reject_reason"), c.where("reject_reason is not null")


def write_index(chunks: DataFrame, path: str, rejects: str, dims: int) -> None:
    """The index by source_type, replaced as a whole; rejected rows beside it."""
    good, bad = index_documents(chunks, dims)
    good.write.mode("overwrite").partitionBy("source_type").parquet(path)
    bad.write.mode("overwrite").parquet(rejects)


def delete_source(index: DataFrame, source_type: str, path: str) -> None:
    """index without a source, written to another path."""
    index.where(~F.col("source_type").eqNullSafe(F.lit(source_type))).write.mode("overwrite").partitionBy("source_type").parquet(path)


def write_results(results: DataFrame, path: str, archive: str, started: float | None = None) -> str:
    """Results (a row for each question) as one CSV file now and one for the archive, whose path it gives.

    started (a time of time.time()): the archive's name gets the date and the elapsed seconds.
    """
    if started is not None:
        archive = f"{archive}_{datetime.now():%Y-%m-%d_%H-%M-%S}_{int(time.time() - started)}s.csv"
    for p in (path, archive):
        results.coalesce(1).write.mode("overwrite").csv(p, header=True, escape='"')
    return archive


def write_chunks(chunks: DataFrame, path: str, archive: str | None = None) -> list[str]:
    """Chunks as Parquet and as JSON, with dated copies of both in archive; the paths written."""
    out = [f"{path}.parquet", f"{path}.json"]
    chunks.write.mode("overwrite").parquet(out[0])
    kept = chunks.sparkSession.read.parquet(out[0])  # written once, read for the copies
    kept.write.mode("overwrite").json(out[1])
    if archive is not None:
        stamp = f"{archive}_{datetime.now():%Y%m%d_%H%M%S}"
        kept.write.parquet(f"{stamp}.parquet")
        kept.write.json(f"{stamp}.json")
        out += [f"{stamp}.parquet", f"{stamp}.json"]
    return out


def write_lines(lines: DataFrame, path: str, *order: str) -> None:
    """The column line as one text file in that order: reports, headers."""
    lines.orderBy(*order).select("line").coalesce(1).write.mode("overwrite").text(path)


def write_headers(headers: DataFrame, path: str) -> None:
    """Distinct headers in order, one a line."""
    write_lines(headers.select(F.col("header").alias("line")).where("line is not null").distinct(), path, "line")


def write_record(record: DataFrame, path: str) -> None:
    """A report or manifest of one row as JSON."""
    record.coalesce(1).write.mode("overwrite").json(path)


def write_pairs(pairs: DataFrame, summary: DataFrame, path: str, archive: str) -> None:
    """Question and answer pairs now and in a dated archive, their summary beside them."""
    pairs.write.mode("overwrite").json(path)
    pairs.sparkSession.read.schema(pairs.schema).json(path).write.json(f"{archive}_{datetime.now():%Y%m%d_%H%M%S}")
    write_record(summary, f"{path}_summary")


def write_threads(threads: DataFrame, path: str) -> None:
    """Threads as JSON by language, with a manifest of how many there are."""
    threads.write.mode("overwrite").partitionBy("language").json(path)
    write_record(threads.agg(F.count("*").alias("threads"), F.coalesce(F.sum(F.size("posts")), F.lit(0)).alias("posts"), F.sort_array(F.collect_set("language")).alias("languages")), f"{path}_manifest")


def write_rejects(paragraphs: DataFrame, path: str) -> DataFrame:
    """Paragraphs (with skip_reason) that are kept; the others are written by reason."""
    paragraphs.where("skip_reason is not null").write.mode("overwrite").partitionBy("skip_reason").json(path)
    return paragraphs.where("skip_reason is null").drop("skip_reason")


def with_fields(index: DataFrame, fields: dict[str, str]) -> DataFrame:
    """index with further fields (name and type), null where they were not there before."""
    return index.withColumns({k: F.lit(None).cast(v) for k, v in fields.items() if k not in index.columns})


def filled(index: DataFrame, field: str, value: object) -> DataFrame:
    """index with value where the field is missing."""
    return index.withColumn(field, F.coalesce(F.col(field), F.lit(value)) if field in index.columns else F.lit(value))


def backup(spark: SparkSession, path: str) -> str | None:
    """Move what is at path aside under a dated name, which it gives; None where there is nothing."""
    fs = spark._jvm.org.apache.hadoop.fs
    at = fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(at):
        return None
    aside = f"{path}.{datetime.now():%Y%m%d_%H%M%S_%f}.bak"
    store.rename(at, fs.Path(aside))
    return aside


def update_config(spark: SparkSession, path: str, characters: dict[str, str], patterns: list[dict[str, str]]) -> dict:
    """Learnt settings added to those of a JSON file, where entries that are there win; the file is kept aside first. Settings have the driver's size."""
    from .readers import config

    old = config(spark, path)
    have = {p.get("pattern") for p in old["word_patterns"]}
    new = old | {"character_map": characters | old["character_map"], "word_patterns": old["word_patterns"] + [p for p in patterns if p.get("pattern") not in have]}
    backup(spark, path)
    spark.createDataFrame([(json.dumps(new, ensure_ascii=False),)], "value string").coalesce(1).write.text(path)
    return new


def write_terms(terms: DataFrame, path: str) -> None:
    """Sorted terms, written only if nothing is there."""
    terms.orderBy(F.lower("term")).write.mode("ignore").csv(path)


def add_corrections(old: DataFrame, new: DataFrame, protected: DataFrame, path: str) -> None:
    """Distinct corrections of both, sorted without case, without protected terms, written to another path."""
    both = old.unionByName(new).distinct().withColumn("term", F.lower("original"))
    both.join(protected.select("term"), "term", "left_anti").drop("term").orderBy(F.lower("original"), "original", "correction").write.mode("overwrite").csv(path, header=True)
