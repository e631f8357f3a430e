"""Readers of chunk, question, term and thread files. Schemas are given, so no file is read to guess them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.threads import POST

CHUNK = "text string, page bigint, section string, subsection string, chunk_index bigint, doc_type string, created_at string"
FORUM = (
    "id string, source string, thread_id string, thread_url string, question string, answer string, "
    "raw_answers array<struct<author:string,content:string,cleaned_content:string,date:string,score:int,rank:int>>, metadata struct<useful_answer_count:int,answer_count:int,language:string>"
)
FAQ = "question string, answer string, faq_id string, source_file string, source string, section string, doc_type string, extraction_method string, quality_score double, extraction_confidence double"
THREAD = f"thread_id string, url string, title string, scraped_date string, language string, post_count int, posts array<{POST}>"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True, mode="PERMISSIVE")


def chunks(spark: SparkSession, path: str, method: str, priority: int = 50) -> DataFrame:
    """Chunks from Parquet or, where path ends in .json, from JSON; method is pdf or ocr."""
    df = _json(spark, path, CHUNK) if path.endswith(".json") else spark.read.parquet(path)
    have = set(df.columns)
    default = {"source_type": F.lit("rulebook"), "extraction_method": F.lit(method), "priority": F.lit(priority), "quality_score": F.lit(50.0), "extraction_confidence": F.lit(0.5)}
    return df.withColumns({k: F.coalesce(F.col(k), v) if k in have else v for k, v in default.items()})


def forum(spark: SparkSession, path: str, priority: int = 30) -> DataFrame:
    """Question and answer pairs of a forum as chunks: quality is 10 times the count of useful answers."""
    useful = F.coalesce("metadata.useful_answer_count", F.lit(0))
    return _json(spark, path, FORUM).select(
        F.col("question").alias("text"), "answer", F.lit("forum").alias("source_type"), F.lit("forum_scraper").alias("extraction_method"), F.lit(priority).alias("priority"),
        (useful * 10).cast("double").alias("quality_score"), F.least(F.lit(1.0), useful / 10).alias("extraction_confidence"), "thread_id", F.col("thread_url").alias("url"),
        F.coalesce(F.get("raw_answers", F.lit(0))["author"], F.lit("")).alias("answer_user"), F.col("id").alias("qa_id"), F.lit("forum_qa").alias("doc_type"),
    )


def faq(spark: SparkSession, path: str, priority: int = 45) -> DataFrame:
    """Official answers as chunks; entries without an id are numbered in their file's order (an array in a file, which one task reads), further files by name."""
    q = _json(spark, path, FAQ).withColumns({"_f": F.col("_metadata.file_path"), "_k": F.monotonically_increasing_id()})
    sizes = q.groupBy("_f").agg(F.count("*").alias("_size"))  # a row for each file
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_f").orderBy("_k"))
    q = q.withColumn("_within", within).join(before.select("_f", "_before"), "_f").withColumn("n", F.col("_before") + F.col("_within"))
    default = {"extraction_method": "manual", "quality_score": 75.0, "extraction_confidence": 1.0, "source_file": "", "source": "official_faq", "section": "", "doc_type": "faq_qa"}
    filled = [F.coalesce(k, F.lit(v)).alias(k) for k, v in default.items()]
    return q.select(F.col("question").alias("text"), "answer", F.lit("faq").alias("source_type"), F.lit(priority).alias("priority"), F.coalesce("faq_id", F.concat(F.lit("faq_"), F.col("n").cast("string"))).alias("faq_id"), *filled)


def threads(spark: SparkSession, path: str) -> DataFrame:
    """Threads of a directory of JSON files, manifests and unreadable files left out."""
    df = spark.read.schema(THREAD).json(path, multiLine=True, mode="PERMISSIVE", pathGlobFilter="*.json").withColumn("_f", F.col("_metadata.file_name"))
    return df.where("_f <> 'manifest.json' and thread_id is not null").drop("_f")


def questions(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """question and ground_truth (nan: null) of a CSV with a header, on demand the first most of them.

    Values may hold line breaks, so a file is one task's and its rows keep their order; files are ordered by name.
    """
    q = spark.read.schema("question string, ground_truth string").csv(path, header=True, multiLine=True, escape='"')
    order = Window.orderBy("_f", "_k")  # a set of questions, not a corpus
    q = q.withColumns({"_f": F.col("_metadata.file_path"), "_k": F.monotonically_increasing_id()}).withColumn("place", F.row_number().over(order) - 1)
    q = q.select("question", F.when(F.col("ground_truth") != "nan", F.col("ground_truth")).alias("ground_truth"), "place")
    return (q if most is None else q.where(F.col("place") < most)).drop("place")


def terms(spark: SparkSession, path: str, comments: bool = True, stripped: bool = True) -> DataFrame:
    """Distinct lower-case terms, one a line; where there are comments, lines that start with # are left out.

    Lists of protected terms have neither comments nor blanks to strip.
    """
    reader = spark.read.schema("term string")
    t = reader.csv(path, comment="#") if comments else reader.csv(path)
    return t.select(F.lower(F.trim("term") if stripped else F.col("term")).alias("term")).where("term <> ''").distinct()


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """fragment and full_word; of equal fragments the last one holds: the last line of the last file by name."""
    df = spark.read.schema("fragment string, full_word string").csv(path, header=True)
    order = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return df.select("fragment", "full_word", order.alias("n")).groupBy("fragment").agg(F.max_by("full_word", "n").alias("full_word"))


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    """page and text of recognised pages named page_<number>.txt."""
    df = spark.read.text(path, wholetext=True, pathGlobFilter="page_*.txt").withColumn("_f", F.col("_metadata.file_name"))
    return df.select(F.regexp_extract("_f", r"page_(\d+)", 1).cast("long").alias("page"), F.col("value").alias("text"))


def embeddings(spark: SparkSession, path: str, column: str = "embedding") -> DataFrame:
    """Parquet whose vectors may be written as text; those become arrays of float."""
    df = spark.read.parquet(path)
    return df.withColumn(column, F.from_json(column, "array<float>")) if dict(df.dtypes)[column] == "string" else df


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Rows of result files with run_ts from names that hold yyyymmdd_hhmmss."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"').withColumn("_f", F.col("_metadata.file_name"))
    return df.withColumn("run_ts", F.try_to_timestamp(F.regexp_extract("_f", r"(\d{8}_\d{6})", 1), F.lit("yyyyMMdd_HHmmss"))).drop("_f")


def missing(spark: SparkSession, path: str) -> bool:
    """Whether nothing is at path (which may be a pattern), in any store that Spark reads."""
    jvm = spark._jvm.org.apache.hadoop.fs
    at = jvm.Path(path)
    return not at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """Question and answer pairs that were written before; none where the file is missing, broken records left out."""
    empty = spark.createDataFrame([], FORUM)
    return empty if missing(spark, path) else _json(spark, path, FORUM).where("id is not null")


def config(spark: SparkSession, path: str) -> dict:
    """Settings of a JSON file (characters and patterns to replace); empty ones where it is missing or broken."""
    none: dict = {"character_map": {}, "word_patterns": []}
    if missing(spark, path):
        return none
    try:
        return none | json.loads("".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))  # a settings file
    except ValueError:
        return none


def pages(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]]) -> DataFrame:
    """file, page (from 1) and text of binary documents. parse gives the texts of a document's pages: a reader of layouts or a recogniser of scans.

    Each file is read whole by one task; files that parse fails on have no pages.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    texts = parse(content)
                except Exception:  # noqa: BLE001  # a parser's own faults
                    texts = []
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(texts), pa.string()), pa.array(range(1, len(texts) + 1), pa.int64()), pa.array(texts, pa.string())], names=["file", "page", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, "file string, page long, text string")


def unified(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Merged chunks and how many each source has."""
    df = spark.read.parquet(path)
    return df, df.groupBy(F.coalesce("source_type", F.lit("rulebook")).alias("source_type")).agg(F.count("*").alias("n"))


def cached_pages(urls: DataFrame, cache: DataFrame, key: str, fetch: Column | None = None) -> DataFrame:
    """urls with html: the cached page where there is one, else what fetch (an Arrow UDF's column, outside this library) gives, else null."""
    return urls.join(cache.select(key, F.col("html").alias("_cached")), key, "left").withColumn("html", F.coalesce("_cached", F.lit(None).cast("string") if fetch is None else fetch)).drop("_cached")
