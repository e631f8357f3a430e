"""Five stages from raw documents to token files.

Each stage gets what its predecessor kept, as Parquet reread, and its decisions
take effect. All but the last return the columns of documents.

Cases: null and empty texts score by the classifier's bias, are no copies of
anything, hold no benchmark passage and are never taken by the
mix (no words); null ids come first in the token files; of equal texts the least
id stays (a null id only where no other is there), of rows that repeat id and
text one; columns other than those of documents are carried along, but names that
begin with __fs_ are the operators' own; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import decontaminate, mixing, neardup, quality, tokens
from folioscope.llm.common import shared_path, table


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return neardup.keep_one(docs)


def not_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of the benchmark occurs."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of each document in the token files."""
    return tokens.digests(spark, docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_text),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", not_benchmark),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", token_files),
]
#: Trained, searched and tokenised stages have no SQL; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_path(spark, f"stage-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
