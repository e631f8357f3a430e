"""The queries of this subpackage, by name, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hmm, mixing, neardup, quality, secrets, sharding, tokens, urls, winnow
from .common import sent, table

SHARDS = [f"shard-{k:02d}" for k in range(64)]
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def crc_mod(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each whole text, learnt from labels of rows that aren't held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, eligible=crc_mod(3) != 1)
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(crc_mod(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    return tokens.digests(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document and how widely they are copied."""
    found = secrets.scan(table(spark, sf_dir, "documents"))

    def spans(keep=None):
        f = F.col("findings") if keep is None else F.filter("findings", keep)
        return F.array_join(F.transform(f, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{k}") for k in secrets.KINDS[:3]]
    return found.select(
        "doc_id", *counts, F.sha2(spans(lambda x: x["k"] < 3).cast("binary"), 256).alias("base_sha256"), spans().alias("spans"),
        F.size(F.filter("findings", lambda x: x["example"])).cast("long").alias("n_example"), F.size(F.filter("findings", lambda x: ~x["example"])).cast("long").alias("n_live"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of each document, of 64."""
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), SHARDS)


def op5_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and its edited text, and how alike they are."""
    e = winnow.edits(table(spark, sf_dir, "documents"))
    return e.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), winnow.shown(F.col("fp")).alias("fingerprint"), winnow.shown(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next")


def op6_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihoods of all texts under unigrams and a hidden Markov model."""
    return hmm.score(table(spark, sf_dir, "documents"), held_out=crc_mod(7) == 2)


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url: the longest rule's, else that of the link graph."""
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents takes of each."""
    taken, sources = mixing.shares(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    own = taken.withColumn("source", F.element_at("members", 1))
    return own.join(sent(sources.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", "taken")  # a row per source


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of each document."""
    return neardup.classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that occur in benchmark items, and the items."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct("found.matches.item_id"))
    hit = F.size("found.hits").cast("long")
    return found.withColumn("items", items).select("doc_id", F.col("found.n_words").alias("n_words"), hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality, op2_tokens, op3_secrets, op4_sharding, op5_winnow, op6_hmm, op7_urls, op8_mixing, op9_neardup, op10_decontaminate)
}
#: None of these has a form in SQL that is the operator's method; tests/llm holds each against brute force.
SQL: dict[str, str] = {}
