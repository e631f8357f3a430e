"""Sizes of tables and numbers of tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of the largest table that is broadcast.
SENT_ROWS = 1_000_000


def tasks(df: DataFrame) -> int:
    """Tasks for a stage whose work is large for its bytes, which adaptive planning would put into one."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer tasks; as it is where there are enough, so large tables aren't shuffled.

    Rows are dealt by a hash of all columns: evenly, and alike when a task is repeated.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= n or df.rdd.getNumPartitions() >= n:
        return df
    plain = [c for c, t in df.dtypes if not t.startswith("map")]
    return df.repartition(n, F.xxhash64(*plain)) if plain else df.repartition(n)


def few(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df marked for broadcast if its counted rows (or rows, which it has at most) are few."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= SENT_ROWS else df


def lower_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of the session have at most so many rows (never more than before), so that workers stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def numbered(df: DataFrame, key: str, order: str, out: str, rows: int = 50_000) -> DataFrame:
    """df with out, the place (from 1) of each row among those of its key by order (whole numbers, unique within a key).

    Keys are cut into ranges of the order, of about rows rows where it is even, so that no
    key is one task's; a table with a row for each key and range holds what stands before it.
    """
    n, low, high = df.agg(F.count(order), F.min(order), F.max(order)).first()
    ranges = max(1, (n or 0) // rows)
    wide = max(1.0, float((high or 0) - (low or 0)) + 1)
    part = F.least(F.lit(ranges - 1), F.floor((F.col(order) - F.lit(low or 0)) / F.lit(wide) * ranges).cast("int"))
    cut = df.withColumn("_part", part)
    sizes = cut.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(key).alias("_key"), "_part", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy(key, "_part").orderBy(order))
    met = cut.withColumn("_within", within).join(few(starts), (F.col(key).eqNullSafe(F.col("_key"))) & (cut["_part"] == starts["_part"]))
    return met.select(*df.columns, (F.col("_before") + F.col("_within")).alias(out))
