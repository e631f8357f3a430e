"""Helpers that the operators share: tables, shared storage, text rules."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts name it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder of its own; on a
    cluster that would be a folder of one machine, so this raises instead.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_WRITTEN: list[str] = []


def materialise(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: it cuts lineage and outlives executors."""
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete the tables that this process has materialised; results that were not yet read are lost with them."""
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of the largest table that is sent to all executors; beyond, a shuffle join.
SENT_ROWS = 1_000_000


def sent(table: DataFrame) -> DataFrame:
    """A materialised table of narrow rows, marked for broadcast where its counted size allows that.

    Beyond, the join shuffles both sides as they are read, so that adaptive
    planning can split what is hot on the other side.
    """
    return F.broadcast(table) if table.count() <= SENT_ROWS else table


def free_of(df: DataFrame, *names: str) -> None:
    """Raise where df has a column that an operator is to add."""
    have = {c.lower() for c in df.columns}
    clash = [n for n in names if n.lower() in have]
    if clash:
        raise ValueError(f"columns {clash} are there already: rename them or give other names")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Let Arrow batches to Python hold so many rows at most, so that workers stay small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def tidied(batches: Iterator) -> Iterator:
    """batches, with what earlier tasks of this worker process left given back to the system."""

    def tidy() -> None:
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library, which has no such call

    tidy()
    yield from batches
    tidy()


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def texts_of(batch: pa.RecordBatch, column: str = "text", chars: int = 8_000_000) -> Iterator[tuple[int, list[str]]]:
    """Offsets and texts (null: empty) of a batch, so many bytes of them at a time."""
    col = batch.column(column)
    start, size, part = 0, 0, []
    for i in range(len(col)):
        x = col[i].as_py() or ""
        part.append(x)
        size += len(x)
        if size >= chars:
            yield start, part
            start, size, part = i + 1, 0, []
    if part:
        yield start, part


def array_slices(texts: pa.Array, size: int = 8_000_000) -> Iterator[pa.Array]:
    """texts, about so many bytes of them at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) if len(texts) else []
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield texts.slice(start, stop - start)
        start = stop


def coded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of texts, the code of each token (an end: the number of words) and where texts begin and end."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat = cut.flatten().dictionary_encode()
    codes, bounds = flat.indices.to_numpy(), cut.offsets.to_numpy() - cut.offsets[0].as_py()
    void = pc.index(flat.dictionary, "").as_py()  # beside white space at a text's ends
    if void >= 0:
        word = codes != void
        bounds, codes = np.concatenate([[0], np.cumsum(word)])[bounds], codes[word]
    codes = np.insert(codes, bounds[1:], len(flat.dictionary))
    return flat.dictionary, codes, bounds + np.arange(len(bounds))


def text_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A row's identity where ids may repeat, 128 bits: rows that share it have the same id and text."""
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("\x00")), F.lit("\x01"), text).cast("binary")))
