"""Secret scans that weigh candidates by who owns their copies.

Each whole text is searched for assignments, access keys, long hexadecimal runs
and other long mixed runs. Hashes of the values (never the values) are counted
over the corpus by distinct repositories and distinct owners: a value that
several owners have in several repositories is a copied example, any other is
owner-specific and may be live. Base kinds are always reported; a long run that
no base span covers is reported as kind `key` if it is owner-specific and has
the entropy of a credential.

Cases: null texts are empty and have no spans; null owners are one owner; each
row is reported once, also where ids or whole rows repeat; spans that start
together are ordered by kind; positions are code points, ends exclusive; other
columns are not looked at; an empty table gives no rows; a text of any length is
searched as a whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import materialise, sent, small_batches, texts_of, tidied

KINDS = ("assign", "access", "hex", "key")
NAMES = ("password", "passwd", "secret", "token", "api")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Access keys and long hexadecimal runs lie within such runs.
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")


def entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of everything that may be a secret, by start and kind."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    runs = list(RUN.finditer(text))
    for r in runs:
        out += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text, r.start(), r.end()) if len(m[0]) >= 20]
        out += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text, r.start(), r.end())]
    base = [x[1:3] for x in out]
    for r in runs:
        v = r[0]
        if not any(s < r.end() and r.start() < e for s, e in base) and any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and entropy(v) >= 3.5:
            out.append((3, r.start(), r.end(), v))
    return sorted(out, key=lambda x: (x[1], x[0]))


FOUND = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))


FOUND_TYPE = ArrayType(StructType([StructField("kind", IntegerType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("value", StringType())]))


def extract(docs: DataFrame, owner: str, repository: str | None) -> DataFrame:
    """A table of doc_id, owner, repository (default: a digest of the text) and found candidates, a row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tidied(batches):
            found, digests = [], []
            for _, texts in texts_of(b):
                for t in texts:
                    found.append([{"kind": k, "start": s, "end": e, "value": hashlib.blake2b(v.encode(), digest_size=16).hexdigest()} for k, s, e, v in candidates(t)])
                    digests.append(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest())
            repos = b.column("repository").cast(pa.string()) if repository else pa.array(digests, pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("owner"), repos, pa.array(found, FOUND)], names=["doc_id", "owner", "repository", "found"])

    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col(owner).cast("string").alias("owner"), *([F.col(repository).cast("string").alias("repository")] if repository else []), "text")
    schema = docs.select("doc_id").schema.add("owner", "string").add("repository", "string").add("found", FOUND_TYPE)
    return materialise(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "secrets")


def ownership(found: DataFrame) -> DataFrame:
    """value, repositories and owners: in how many distinct ones each value stands."""
    values = found.where(F.size("found") > 0).select(F.explode("found.value").alias("value"), F.coalesce("repository", F.lit("\x00")).alias("r"), F.coalesce("owner", F.lit("\x00")).alias("o"))
    return values.groupBy("value").agg(F.count_distinct("r").alias("repositories"), F.count_distinct("o").alias("owners"))


def scan(docs: DataFrame, *, owner: str = "source", repository: str | None = None, example_owners: int = 3, example_repositories: int = 3) -> DataFrame:
    """doc_id and findings (kind, start, end, repositories, owners, example) of each row, by start and kind."""
    found = extract(docs, owner, repository)
    some = found.where(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", "f.*")
    judged = some.join(sent(materialise(ownership(found), "secret-owners")), "value").withColumn("example", (F.col("owners") >= example_owners) & (F.col("repositories") >= example_repositories))
    kind = F.element_at(F.lit(list(KINDS)), F.col("kind") + 1)
    lists = (
        judged.where((F.col("kind") < 3) | ~F.col("example"))
        .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", F.col("kind").alias("k"), "end", kind.alias("kind"), "repositories", "owners", "example"))).alias("findings"))
    )
    none = F.array().cast(lists.schema["findings"].dataType)
    some = found.where(F.size("found") > 0).select("row", "doc_id").join(lists, "row", "left").select("doc_id", F.coalesce("findings", none).alias("findings"))
    return some.union(found.where(F.size("found") == 0).select("doc_id", none.alias("findings")))
