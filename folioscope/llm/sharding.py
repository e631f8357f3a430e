"""Sharding with a permutation-filled lookup table, in DataFrame functions alone.

Every shard has its own order of preference over a prime number of slots (a
start and a step drawn from its name). Shards take turns at claiming their next
free slot until all are taken, so they hold equal numbers of slots (or numbers
by weight), and adding or removing a shard moves little else. A row's key is
hashed to a slot, and a broadcast join with the table places it.

Cases: a null key hashes as a mark of its own; rows with equal keys share a
shard unless salt > 1 spreads a hot key over so many slots by a hash of the
text; an empty table gives no rows; rows that have columns of the added names
raise; the driver fills a table of fixed size and holds no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_of

#: A prime of the 16-bit range; over a thousand slots for each of 64 shards.
SLOTS = 65537
#: Most slots that a table may have, as it is broadcast.
MOST_SLOTS = 5_000_000


def _draw(name: str, what: str, below: int) -> int:
    return int.from_bytes(hashlib.md5(f"{what}:{name}".encode()).digest()[:8], "big") % below


def fill(names: Sequence[str], slots: int = SLOTS, weights: Sequence[int] | None = None) -> list[int]:
    """The shard (its number) of each slot. weights: claims a shard makes at its turn."""
    if len(set(names)) != len(names) or not names:
        raise ValueError("shards need names of their own")
    weights = [1] * len(names) if weights is None else weights
    if len(weights) != len(names) or min(weights) < 0 or not any(weights):
        raise ValueError("weights are a number for each shard, not below 0 and not all 0")
    if len(names) > slots:
        raise ValueError("there are more shards than slots")
    if slots > MOST_SLOTS or slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime that a broadcast can hold")
    start, step = [_draw(n, "start", slots) for n in names], [_draw(n, "step", slots - 1) + 1 for n in names]
    owner, left = [-1] * slots, slots
    turns = [k for k, w in enumerate(weights) for _ in range(w)]
    while True:
        for k in turns:
            while owner[start[k]] >= 0:
                start[k] = (start[k] + step[k]) % slots
            owner[start[k]] = k
            left -= 1
            if not left:
                return owner


def lookup(spark: SparkSession, names: Sequence[str], slots: int = SLOTS, weights: Sequence[int] | None = None) -> DataFrame:
    """The table as rows (slot, shard, shard_name)."""
    owner = fill(names, slots, weights)
    shard = F.element_at(F.lit(list(names)), F.col("shard") + 1)
    return spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, owner))), ",")).alias("slot", "shard")).withColumn("shard", F.col("shard").cast("int")).withColumn("shard_name", shard)


def slot_of(key: Column, slots: int, salt: int = 1, by: Column | None = None) -> Column:
    named = F.coalesce(key.cast("string"), F.lit("\x00"))
    if salt > 1:
        named = F.concat_ws("\x01", named, F.pmod(F.xxhash64(F.coalesce(by, F.lit(""))), F.lit(salt)).cast("string"))
    return F.pmod(F.xxhash64(named), F.lit(slots)).cast("int")


def place(rows: DataFrame, names: Sequence[str], *, key: str = "doc_id", slots: int = SLOTS, weights: Sequence[int] | None = None, salt: int = 1) -> DataFrame:
    """rows with slot, shard and shard_name added."""
    free_of(rows, "slot", "shard", "shard_name")
    at = slot_of(F.col(key), slots, salt, F.col("text") if salt > 1 else None)
    return rows.withColumn("slot", at).join(F.broadcast(lookup(rows.sparkSession, names, slots, weights)), "slot").select(*rows.columns, "slot", "shard", "shard_name")
