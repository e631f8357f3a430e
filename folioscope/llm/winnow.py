"""Document fingerprints by winnowing, in DataFrame functions alone.

Tokens are lower-cased words of at most 16 characters; longer runs of what is not
ASCII white space (text without spaces, codes) count character by character, so
tokens never depend on where a run begins. Hashes of K tokens roll over the text by
doubling (of one, two, four tokens); of every W neighbours the least is chosen, of
equals the rightmost, and its position is kept. Any K + W - 1 tokens that two texts
share therefore leave a common fingerprint, wherever they stand. Hash and position share one long, so that
the least long is the choice; minima of W are minima of minima (2, 4, 8).

Cases: a null or empty text has no fingerprint; a text of fewer than K tokens
has that of all its tokens, one of fewer than W hashes has the least; equal
texts have equal fingerprints; two empty fingerprints are alike (1); ids must be
integers, null ids come last, equal ids are ordered by a hash of the text and
then by the text; rows that repeat id and text follow each other and are ordered
in one task; other columns are left out; an empty table gives no rows; a text
holds as many as 2**30 tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, sent

K, W = 4, 8
_CHAR = r"[^\x20\x09-\x0D]"
#: A whole word, or a character of a longer run.
TOKEN = rf"(?<!{_CHAR}){_CHAR}{{1,16}}+(?!{_CHAR})|{_CHAR}"
#: Bits of a position; the rest are the hash.
PLACE = 30


def _neighbours(a: Column, apart: int, f) -> Column:
    n = F.greatest(F.size(a) - apart, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(a, 1 + apart, n), f)


def add_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with column out: the chosen hashes of text, in order, each with its position."""
    t, g, m = f"__fs_t_{out}", f"__fs_g_{out}", f"__fs_m_{out}"
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKEN), F.lit(0))
    df = df.withColumn(t, F.transform(words, lambda w: F.xxhash64(w)))
    df = df.withColumn(g, _neighbours(F.col(t), 1, lambda a, b: F.xxhash64(a, b)))
    grams = _neighbours(F.col(g), 2, lambda a, b: F.xxhash64(a, b))
    few = F.when(F.size(t) == 0, F.col(t)).otherwise(F.array(F.xxhash64(F.col(t))))
    df = df.withColumn(g, F.when(F.size(t) >= K, grams).otherwise(few))
    last = (1 << PLACE) - 1
    df = df.withColumn(m, F.transform(F.col(g), lambda h, i: F.shiftleft(F.shiftrightunsigned(h, PLACE), PLACE) + (F.lit(last).cast("long") - i)))
    few = F.when(F.size(m) == 0, F.col(m)).otherwise(F.array(F.array_min(m)))
    df = df.withColumn(g, few)
    apart = 1
    while apart < W:
        df = df.withColumn(m, _neighbours(F.col(m), apart, lambda a, b: F.least(a, b)))
        apart *= 2
    return df.withColumn(out, F.when(F.size(m) > 0, F.array_distinct(m)).otherwise(F.col(g))).drop(t, g, m)


def shown(fingerprint: Column) -> Column:
    """hash:position of each choice, comma-joined."""
    last = (1 << PLACE) - 1
    return F.array_join(F.transform(fingerprint, lambda x: F.concat_ws(":", F.lower(F.hex(F.shiftrightunsigned(x, PLACE))), F.lit(last) - x.bitwiseAND(F.lit(last).cast("long")))), ",")


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftrightunsigned(x, PLACE)))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes, of two lists of distinct ones."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def _placed(keyed: DataFrame, rows: int) -> DataFrame:
    """keyed (key, text) with tie (a hash of the text) and bucket: ranges of about rows documents in descending key.

    At most 1024 quantiles of the keys are looked up by binary search; each is cut
    evenly, by its keys or, where it is one key (or null), by ties, into as many
    ranges as its documents ask for. So ranges follow the number of documents.
    """
    cuts = keyed.agg(F.percentile_approx("key", [k / 1024 for k in range(1, 1024)], 20_000)).first()[0] or []
    cuts = sorted(set(cuts))
    steps = F.lit([1 << k for k in reversed(range(len(cuts).bit_length()))]).cast("array<int>")
    known = F.lit(cuts).cast("array<bigint>")
    fits = lambda at, p: (at + p <= len(cuts)) & (F.get(known, at + p - 1) < F.col("key"))
    quantile = F.aggregate(steps, F.lit(0), lambda at, p: F.when(fits(at, p), at + p).otherwise(at)) if cuts else F.lit(0)
    cut = keyed.withColumn("tie", F.xxhash64("text")).withColumn("quantile", F.when(F.col("key").isNull(), -1).otherwise(quantile))
    stats = cut.groupBy("quantile").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()  # at most 1025 rows
    by = {r[0]: (-(-r.n // rows), r.low, r.high) for r in stats}
    order = range(-1, len(cuts) + 1)
    of = lambda values: F.get(F.lit(values), F.col("quantile") + 1)
    none = (1, None, None)
    ranges = of([by.get(q, none)[0] for q in order])
    low = of([float(by.get(q, none)[1] or 0) for q in order])
    wide = of([float((by.get(q, none)[2] or 0) - (by.get(q, none)[1] or 0)) for q in order])
    part = F.floor((F.col("key").cast("double") - low) / wide * ranges)
    split = any(n > 1 and a == b for n, a, b in by.values())
    tied = F.floor((F.col("tie").cast("double") / F.lit(2.0**64) + 0.5) * ranges) if split else F.lit(0).cast("long")
    part = F.when(wide > 0, F.least(ranges - 1, part)).otherwise(ranges - 1 - F.least(ranges - 1, tied))
    return cut.withColumn("bucket", -(F.col("quantile").cast("long") * F.lit(1 << 32) + part)).drop("quantile")


def edits(docs: DataFrame, *, rows: int = 2000) -> DataFrame:
    """doc_id, text, edited and what fingerprints say of them, for docs and their edited texts.

    An edited text has its last third replaced by the start of the next document
    in descending doc_id (after the last: the first). Ids fall into ranges of
    about rows documents; each range ends with a ghost, a copy of the document that
    opens the next, so no order over all rows is needed.
    """
    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError("ids must be integers")
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("key"))
    keyed = _placed(keyed, rows).withColumn("key", F.coalesce("key", F.lit(-(1 << 63))))
    tops = keyed.groupBy("bucket").agg(F.max("key").alias("key"))
    ring = Window.orderBy("bucket")  # a row for each range
    tops = tops.select("bucket", "key", F.lag("bucket").over(ring).alias("to"), F.max("bucket").over(Window.partitionBy()).alias("last"))
    tops = sent(materialise(tops.select("bucket", "key", F.coalesce("to", "last").alias("to")), "winnow-ranges"))
    ghosts = keyed.join(tops, ["bucket", "key"])
    ghosts = ghosts.withColumn("n", F.row_number().over(Window.partitionBy("bucket").orderBy("tie", "text"))).where("n = 1")
    ghosts = ghosts.select("doc_id", "text", "key", "tie", F.col("to").alias("bucket"), F.lit(1).alias("ghost"))
    rows_ = keyed.withColumn("ghost", F.lit(0)).unionByName(ghosts)
    in_order = Window.partitionBy("bucket").orderBy("ghost", F.desc("key"), "tie", "text")
    held = rows_.withColumn("next", F.lead("text").over(in_order))
    held = add_fingerprint(held, "text", "fp").withColumn("own", hashes(F.col("fp")))
    held = held.withColumn("near_by", F.lead("own").over(in_order)).where("ghost = 0")
    held = held.withColumn("n_chars", F.length("text").cast("long")).withColumn("cut", F.floor(F.col("n_chars") / 3).cast("int"))
    held = held.withColumn("edited", F.concat(F.left("text", F.col("n_chars").cast("int") - F.col("cut")), F.left("next", F.col("cut"))))
    held = add_fingerprint(held, "edited", "edited_fp")
    return held.select(
        "doc_id", "text", "edited", "n_chars", "fp", "edited_fp",
        likeness(F.col("own"), hashes(F.col("edited_fp"))).alias("near_edited"), likeness(F.col("own"), F.col("near_by")).alias("near_next"),
    )
