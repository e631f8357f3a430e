"""URL filters: rules first, then trust that spreads over the link graph.

Personalised PageRank starts from trusted hosts along links and, on reversed
links, from blocked hosts: what links to a blocked host shares its distrust.
Hosts whose distrust outweighs their trust by a ratio are blocked. Links are
absolute links in the pages and, both ways, the tie of a host and of each domain
above it to its parent domain, unless that is a suffix under which strangers
register. Hosts without links give what they have back to the seeds; as that only
scales a walk's ranks, they are scaled to a sum of 1 at the end. Steps go on until no rank changes by more than a
small part of itself: verdicts compare ranks of a host with each other, so ranks of
hosts far from all seeds count as well, however small. The graph and all ranks are
DataFrames; every few steps they are written to the shared folder. Links of hosts
that have very many are dealt over several tasks.

Cases: a null url or one without :// has an empty host and path, fits no rule
and is allowed; null html has no links; hosts of no evidence are allowed; links
to a page's own host don't count; rows that repeat a page are judged each, their
links count each; of equally long rules that fit, the later one holds; other
columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, sent

LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""

ADDRESS = r"\.[0-9]+(:[0-9]*)?$"
# Labels under which countries let others register.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gov", "mil", "ne", "net", "or", "org")
#: Links of a host and direction beyond which they are dealt over several tasks.
HUB = 50_000


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. rules: (allow or block, host/path)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(slash + p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst and weight, from pages' links and from the parent domains of hosts and of these in turn."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("dst"))
    links = links.select("src", ascii_lower(F.col("dst")).alias("dst")).where((F.col("src") != F.col("dst")) & (F.col("src") != ""))
    links = links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    hosts = pages.select("host").union(links.select("dst")).where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    hosts = hosts.select(F.explode(F.when(F.col("host").rlike(ADDRESS), F.array("host")).otherwise(above)).alias("host")).distinct()
    parent = F.regexp_extract("host", r"^[^.]+\.([^.]+\..+)$", 1)
    public = rf"^({'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}(:[0-9]*)?$"
    ties = hosts.select(F.col("host").alias("src"), parent.alias("dst")).where((F.col("dst") != "") & ~F.col("dst").rlike(public))
    both = ties.union(ties.select("dst", "src")).withColumn("weight", F.lit(1.0))
    return links.union(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, *, damping: float = 0.85, tolerance: float = 1e-6, every: int = 4) -> DataFrame:
    """host, trust and distrust. seeds: host, trust and distrust, the weights from which the two walks restart.

    It ends when every steps change no rank by more than tolerance times the rank,
    so that all hosts that a seed reaches have theirs.
    """
    kinds = (("trust", "src", "dst"), ("distrust", "dst", "src"))
    total = seeds.agg(*(F.sum(k).alias(k) for k, _, _ in kinds)).first()
    start = seeds.select("host", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), (F.col(k) / F.lit(float(total[k] or 1))).alias("r")) for k, _, _ in kinds))).alias("s")).select("host", "s.*").where("r > 0")
    start = materialise(start, "url-seeds")
    walk = None
    for k, a, b in kinds:
        out = sent(materialise(edges.groupBy(a).agg(F.sum("weight").alias("all"), F.ceil(F.count("*") / F.lit(HUB)).alias("ways")), "url-out"))
        salt = F.pmod(F.xxhash64(b), F.col("ways")).alias("salt")
        part = edges.join(out, a).select(F.lit(k).alias("kind"), F.col(a).alias("host"), F.col(b).alias("to"), (F.col("weight") / F.col("all")).alias("p"), salt, "ways")
        walk = part if walk is None else walk.union(part)
    walk = materialise(walk, "url-walk")
    hubs = materialise(walk.where("ways > 1").select("kind", "host", "ways").distinct(), "url-hubs")  # few: each has HUB links and more
    hubs = None if hubs.isEmpty() else sent(hubs)

    def spread(ranks: DataFrame) -> DataFrame:
        if hubs is None:
            return ranks.withColumn("salt", F.lit(0).cast("long"))
        each = F.sequence(F.lit(0).cast("long"), F.coalesce("ways", F.lit(1).cast("long")) - 1)
        return ranks.join(hubs, ["kind", "host"], "left").select("kind", "host", "r", F.explode(each).alias("salt"))

    ranks = start
    settled = False
    while not settled:
        before = ranks.withColumnRenamed("r", "was")
        for _ in range(every):
            moved = walk.drop("ways").join(spread(ranks), ["kind", "host", "salt"]).select(F.col("to").alias("host"), "kind", (F.col("p") * F.col("r") * damping).alias("r"))
            ranks = moved.union(start.select("host", "kind", (F.col("r") * (1 - damping)).alias("r"))).groupBy("host", "kind").agg(F.sum("r").alias("r"))
        ranks = materialise(ranks, "url-ranks")
        change = F.abs(F.col("r") - F.coalesce("was", F.lit(0.0)))
        settled = ranks.join(before, ["host", "kind"], "left").where(change > tolerance * F.col("r")).isEmpty()
    whole = ranks.agg(*(F.sum(F.when(F.col("kind") == k, F.col("r"))).alias(k) for k, _, _ in kinds)).first()
    both = {k: (F.sum(F.when(F.col("kind") == k, F.col("r")).otherwise(0.0)) / F.lit(whole[k] or 1.0)).alias(k) for k, _, _ in kinds}
    return materialise(ranks.groupBy("host").agg(*both.values()), "url-hosts")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], *, ratio: float = 1.5, **options) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of each page."""
    split = pages.select("page_id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = split.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    seeds = ruled.where("r is not null and host <> ''").groupBy("host").agg(*(F.sum(F.when(F.col("r.verdict") == v, 1.0).otherwise(0.0)).alias(k) for k, v in (("trust", "allow"), ("distrust", "block"))))
    ranks = sent(propagate(materialise(host_edges(split), "url-edges"), seeds, **options))
    blocked = F.coalesce(F.col("distrust") > F.col("trust") * ratio, F.lit(False))
    return ruled.drop("html").join(ranks, "host", "left").select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
