"""Mixing overlapping sources to target weights by min-cost flow.

Documents are summed by membership pattern (the set of sources they belong to).
A flow routes each pattern's words to its sources' quotas; a first pass over a
pattern is free and every further pass costs more (convex), so repeats are used
only where quotas need them. Each pattern's flow becomes a seeded choice of
whole documents: those of the least hashes up to the amount; then, past the one that
doesn't fit, those that are small enough, until little is left; then a few by size that
come near the rest.

Cases: a null text has no words; a null source is a source of its own, ordered
last; rows that share id and text are chosen together; an empty table gives no
rows; documents without words are never taken (0 words), and mix() drops them;
further columns are kept by mix(), names that begin with __fs_ are its own.
The driver holds a few numbers per pattern and per source, never documents.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SENT_ROWS, WORD, materialise, text_key

BUCKETS = 4096


def n_words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def fill_targets(sizes: dict, order: Sequence, weights: dict, left: float, most: float) -> dict[object, float]:
    """Parts of left by weight; what is above most * size goes to the others, by weight."""
    free, out = list(order), {}
    while free:
        unit = left / sum(weights[s] for s in free)
        above = [s for s in free if unit * weights[s] > most * sizes[s]]
        if not above:
            return out | {s: unit * weights[s] for s in free}
        out |= {s: float(most * sizes[s]) for s in above}
        left -= sum(most * sizes[s] for s in above)
        free = [s for s in free if s not in out]
    return out


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each (from, to, capacity, cost) of a largest flow of least cost, by shortest paths with potentials."""
    to, room, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in arcs:
        for x, y, z, v in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            room.append(z)
            cost.append(v)
    potential = [0] * n
    while True:
        far, via = [None] * n, [-1] * n
        far[source], queue = 0, [(0, source)]
        while queue:
            d, x = heapq.heappop(queue)
            if d > far[x]:
                continue
            for e in out[x]:
                if room[e] and (far[to[e]] is None or d + cost[e] + potential[x] - potential[to[e]] < far[to[e]]):
                    far[to[e]] = d + cost[e] + potential[x] - potential[to[e]]
                    via[to[e]] = e
                    heapq.heappush(queue, (far[to[e]], to[e]))
        if far[sink] is None:
            return [room[2 * k + 1] for k in range(len(arcs))]
        potential = [p + (f if f is not None else 0) for p, f in zip(potential, far, strict=True)]
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = to[via[x] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push


def connected(patterns: dict[str, tuple[list, int]]) -> list[list[str]]:
    """Patterns in groups that share no source with each other."""
    of: dict[object, object] = {}

    def root(s: object) -> object:
        while of.setdefault(s, s) != s:
            of[s] = s = of[of[s]]
        return s

    for members, _ in patterns.values():
        for s in members:
            of[root(s)] = root(members[0])
    out: dict[object, list[str]] = {}
    for p, (members, _) in patterns.items():
        out.setdefault(root(members[0]) if members else None, []).append(p)
    return list(out.values())


def route(patterns: dict[str, tuple[list, int]], targets: dict[object, float], most: int) -> dict[str, int]:
    """Words that each pattern (members, size) gives in all; each group of overlapping patterns is a flow of its own."""
    given = dict.fromkeys(patterns, 0)
    for names in connected(patterns):
        sources = list(dict.fromkeys(s for p in names for s in patterns[p][0] if s in targets))
        at = {s: 1 + len(names) + k for k, s in enumerate(sources)}
        sink, arcs = 1 + len(names) + len(sources), []
        for k, p in enumerate(names):
            members, size = patterns[p]
            arcs += [(0, 1 + k, size, turn * turn) for turn in range(most)]
            arcs += [(1 + k, at[s], most * size, 0) for s in members if s in at]
        arcs += [(at[s], sink, round(targets[s]), 0) for s in sources]
        for (a, b, _, _), f in zip(arcs, min_cost_flow(sink + 1, arcs, 0, sink), strict=True):
            if a == 0:
                given[names[b - 1]] += f
    return given


def fit_rest(rest: int, offers: list[tuple[int, int]]) -> list[int]:
    """Hashes of (size, hash) that together come near rest: the largest that fit, then one more if that comes nearer."""
    out = []
    for size, h in sorted(offers, reverse=True):
        if size <= rest:
            out.append(h)
            rest -= size
    over = min(((size - rest, h) for size, h in offers if h not in out), default=(rest, None))
    return out + [over[1]] if abs(over[0]) < rest else out


def keyed(docs: DataFrame, members: Column, seed: int) -> DataFrame:
    """docs with __fs_members, __fs_pattern, __fs_size and the seeded hash __fs_h that orders a pattern's documents."""
    # null sorts last as the source's name is compared by code point and the empty array slot is marked apart
    return docs.withColumn("__fs_members", F.sort_array(F.array_distinct(members))).select(
        *docs.columns, "__fs_members",
        F.to_json(F.struct(F.col("__fs_members").alias("m")), {"ignoreNullFields": "false"}).alias("__fs_pattern"),
        n_words(F.col("text")).alias("__fs_size"), F.xxhash64(F.lit(seed), text_key()).alias("__fs_h"),
    )


def _few(df: DataFrame, rows: int) -> DataFrame:
    """df of so many rows, broadcast where that is few enough."""
    return F.broadcast(df) if rows <= SENT_ROWS else df


def least_hashes(narrow: DataFrame, wanted: dict[str, tuple[int, int, int]]) -> dict[str, tuple[int, int]]:
    """Of each pattern (wanted: words, least hash, most words of a document): the last hash up to which documents fit, and their words."""
    rows = [(p, *w) for p, w in wanted.items()]
    state = _few(narrow.sparkSession.createDataFrame(rows, "__fs_pattern string, part long, low long, most long"), len(rows))
    fit = narrow.join(state, "__fs_pattern").where((F.col("__fs_h") >= F.col("low")) & F.col("__fs_size").between(1, F.col("most")))
    bucket = (F.shiftright("__fs_h", 52) + BUCKETS // 2).alias("bucket")
    running = Window.partitionBy("__fs_pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = fit.groupBy("__fs_pattern", "part", bucket).agg(F.sum("__fs_size").alias("s"), F.max("__fs_h").alias("high"))
    sums = sums.withColumn("base", F.coalesce(F.sum("s").over(running), F.lit(0)))
    whole = F.col("base") + F.col("s") <= F.col("part")
    ends = sums.groupBy("__fs_pattern").agg(
        F.max(F.when(whole, F.col("high"))).alias("high"), F.max(F.when(whole, F.col("base") + F.col("s"))).alias("upto"),
        F.min(F.when(~whole & (F.col("base") <= F.col("part")), F.col("bucket"))).alias("cut"),
    ).collect()
    out = {r[0]: (r.high, r.upto) for r in ends if r.high is not None}
    cuts = [(r[0], r.cut, r.upto or 0) for r in ends if r.cut is not None]
    if cuts:
        at = _few(narrow.sparkSession.createDataFrame(cuts, "__fs_pattern string, bucket long, base long"), len(cuts))
        inside = fit.withColumn("bucket", bucket).join(at, ["__fs_pattern", "bucket"]).groupBy("__fs_pattern", "part", "base", "__fs_h").agg(F.sum("__fs_size").alias("s"))
        upto = Window.partitionBy("__fs_pattern").orderBy("__fs_h").rowsBetween(Window.unboundedPreceding, 0)
        inside = inside.withColumn("upto", F.col("base") + F.sum("s").over(upto)).where(F.col("upto") <= F.col("part"))
        out |= {r[0]: (r["last"], r.upto) for r in inside.groupBy("__fs_pattern").agg(F.max("__fs_h").alias("last"), F.max("upto").alias("upto")).collect()}
    return out


def plan(narrow: DataFrame, *, cycle: Sequence[float], share: float, most: int, near: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """From rows of keyed(): what each pattern gives, and each source's size and target.

    Rounds over the hashes end when less than near of a pattern's amount is left
    or no document is small enough for it.
    """
    spark = narrow.sparkSession
    sums = narrow.groupBy("__fs_pattern").agg(F.sum("__fs_size").alias("size"), F.min("__fs_members").alias("members")).collect()  # a row per pattern
    patterns = {r[0]: (list(r.members), r["size"]) for r in sums}
    sizes: dict[object, int] = {}
    for members, size in patterns.values():
        for s in members:
            sizes[s] = sizes.get(s, 0) + size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = fill_targets(sizes, order, {s: cycle[k % len(cycle)] for k, s in enumerate(order)}, share * sum(n for _, n in patterns.values()), most)
    given = route(patterns, targets, most)
    sources = spark.createDataFrame([(s, sizes[s], float(targets[s])) for s in order], "source string, source_size long, target double")
    whole = {p: given[p] // size if size else 0 for p, (_, size) in patterns.items()}
    part = {p: given[p] - whole[p] * patterns[p][1] for p in patterns}
    rest = {p: n for p, n in part.items() if n}
    low = dict.fromkeys(rest, -(1 << 63))
    runs: dict[str, list[tuple[int, int, int]]] = {p: [] for p in patterns}
    wanted = {p: (n, low[p], (1 << 62)) for p, n in rest.items()}
    while wanted:
        found = least_hashes(narrow, wanted)
        again = {}
        for p, (_, start, most_words) in wanted.items():
            if p in found:
                last, words = found[p]
                runs[p].append((start, last, most_words))
                rest[p] -= words
                low[p] = last + 1
                fits = rest[p] > near * part[p] and last < (1 << 63) - 1
            else:
                fits = most_words == 1 << 62  # only the first document was too long
            if fits:
                again[p] = (rest[p], low[p], rest[p])
        wanted = again
    left = [(p, low[p], n) for p, n in rest.items() if n]
    offers: dict[str, list[tuple[int, int]]] = {}
    if left:
        least = Window.partitionBy("__fs_pattern", "class").orderBy("__fs_h")
        state = _few(spark.createDataFrame(left, "__fs_pattern string, low long, rest long"), len(left))
        small = (
            narrow.join(state, "__fs_pattern").where((F.col("__fs_h") >= F.col("low")) & F.col("__fs_size").between(1, 2 * F.col("rest")))
            .groupBy("__fs_pattern", "__fs_h").agg(F.sum("__fs_size").alias("s")).withColumn("class", F.floor(F.log2("s")))
            .withColumn("n", F.row_number().over(least)).where("n <= 8").select("__fs_pattern", "__fs_h", "s")
        )
        for r in small.collect():  # at most eight for each doubling of size, a pattern
            offers.setdefault(r[0], []).append((r.s, r[1]))
    extra = {p: fit_rest(n, offers.get(p, [])) for p, _, n in left}
    table = [(p, whole[p], runs[p], extra.get(p, [])) for p in patterns]
    return spark.createDataFrame(table, "__fs_pattern string, __fs_whole long, __fs_runs array<struct<first:long,last:long,most:long>>, __fs_extra array<long>"), sources


def copies(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows of keyed() with __fs_copies, how often the mix takes each."""
    h, size = F.col("__fs_h"), F.col("__fs_size")
    more = F.exists("__fs_runs", lambda r: (h >= r["first"]) & (h <= r["last"]) & (size <= r["most"])) | F.array_contains("__fs_extra", h)
    taken = F.when(size > 0, F.col("__fs_whole") + more.cast("long")).otherwise(0)
    return rows.join(_few(cuts, cuts.count()), "__fs_pattern").withColumn("__fs_copies", taken)  # a row per pattern


def shares(docs: DataFrame, *, members: Column | None = None, cycle: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 8) -> tuple[DataFrame, DataFrame]:
    """doc_id, members, size and taken of each document; and source, source_size and target of each source."""
    members = F.array("source") if members is None else members
    rows = keyed(docs.select("doc_id", "text", members.alias("__fs_given")), F.col("__fs_given"), seed)
    narrow = materialise(rows.select("doc_id", "__fs_members", "__fs_pattern", "__fs_size", "__fs_h"), "mixing")
    cuts, sources = plan(narrow, cycle=cycle, share=share, most=most)
    out = copies(narrow, cuts)
    return out.select("doc_id", F.col("__fs_members").alias("members"), F.col("__fs_size").alias("size"), (F.col("__fs_size") * F.col("__fs_copies")).alias("taken")), sources


def mix(docs: DataFrame, *, members: Column | None = None, cycle: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 8) -> DataFrame:
    """docs as the mix takes them: a row for each copy, columns as they were."""
    columns = docs.columns
    rows = keyed(docs, F.array("source") if members is None else members, seed)
    narrow = materialise(rows.select("__fs_members", "__fs_pattern", "__fs_size", "__fs_h"), "mixing")
    cuts, _ = plan(narrow, cycle=cycle, share=share, most=most)
    return copies(rows, cuts).where("__fs_copies > 0").select(*columns, F.explode(F.array_repeat(F.lit(1), F.col("__fs_copies").cast("int"))).alias("__fs_one")).drop("__fs_one")
