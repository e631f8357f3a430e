"""All queries of the library by name, each with its SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import quality as Q
from ..functions import text as T
from ..operators import retrieve as R
from ..operators.common import few, numbered, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "co_keyword_search"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Text functions


@query(r"""SELECT doc_id, md5(regexp_replace(trim(lower(text)), '\s+', ' ', 'g')) AS plain,
 md5(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))) AS matching,
 md5(regexp_replace(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '[^\p{L}\p{N}_\s]', '', 'g')) AS duplicates FROM documents""")
def sf_normalise(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", F.md5(T.normalised(t)).alias("plain"), F.md5(T.for_matching(t)).alias("matching"), F.md5(T.for_duplicates(t)).alias("duplicates"))


@query(r"""SELECT doc_id, len(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))::BIGINT AS n_sentences,
 len(regexp_split_to_array(text, '[.!?]+'))::BIGINT AS n_clauses,
 len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> ''))::BIGINT AS n_words FROM documents""")
def sf_sentences(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", *(F.size(f(t)).cast("long").alias(n) for n, f in (("n_sentences", T.sentences), ("n_clauses", T.clauses), ("n_words", T.words))))


@query(r"""SELECT doc_id, len(list_distinct(regexp_extract_all(lower(regexp_replace(text, '[^\x00-\x7F]', ' ', 'g')), '\b[a-z]{4,}\b')))::BIGINT AS n_key_words FROM documents""")
def sf_key_words(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(T.key_words(T.ascii_only(F.col("text")))).cast("long").alias("n_key_words"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(t, '@\w+[,:]?', '', 'g'), '\s+', ' ', 'g')) AS cleaned, len(regexp_extract_all(t, '@\w+'))::BIGINT AS mentions
 FROM (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', ' ', 'g') AS t FROM documents)""")
def sf_mentions(spark, d):
    t = T.ascii_only(F.col("text"))
    return read(spark, d, "documents").select("doc_id", T.without_mentions(t).alias("cleaned"), F.regexp_count(t, F.lit(r"@\w+")).cast("long").alias("mentions"))


@query("SELECT event_id, round(1 / (1 + exp(-value / 3)), 9) AS sigmoid, greatest(0, least(1, value)) AS clamped FROM events")
def sf_sigmoid(spark, d):
    return read(spark, d, "events").select("event_id", F.round(T.sigmoid(F.col("value")), 9).alias("sigmoid"), T.clamped(F.col("value")).alias("clamped"))


RUNS = "|".join(f"{c}{{5,}}" for c in "abcdefghijklmnopqrstuvwxyz")
LONG_RUNS = RUNS.replace("5", "8")
SHARE = "regexp_replace({t}, '[^a-zA-Z ]', '', 'g')"
ODD = "CASE WHEN length(c) > 20 THEN length(regexp_replace(c, '[^aeiouAEIOU ]', '', 'g')) / length(c) END"
SPLIT_SQL = r"list_filter(regexp_split_to_array({t}, '\s+'), lambda w: w <> '')"
QUALITY_SQL = rf"""SELECT doc_id, text, lang, source, CASE WHEN text IS NULL OR length(text) < 20 THEN 0.0 ELSE greatest(0, least(100,
 100 - 5 * runs - CASE WHEN v < 0.25 THEN 20 WHEN v < 0.30 THEN 10 WHEN v > 0.55 THEN 15 ELSE 0 END - 5 * dots + least(2 * proper, 20)
 - CASE WHEN len(ws) >= 5 THEN 3 * len(list_filter(ws, lambda w: length(w) > 3 AND regexp_matches(w[2:], '\p{{Lu}}') AND regexp_matches(w, '\p{{Ll}}'))) ELSE 0 END
 - CASE WHEN length(text) < 100 THEN 10 ELSE 0 END)) END::DOUBLE AS quality
 FROM (SELECT *, {ODD} AS v FROM (SELECT *, {SHARE.format(t="text")} AS c, len(regexp_extract_all(lower(text), '{RUNS}')) AS runs, len(regexp_extract_all(text, '\.{{6,}}')) AS dots, {SPLIT_SQL.format(t="text")} AS ws,
 len(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: len({SPLIT_SQL.format(t="s")})), lambda n: n BETWEEN 3 AND 50)) AS proper FROM documents))"""


def rated(spark, d):
    return spread(read(spark, d, "documents")).withColumn("quality", Q.text_quality(F.col("text")))


@query(f"SELECT doc_id, quality FROM ({QUALITY_SQL})")
def op_text_quality(spark, d):
    return rated(spark, d).select("doc_id", "quality")


@query(f"""SELECT doc_id, round(least(1.0, quality / 100 * CASE WHEN doc_id % 2 = 0 THEN 1.1 ELSE 1.0 END * CASE WHEN length(source) > 3 THEN 1.05 ELSE 1.0 END
 * CASE WHEN lang <> 'en' THEN 0.9 ELSE 1.0 END), 9) AS confidence FROM ({QUALITY_SQL})""")
def op_confidence(spark, d):
    method = F.when(F.col("doc_id") % 2 == 0, "pdf").otherwise("ocr")
    return rated(spark, d).select("doc_id", F.round(Q.confidence(F.col("quality"), method, F.col("source"), F.col("lang") != "en"), 9).alias("confidence"))


@query(rf"""SELECT doc_id, i - 1 AS para_idx, CASE WHEN regexp_matches(trim(p), '^[0-9]{{1,3}}$') THEN 'page number' WHEN length(trim(p)) < 20 THEN 'short'
 WHEN regexp_matches(lower(p), '{LONG_RUNS}') OR regexp_matches(p, '\.{{8,}}') OR len(regexp_extract_all(lower(p), '{RUNS}')) >= 3
 OR (length({SHARE.format(t="p")}) > 20 AND length(regexp_replace(p, '[^aeiouAEIOU ]', '', 'g')) / length({SHARE.format(t="p")}) < 0.15) THEN 'corrupt' END AS skip_reason
 FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents))""")
def fi_paragraphs(spark, d):
    p = spread(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("para_idx", "p"))
    return p.select("doc_id", F.col("para_idx").cast("long").alias("para_idx"), Q.skip_reason(F.col("p")).alias("skip_reason"))


TOKENS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


# Aggregation


@query("SELECT source, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM documents GROUP BY source")
def ag_sources(spark, d):
    n = read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6))


@query(f"""SELECT lang, count(*) FILTER (quality >= 80) AS high, count(*) FILTER (quality >= 60 AND quality < 80) AS medium, count(*) FILTER (quality < 60) AS low,
 round(avg(quality), 6) AS mean, median(quality) AS median FROM ({QUALITY_SQL}) GROUP BY lang""")
def ag_quality_bands(spark, d):
    q = F.col("quality")
    return rated(spark, d).groupBy("lang").agg(F.count_if(q >= 80).alias("high"), F.count_if((q >= 60) & (q < 80)).alias("medium"), F.count_if(q < 60).alias("low"), F.round(F.avg(q), 6).alias("mean"), F.median(q).alias("median"))


@query("SELECT source, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 6) AS mean, list_sort(list(n_chars))[count(*) // 2 + 1] AS upper_median, count(*) FILTER (n_chars > 1000) AS large FROM documents GROUP BY source")
def ag_lengths(spark, d):
    """Upper medians by rank: two window counts instead of a list of every length."""
    docs = read(spark, d, "documents").select("source", "n_chars")
    counts = docs.groupBy("source", "n_chars").agg(F.count("*").alias("k"))
    w = Window.partitionBy("source")
    upto = counts.withColumn("upto", F.sum("k").over(w.orderBy("n_chars"))).withColumn("n", F.sum("k").over(w))
    return upto.groupBy("source").agg(
        F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.round(F.sum(F.col("n_chars") * F.col("k")) / F.sum("k"), 6).alias("mean"),
        F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("n_chars"))).alias("upper_median"), F.sum(F.when(F.col("n_chars") > 1000, F.col("k")).otherwise(0)).alias("large"),
    )


@query(f"SELECT quality AS truth, predicted, count(*) AS n FROM labels JOIN (SELECT doc_id, (quality >= 90)::INT AS predicted FROM ({QUALITY_SQL})) USING (doc_id) GROUP BY ALL")
def ag_confusion(spark, d):
    predicted = rated(spark, d).select("doc_id", (F.col("quality") >= 90).cast("int").alias("predicted"))
    return read(spark, d, "labels").select("doc_id", F.col("quality").alias("truth")).join(predicted, "doc_id").groupBy("truth", "predicted").agg(F.count("*").alias("n"))


@query("SELECT least(20, greatest(1, floor((value - lo) / (hi - lo) * 20)::BIGINT + 1)) AS bin, count(*) AS n FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY 1")
def ag_histogram(spark, d):
    events = read(spark, d, "events").select("value")
    ends = events.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    at = F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 20) + 1
    return events.join(F.broadcast(ends), F.lit(True)).groupBy(F.least(F.lit(20).cast("long"), F.greatest(F.lit(1).cast("long"), at)).alias("bin")).agg(F.count("*").alias("n"))


@query(rf"""WITH t AS (SELECT {TOKENS_SQL} AS ts FROM documents), u AS (SELECT unnest(ts) AS w FROM t), n AS (SELECT count(*)::DOUBLE AS n FROM u), c AS (SELECT w, count(*) AS k FROM u GROUP BY 1),
 b AS (SELECT unnest(list_zip(ts[:-2], ts[2:])) AS p FROM t WHERE len(ts) > 1), f AS (SELECT p[1] AS a, p[2] AS b, count(*) AS k FROM b GROUP BY ALL HAVING count(*) >= 2)
 SELECT f.a, f.b, f.k AS n, round(log2(f.k * n.n / (x.k * y.k)), 6) AS pmi FROM f JOIN c x ON x.w = f.a JOIN c y ON y.w = f.b, n""")
def ag_bigrams(spark, d):
    """Word pairs seen twice or more with their pointwise mutual information."""
    t = spread(read(spark, d, "documents").select("text")).select(T.tokens(F.col("text")).alias("ts"))
    c = t.select(F.explode("ts").alias("w")).groupBy("w").agg(F.count("*").alias("k"))
    n = c.agg(F.sum("k").cast("double").alias("total"))
    pairs = t.select(F.explode(F.arrays_zip(F.slice("ts", 1, F.greatest(F.size("ts") - 1, F.lit(0))).alias("a"), F.slice("ts", 2, F.greatest(F.size("ts") - 1, F.lit(0))).alias("b"))).alias("p"))
    f = pairs.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n")).where("n >= 2")
    f = f.join(c.select(F.col("w").alias("a"), F.col("k").alias("ka")), "a").join(c.select(F.col("w").alias("b"), F.col("k").alias("kb")), "b").join(F.broadcast(n), F.lit(True))
    return f.select("a", "b", "n", F.round(F.log2(F.col("n") * F.col("total") / (F.col("ka") * F.col("kb"))), 6).alias("pmi"))


@query("""WITH p AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'view') AS b FROM events GROUP BY 1), x AS (SELECT a - b AS d FROM p WHERE a IS NOT NULL AND b IS NOT NULL)
 SELECT count(*) AS n, round(avg(d), 6) AS mean, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t FROM x""")
def ag_paired_t(spark, d):
    kind = lambda k: F.avg(F.when(F.col("event_type") == k, F.col("value")))
    p = read(spark, d, "events").groupBy("user_id").agg((kind("click") - kind("view")).alias("d")).where("d is not null")
    return p.agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean"), F.round(F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.count("*"))), 6).alias("t"))


@query("""WITH r AS (SELECT user_id, event_type, avg(value) AS s FROM events GROUP BY ALL) SELECT user_id, round(var_samp(s), 6) AS variance, round(max(s) - min(s), 6) AS range, arg_max(event_type, s) AS best FROM r GROUP BY 1""")
def ag_variance(spark, d):
    r = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("s"))
    return r.groupBy("user_id").agg(F.round(F.var_samp("s"), 6).alias("variance"), F.round(F.max("s") - F.min("s"), 6).alias("range"), F.max_by("event_type", "s").alias("best"))


# Windows, joins, shaping


@query("SELECT event_id, user_id, CASE WHEN count(*) OVER w >= 10 THEN round(avg(value) OVER w, 6) END AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def wn_rolling_mean(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)
    return read(spark, d, "events").select("event_id", "user_id", F.when(F.count("*").over(w) >= 10, F.round(F.avg("value").over(w), 6)).alias("mean"))


@query(r"""SELECT doc_id, first_id, doc_id <> first_id AS duplicate FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY regexp_replace(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '[^\p{L}\p{N}_\s]', '', 'g')) AS first_id FROM documents)""")
def wn_duplicates(spark, d):
    """First occurrence of each normalised text; digests are shuffled, not texts."""
    t = spread(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.sha2(T.for_duplicates(F.col("text")), 256).alias("h"))
    more = t.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")  # a row for each text that stands twice
    first = F.coalesce("first", "doc_id")
    return t.join(few(more), "h", "left").select("doc_id", first.alias("first_id"), (F.col("doc_id") != first).alias("duplicate"))


@query("SELECT doc_id, source, label, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 6) AS norm FROM documents JOIN embeddings ON vec_id = doc_id")
def jn_zip(spark, d):
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", F.round(F.sqrt(R.dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"))
    return read(spark, d, "documents").select("doc_id", "source").join(v, "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jn_unlabelled(spark, d):
    return read(spark, d, "documents").select("doc_id", "lang").join(read(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""SELECT 'rulebook_' || doc_id || '_' || row_number() OVER (PARTITION BY source ORDER BY doc_id) AS id, 'rulebook' AS source_type, 50 AS priority FROM documents
 UNION ALL SELECT 'faq_' || item_id, 'faq', 45 FROM benchmark UNION ALL SELECT 'forum_' || conv_id, 'forum', 30 FROM (SELECT DISTINCT conv_id FROM conversations)""")
def pr_index_documents(spark, d):
    named = lambda df, id_, kind, p: df.select(id_.alias("id"), F.lit(kind).alias("source_type"), F.lit(p).alias("priority"))
    docs = numbered(read(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", "n")
    rules = named(docs, F.concat_ws("_", F.lit("rulebook"), "doc_id", "n"), "rulebook", 50)
    faq = named(read(spark, d, "benchmark"), F.concat_ws("_", F.lit("faq"), "item_id"), "faq", 45)
    forum = named(read(spark, d, "conversations").select("conv_id").distinct(), F.concat_ws("_", F.lit("forum"), "conv_id"), "forum", 30)
    return rules.unionByName(faq).unionByName(forum)


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<|]*)', 1) AS title, len(regexp_extract_all(html, '<article'))::BIGINT AS articles, len(regexp_extract_all(html, 'href="([^"]+)"'))::BIGINT AS links FROM pages""")
def sc_pages(spark, d):
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return read(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<|]*)", 1).alias("title"), n("<article").alias("articles"), n('href="([^"]+)"').alias("links"))


@query("""SELECT conv_id, count(*) AS post_count, arg_min(text, turn) FILTER (role = 'user') AS question, count(*) FILTER (role = 'assistant') AS answers FROM conversations GROUP BY 1 HAVING count(*) >= 2""")
def fo_threads(spark, d):
    """Conversations of two posts or more as threads: the first user post is the question."""
    asked = F.when(F.col("role") == "user", F.col("turn"))
    g = read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("post_count"), F.min_by("text", asked).alias("question"), F.count_if(F.col("role") == "assistant").alias("answers"))
    return g.where("post_count >= 2")


@query(r"""WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(regexp_replace(text, '[^\x00-\x7F]', ' ', 'g')), '\b[a-z]{4,}\b')) AS k FROM conversations),
 p AS (SELECT conv_id, turn, k, lag(k) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM t)
 SELECT conv_id, turn, round(CASE WHEN len(k) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(k, b)) / len(list_distinct(list_concat(k, b))) END, 6) AS likeness FROM p WHERE b IS NOT NULL""")
def op_turn_jaccard(spark, d):
    t = read(spark, d, "conversations").select("conv_id", "turn", T.key_words(T.ascii_only(F.col("text"))).alias("k"))
    p = t.withColumn("b", F.lag("k").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b is not null")
    return p.select("conv_id", "turn", F.round(T.jaccard(F.col("k"), F.col("b")), 6).alias("likeness"))
