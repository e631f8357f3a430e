"""Report queries: chunk reports, sections, headers, descriptions, comparisons of runs and of sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions import questions as Q
from ..functions import quality
from ..functions import scores as C
from ..functions import text as T
from ..operators import reports as P
from ..operators import retrieve as R
from ..operators.common import spread
from .batch import BATCH_SQL, evaluated
from .qa import PLAIN, TYPE_SQL
from .registry import QUALITY_SQL, query, rated, read
from .search import ASKED_SQL, DOCS_SQL, KEYWORD_SQL, NEAR_SQL, WEIGHT, _first, asked, chunks, hybrid_hits, nearest, pools_sql

CHUNK_SQL = f"""SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'faq' WHEN doc_id % 5 < 3 THEN 'forum' ELSE 'rulebook' END AS source_type, CASE WHEN doc_id % 5 = 0 THEN 45 WHEN doc_id % 5 < 3 THEN 30 ELSE 50 END AS priority, CASE WHEN doc_id % 2 = 0 THEN 'pdf' ELSE 'ocr' END AS method,
 least(1.0, quality / 100 * CASE WHEN doc_id % 2 = 0 THEN 1.1 ELSE 1.0 END * CASE WHEN length(source) > 3 THEN 1.05 ELSE 1.0 END * CASE WHEN lang <> 'en' THEN 0.9 ELSE 1.0 END) AS confidence FROM ({QUALITY_SQL})"""
BANDS_SQL = "count(*) FILTER (quality >= 80) AS high, count(*) FILTER (quality >= 60 AND quality < 80) AS medium, count(*) FILTER (quality < 60) AS low, round(count(*) FILTER (quality >= 80) * 100.0 / count(*), 6) AS high_share, count(*) FILTER (quality >= 70) AS good"


def rated_chunks(spark, d):
    method = F.when(F.col("doc_id") % 2 == 0, "pdf").otherwise("ocr")
    r = rated(spark, d).select("doc_id", "quality", quality.confidence(F.col("quality"), method, F.col("source"), F.col("lang") != "en").alias("extraction_confidence"), method.alias("extraction_method"))
    return r.withColumnRenamed("quality", "quality_score").join(chunks(spark, d).select("doc_id", "source_type", "priority"), "doc_id")


@query(f"""SELECT source_type, count(*) AS chunks, min(priority)::INT AS priority, min(priority) / 50.0 AS boost, round(avg(quality), 6) AS mean_quality, median(quality) AS median_quality, {BANDS_SQL}, round(avg(confidence), 6) AS mean_confidence,
 count(*) FILTER (confidence >= 0.8) AS sure, count(*) FILTER (confidence >= 0.6 AND confidence < 0.8) AS fair, count(*) FILTER (confidence < 0.6) AS unsure, count(*) FILTER (method = 'pdf') AS pdf, count(*) FILTER (method = 'ocr') AS ocr FROM ({CHUNK_SQL}) GROUP BY 1""")
def ag_chunk_report(spark, d):
    """Sources, quality and confidence bands and methods of all documents as chunks."""
    r = P.chunk_report(rated_chunks(spark, d))
    return r.select(*(F.round(c, 6).alias(c) if c in ("mean_quality", "high_share", "mean_confidence") else F.col(c) for c in r.columns))


@query(f"""SELECT source_type, count(*) AS n, count(*) FILTER (quality >= 80 AND source_type = 'rulebook') AS rulebook_high, count(*) FILTER (confidence >= 0.8 AND source_type = 'rulebook') AS rulebook_sure, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM ({CHUNK_SQL}) GROUP BY 1""")
def ag_index_statistics(spark, d):
    """Counts of an index by source, with those of high quality and confidence among the rulebook's."""
    r = rated_chunks(spark, d)
    rules = F.col("source_type") == "rulebook"
    n = r.groupBy("source_type").agg(F.count("*").alias("n"), F.count_if(rules & (F.col("quality_score") >= 80)).alias("rulebook_high"), F.count_if(rules & (F.col("extraction_confidence") >= 0.8)).alias("rulebook_sure"))
    return n.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6))  # a row for each source


@query(f"""WITH f AS (SELECT DISTINCT trim(string_split(p, chr(10))[1]) AS header FROM (SELECT {PLAIN} AS p FROM documents)) SELECT header FROM f WHERE length(header) <= 40 AND ((header = upper(header) AND regexp_matches(header, '\\p{{Lu}}')) OR length(regexp_replace(header, '\\P{{Lu}}', '', 'g')) > 3)""")
def ag_headers(spark, d):
    """Distinct first lines that look like headers."""
    line = F.trim(F.get(F.split(T.ascii_only(F.col("text")), "\n"), F.lit(0)))
    return read(spark, d, "documents").select(line.alias("header")).where(L.is_header(F.col("header"))).distinct()


WORD_SQL = " ".join(
    f"WHEN regexp_matches(t[1:150], '(?i)\\b{s}\\b') THEN coalesce(list_filter(list_transform(list_filter(ls[1:3], lambda x: contains(lower(x), '{s.lower()}')), lambda x: trim(regexp_replace(x, '^\\|+|\\|+$', '', 'g'))), lambda x: length(x) < 60)[1], '{s.title()}')" for s in L.SECTIONS
)
NAMED_SQL = "|".join(s.lower() for s in L.SECTIONS)


@query(rf"""SELECT doc_id, CASE WHEN regexp_matches(t, '^\d+\.?\d*\s+([A-Z][A-Za-z\s]{{2,50}})') THEN trim(regexp_extract(t, '^\d+\.?\d*\s+([A-Z][A-Za-z\s]{{2,50}})', 1)) WHEN regexp_matches(t, '^\|?\s*([A-Z][A-Za-z\s&]{{3,50}})\s*\|') THEN trim(regexp_extract(t, '^\|?\s*([A-Z][A-Za-z\s&]{{3,50}})\s*\|', 1))
 WHEN line <> '' AND length(line) < 60 AND titled AND ((regexp_matches(lower(line), '{NAMED_SQL}') AND (NOT suffix(line, '.') OR n <= 6)) OR (n <= 8 AND NOT suffix(line, '.'))) THEN line {WORD_SQL} END AS section
 FROM (SELECT *, (line = upper(line) AND regexp_matches(line, '\p{{L}}')) OR (regexp_matches(line, '^\p{{Lu}}') AND length(regexp_replace(line, '\P{{Lu}}', '', 'g')) >= 2) AS titled, len(list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> '')) AS n
 FROM (SELECT doc_id, t, string_split(t, chr(10)) AS ls, trim(string_split(t, chr(10))[1]) AS line FROM (SELECT doc_id, {PLAIN} AS t FROM documents)))""")
def sf_sections(spark, d):
    """A section's name from each document's text."""
    return spread(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", T.ascii_only(F.col("text")).alias("t")).select("doc_id", L.section_name(F.col("t")).alias("section"))


@query(f"""SELECT conv_id, turn, CASE WHEN t = '' THEN 'unknown' WHEN length(t) < 20 OR (length(t) < 50 AND ({' OR '.join(f"contains(lower(t), '{w}')" for w in T.ENGLISH)})) THEN 'en' ELSE CASE WHEN turn % 3 = 0 THEN 'de' ELSE 'en' END END AS language,
 CASE WHEN arg_min(t, turn) OVER (PARTITION BY conv_id) IS NULL THEN 'unknown' ELSE 'known' END AS thread FROM (SELECT conv_id, turn, text AS t FROM conversations)""")
def sf_language(spark, d):
    """Rules on a detector's language (made up here) for each post."""
    detected = F.when(F.col("turn") % 3 == 0, "de").otherwise("en")
    return read(spark, d, "conversations").select("conv_id", "turn", T.language(F.col("text"), detected).alias("language"), F.when(F.min_by("text", "turn").over(Window.partitionBy("conv_id")).isNull(), "unknown").otherwise("known").alias("thread"))


@query("""SELECT event_type, round(avg(value) * 100, 6) AS mean, count(*) FILTER (value >= 0.8) AS passing, round((avg(value) - (SELECT avg(value) FILTER (event_type = 'view') FROM events)) * 100, 6) AS change, round(stddev_samp(value), 6) AS spread, row_number() OVER (ORDER BY round(avg(value), 9) DESC, event_type) AS place FROM events WHERE event_type NOT IN ('error') GROUP BY 1""")
def ev_experiments(spark, d):
    """Experiments (event types) by mean, with their change against a baseline and without a barred one."""
    e = read(spark, d, "events").select("event_type", "value")
    base = e.agg(F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("base"))
    v = F.col("value")
    g = e.where(~F.col("event_type").isin("error")).groupBy("event_type").agg(F.avg(v).alias("m"), F.count_if(v >= 0.8).alias("passing"), F.stddev_samp(v).alias("s")).join(F.broadcast(base), F.lit(True))
    place = F.row_number().over(Window.orderBy(F.desc(F.round("m", 9)), "event_type"))  # a row for each type
    return g.select("event_type", F.round(F.col("m") * 100, 6).alias("mean"), "passing", F.round((F.col("m") - F.col("base")) * 100, 6).alias("change"), F.round("s", 6).alias("spread"), place.cast("long").alias("place"))


@query("""SELECT event_type, quantile_cont(value, 0.25) AS q1, median(value) AS q2, quantile_cont(value, 0.75) AS q3, min(value) AS least, max(value) AS most, count(value) AS n FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY 1""")
def ag_quartiles(spark, d):
    """Quartiles and ends of each type's values; rows without either are dropped."""
    e = read(spark, d, "events").dropna(subset=["value", "event_type"])
    p = lambda x: F.percentile("value", F.lit(x))
    return e.groupBy("event_type").agg(p(0.25).alias("q1"), p(0.5).alias("q2"), p(0.75).alias("q3"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("value").alias("n"))


@query()
def ag_described(spark, d):
    """Counts, means, deviations and quartiles of all columns of labels."""
    return P.described(read(spark, d, "labels"))


@query(f"""WITH c AS (SELECT quality AS truth, predicted, count(*) AS n FROM labels JOIN (SELECT doc_id, (quality >= 90)::INT AS predicted FROM ({QUALITY_SQL})) USING (doc_id) GROUP BY ALL)
 SELECT truth, predicted, coalesce(n, 0) AS n FROM (SELECT * FROM (SELECT unnest([0, 1]) AS truth) CROSS JOIN (SELECT unnest([0, 1]) AS predicted)) LEFT JOIN c USING (truth, predicted)""")
def ag_confusion_grid(spark, d):
    """The confusion matrix with its empty cells."""
    predicted = rated(spark, d).select("doc_id", (F.col("quality") >= 90).cast("int").alias("predicted"))
    c = read(spark, d, "labels").select("doc_id", F.col("quality").alias("truth")).join(predicted, "doc_id").groupBy("truth", "predicted").agg(F.count("*").alias("n"))
    grid = spark.range(4).select((F.col("id") % 2).cast("int").alias("truth"), F.floor(F.col("id") / 2).cast("int").alias("predicted"))
    return grid.join(c, ["truth", "predicted"], "left").fillna(0, ["n"])


@query("SELECT event_id, value, event_type FROM events WHERE value IS NOT NULL ORDER BY value DESC, event_id LIMIT 10")
def sl_largest(spark, d):
    """The ten largest values (a top-k report)."""
    return read(spark, d, "events").where("value is not null").select("event_id", "value", "event_type").orderBy(F.desc("value"), "event_id").limit(10)


@query("""SELECT count(*) AS n, count(*) FILTER (value >= 0.5) AS half, count(*) FILTER (value >= 0.5 AND user_id IS NOT NULL) AS known FROM events WHERE event_type = 'click'""")
def fi_ranges(spark, d):
    """Counts of an index by term, range and existing field; the term is pushed to the scan."""
    clicks = read(spark, d, "events").where("event_type = 'click'")
    return clicks.agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 0.5).alias("half"), F.count_if((F.col("value") >= 0.5) & F.col("user_id").isNotNull()).alias("known"))


@query("""WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS hs FROM pages), e AS (SELECT page_id, unnest(hs) AS link, generate_subscripts(hs, 1) AS i FROM l)
 SELECT link, min(page_id) AS first_page, count(*) AS times FROM e GROUP BY 1""")
def sc_listing(spark, d):
    """Links of all pages, each once, with the page that has it first."""
    e = read(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("link"))
    return e.groupBy("link").agg(F.min("page_id").alias("first_page"), F.count("*").alias("times"))


@query(f"""SELECT qid, question, overall_score, relevance_score, completeness_score, accuracy_score, conciseness_score, CASE WHEN overall_score * 100 >= 80 THEN 'high' WHEN overall_score * 100 >= 60 THEN 'medium' ELSE 'low' END AS band,
 CASE WHEN rulebook_confidence * 100 >= 70 THEN 'high' WHEN rulebook_confidence * 100 >= 50 THEN 'medium' ELSE 'low' END AS trust FROM ({BATCH_SQL} SELECT * FROM batch) WHERE overall_score < 0.7 ORDER BY overall_score, qid LIMIT 20""")
def ev_mismatches(spark, d):
    """The 20 worst answers of a run with their dimensions (a top-k report)."""
    b = evaluated(spark, d).where("overall_score < 0.7").orderBy("overall_score", "qid").limit(20)
    dims = [f"{c}_score" for c in ("overall", "relevance", "completeness", "accuracy", "conciseness")]
    return b.select("qid", "question", *dims, C.band(F.col("overall_score") * 100, 80, 60).alias("band"), C.band(F.col("rulebook_confidence") * 100, 70, 50).alias("trust"))


@query(f"""SELECT type, kind, count(*) AS n, round(avg(change), 6) AS mean FROM (SELECT {TYPE_SQL("t")} AS type, CASE WHEN b > a THEN 'better' WHEN b < a THEN 'worse' ELSE 'same' END AS kind, b - a AS change
 FROM (SELECT {PLAIN} AS t, length(text) AS a, lead(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b IS NOT NULL) GROUP BY ALL""")
def ev_changes_by_type(spark, d):
    """Two runs (a post's length and the next one's) compared by question type."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = read(spark, d, "conversations").select(T.ascii_only(F.col("text")).alias("t"), F.length("text").alias("a"), F.lead(F.length("text")).over(w).alias("b")).where("b is not null")
    kind = F.when(F.col("b") > F.col("a"), "better").when(F.col("b") < F.col("a"), "worse").otherwise("same")
    return p.groupBy(Q.question_type(F.col("t")).alias("type"), kind.alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("b") - F.col("a")), 6).alias("mean"))


@query("SELECT event_id, greatest(1, least(10, round_even(value * 10, 0)::INT)) AS quality, CASE WHEN value * 100 >= 70 THEN 'high' WHEN value * 100 >= 50 THEN 'medium' ELSE 'low' END AS band FROM events WHERE value IS NOT NULL")
def pr_shown_quality(spark, d):
    """Qualities as they are shown: whole numbers of 1 to 10, and bands."""
    v = F.col("value")
    return read(spark, d, "events").where("value is not null").select("event_id", C.shown_quality(v * 10).alias("quality"), C.band(v * 100, 70, 50).alias("band"))


@query(f"""WITH a AS (SELECT count(*) AS total_pairs, avg(length(text)) AS avg_answer_length, sum(m) AS total_mentions, count(*) FILTER (length(text) > 500) AS long FROM (SELECT text, len(regexp_extract_all(text, '@\\w+')) AS m FROM (SELECT {PLAIN} AS text FROM conversations WHERE turn % 2 = 0))),
 b AS (SELECT count(*) AS total_pairs, avg(length(text)) AS avg_answer_length, sum(m) AS total_mentions, count(*) FILTER (length(text) > 500) AS long FROM (SELECT text, len(regexp_extract_all(text, '@\\w+')) AS m FROM (SELECT {PLAIN} AS text FROM conversations WHERE turn % 2 = 1))),
 m AS (SELECT unnest(['total_pairs', 'avg_answer_length', 'total_mentions', 'answers_over_500_chars']) AS metric, unnest([a.total_pairs, a.avg_answer_length, a.total_mentions, a.long]::DOUBLE[]) AS old, unnest([b.total_pairs, b.avg_answer_length, b.total_mentions, b.long]::DOUBLE[]) AS new FROM a, b)
 SELECT metric, round(old, 6) AS old, round(new, 6) AS new, round(new - old, 6) AS change, round(CASE WHEN old <> 0 THEN (new - old) * 100 / old END, 6) AS percent FROM m""")
def ag_metric_changes(spark, d):
    """Answer metrics of two runs (even and odd turns) and their changes."""
    c = read(spark, d, "conversations").select("turn", T.ascii_only(F.col("text")).alias("answer"))
    of = lambda k: P.answer_metrics(c.where(F.col("turn") % 2 == k)).select("total_pairs", "avg_answer_length", "total_mentions", "answers_over_500_chars")
    m = P.metric_changes(of(0), of(1))
    return m.select("metric", *(F.round(x, 6).alias(x) for x in ("old", "new", "change", "percent")))


def _confidence_sql(name: str, barred: str) -> str:
    pool = pools_sql(5, barred).replace("both_sides AS", f"{name}_sides AS", 1)
    best = _first(f"SELECT *, round({WEIGHT} * v_norm + {round(1 - WEIGHT, 9)} * k_norm, 9) AS score FROM {name}_sides", 1)
    return f"{pool}, {name} AS (SELECT qid, greatest(0, least(1, score)) AS {name} FROM ({best}))"


FORUM_BEST = _first(f"SELECT * FROM ({NEAR_SQL}) WHERE doc_id IN (SELECT doc_id FROM docs WHERE source_type = 'forum')", 1)


@query(f"""WITH {DOCS_SQL}{ASKED_SQL}{KEYWORD_SQL}, {_confidence_sql("faq", "'forum', 'rulebook'")}, {_confidence_sql("rulebook", "'forum', 'faq'")}, forum AS (SELECT qid, CASE WHEN score > 1 THEN greatest(0, least(1, score - 1)) ELSE score END AS forum FROM ({FORUM_BEST}))
 SELECT qid, round(coalesce(faq, 0), 9) AS faq, round(coalesce(rulebook, 0), 9) AS rulebook, round(coalesce(forum, 0), 9) AS forum FROM asked LEFT JOIN faq USING (qid) LEFT JOIN rulebook USING (qid) LEFT JOIN forum USING (qid)""")
def co_sources(spark, d):
    """The confidence of official answers, rulebook and forum for each question, side by side."""
    best = lambda hits, name: hits.where("rank = 1").select("qid", T.clamped(F.col("score")).alias(name))
    forum = nearest(spark, d, 1, R.allowed(chunks(spark, d), source_type="forum"))
    forum = forum.select("qid", F.when(F.col("score") > 1, T.clamped(F.col("score") - 1)).otherwise(F.col("score")).alias("forum"))
    out = asked(spark, d).select("qid")
    for part in (best(hybrid_hits(spark, d, 5, source_type="faq"), "faq"), best(hybrid_hits(spark, d, 5, source_type="rulebook"), "rulebook"), forum):
        out = out.join(part, "qid", "left")
    return out.select("qid", *(F.round(F.coalesce(c, F.lit(0.0)), 9).alias(c) for c in ("faq", "rulebook", "forum")))
