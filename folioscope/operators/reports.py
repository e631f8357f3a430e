"""Reports: quality of chunks, validation of pairs, review samples, changes between runs, descriptions of columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import shown_quality


def share(condition: Column) -> Column:
    """Percent of rows that meet a condition."""
    return F.count_if(condition) * 100.0 / F.count("*")


def chunk_report(chunks: DataFrame) -> DataFrame:
    """A row for each source: chunks, priority, boost, quality and confidence with their bands, and extraction methods.

    A missing source is the rulebook, missing quality and confidence are 0.
    """
    q, c = F.coalesce("quality_score", F.lit(0.0)), F.coalesce("extraction_confidence", F.lit(0.0))
    return chunks.groupBy(F.coalesce("source_type", F.lit("rulebook")).alias("source_type")).agg(
        F.count("*").alias("chunks"), F.min("priority").alias("priority"), (F.min("priority") / 50.0).alias("boost"), F.avg(q).alias("mean_quality"), F.median(q).alias("median_quality"),
        F.count_if(q >= 80).alias("high"), F.count_if((q >= 60) & (q < 80)).alias("medium"), F.count_if(q < 60).alias("low"), share(q >= 80).alias("high_share"), F.count_if(q >= 70).alias("good"), F.avg(c).alias("mean_confidence"),
        F.count_if(c >= 0.8).alias("sure"), F.count_if((c >= 0.6) & (c < 0.8)).alias("fair"), F.count_if(c < 0.6).alias("unsure"), F.count_if(F.col("extraction_method") == "pdf").alias("pdf"), F.count_if(F.col("extraction_method") == "ocr").alias("ocr"),
    )


def report_lines(report: DataFrame) -> DataFrame:
    """line of a chunk report as text, in the order of number: one row for each line, few in all."""
    f = F.format_string
    of = F.array(
        f("%s: %d chunks (priority: %d, boost: %.1fx)", "source_type", "chunks", "priority", "boost"), f("  Mean quality score: %.2f", "mean_quality"), f("  Median quality score: %.2f", "median_quality"),
        f("  High quality (>=80): %d (%.1f%%)", "high", "high_share"), f("  Medium quality (60-80): %d", "medium"), f("  Low quality (<60): %d", "low"), f("  Mean confidence: %.2f%%", F.col("mean_confidence") * 100),
        f("  High confidence (>=0.8): %d, medium (0.6-0.8): %d, low (<0.6): %d", "sure", "fair", "unsure"), f("  Methods: PDF %d, OCR %d", "pdf", "ocr"),
    )
    return report.select("source_type", F.posexplode(of).alias("number", "line"))


def upper_medians(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """name, least, most, mean and median (of an even number the upper) of values, from counts of each value instead of lists; nulls don't count."""
    melted = df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("name"), v.cast("double").alias("value")) for k, v in values.items()))).alias("x")).select("x.*").where("value is not null")
    counts = melted.groupBy("name", "value").agg(F.count("*").alias("k"))
    w = Window.partitionBy("name")
    counts = counts.withColumn("upto", F.sum("k").over(w.orderBy("value"))).withColumn("n", F.sum("k").over(w))
    value = F.col("value")
    return counts.groupBy("name").agg(
        F.min(value).alias("least"), F.max(value).alias("most"), (F.sum(value * F.col("k")) / F.sum("k")).alias("mean"), F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), value)).alias("median")
    )


def pair_values() -> dict[str, Column]:
    """What reports measure of question and answer pairs."""
    return {
        "question_length": F.length("question"), "answer_length": F.length("answer"), "answer_score": F.get("raw_answers", F.lit(0))["score"], "answer_count": F.col("metadata.useful_answer_count"),
    }


def validation(checked: DataFrame, first: int = 20) -> DataFrame:
    """One row on checked pairs: totals, answers by number and score, and the first errors, warnings and issues by id.

    Pairs with an empty field are invalid; pairs whose address is wrong stay valid. Non-English pairs and repeated questions are warnings.
    """
    id_ = F.coalesce(F.col("id").cast("string"), F.lit("unknown"))
    invalid = F.exists("errors", lambda e: F.startswith(e, F.lit("empty")) | F.startswith(e, F.lit("missing")))
    language = F.col("metadata.language")
    warned = F.array_compact(F.array(F.when(language != "en", F.concat(F.lit("language "), language)), F.when(F.col("duplicate_of").isNotNull(), F.concat(F.lit("duplicate of "), F.col("duplicate_of").cast("string")))))
    rows = checked.select("*", id_.alias("_id"), invalid.alias("_invalid")).withColumns({"_w": F.when(~F.col("_invalid"), warned), "_i": F.when(~F.col("_invalid"), F.col("issues"))})
    score, n = F.get("raw_answers", F.lit(0))["score"], F.col("metadata.useful_answer_count")
    good = ~F.col("_invalid")
    totals = rows.agg(
        F.count("*").alias("total_pairs"), F.count_if(good).alias("valid_pairs"), F.count_if(~good).alias("invalid_pairs"), F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("errors"), F.coalesce(F.sum(F.coalesce(F.size("_w"), F.lit(0))), F.lit(0)).alias("warnings"),
        F.coalesce(F.sum(F.coalesce(F.size("_i"), F.lit(0))), F.lit(0)).alias("quality_issues"), F.count_if(good & (n == 1)).alias("single_answers"), F.count_if(good & (n > 1)).alias("multiple_answers"), F.count_if(good & (score >= 7)).alias("high_scores"), F.count_if(good & (score < 4)).alias("low_scores"),
    )

    def details(column: str, name: str) -> DataFrame:
        each = rows.select("_id", F.posexplode(column).alias("k", "text")).orderBy("_id", "k").limit(first)
        return each.agg(F.transform(F.array_sort(F.collect_list(F.struct("_id", "k", "text"))), lambda x: F.concat_ws(": ", x["_id"], x["text"])).alias(name))

    for column, name in (("errors", "error_details"), ("_w", "warning_details"), ("_i", "issue_details")):
        totals = totals.join(F.broadcast(details(column, name)), F.lit(True))  # one row each
    return totals


STRATA = {"edge": 3, "high": 10, "medium": 10, "low": 10}


def review_sample(pairs: DataFrame, seed: int = 42, sizes: dict[str, int] = STRATA) -> DataFrame:
    """pairs with stratum, so many of each: edge (short or no question), then by the best score high, medium and low; chosen by a seeded hash of the id (a sampling operator)."""
    score = F.coalesce(F.get("raw_answers", F.lit(0))["score"], F.lit(0))
    edge = (F.length(F.coalesce("question", F.lit(""))) < 20) | (F.length(F.coalesce("answer", F.lit(""))) < 30) | ~F.coalesce(F.col("question").contains("?"), F.lit(False))
    stratum = F.when(edge, "edge").when(score >= 8, "high").when(score >= 4, "medium").otherwise("low")
    most = F.coalesce(*(F.when(F.col("stratum") == k, n) for k, n in sizes.items()))
    order = Window.partitionBy("stratum").orderBy(F.xxhash64(F.col("id").cast("string"), F.lit(seed)), "id")
    return pairs.withColumn("stratum", stratum).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def answer_metrics(pairs: DataFrame) -> DataFrame:
    """One row: pairs, mean length, mentions, long answers and answers with mentions, with their shares."""
    mentions, long = F.regexp_count("answer", F.lit(r"@\w+")), F.length("answer") > 500
    return pairs.agg(
        F.count("*").alias("total_pairs"), F.avg(F.length("answer")).alias("avg_answer_length"), F.sum(mentions).alias("total_mentions"), F.avg(mentions).alias("avg_mentions_per_answer"),
        F.count_if(long).alias("answers_over_500_chars"), share(long).alias("answers_over_500_pct"), F.count_if(mentions > 0).alias("answers_with_mentions"), share(mentions > 0).alias("answers_with_mentions_pct"),
    )


def metric_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """metric, old, new, change and percent (null where old is 0) of two rows of metrics of the same names."""
    melt = lambda df, name: df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(name)) for c in df.columns))).alias("x")).select("x.*")
    both = melt(old, "old").join(melt(new, "new"), "metric")
    return both.withColumn("change", F.col("new") - F.col("old")).withColumn("percent", F.try_divide(F.col("change") * 100, F.col("old")))


def described(df: DataFrame) -> DataFrame:
    """Counts, means, deviations, quartiles and ends of all columns."""
    return df.summary()


def canonical_score(results: DataFrame) -> Column:
    """A score of 0 to 100 from whichever column a format has: overall_score or score (0 to 1), else similarity."""
    for name, factor in (("overall_score", 100.0), ("score", 100.0), ("similarity", 1.0)):
        if name in results.columns:
            return F.col(name).cast("double") * factor
    raise ValueError("no column of scores")


def chunk_format(chunks: DataFrame, order: Sequence[str], sample: int = 20) -> DataFrame:
    """One row of flags on what the first chunks are: sources, methods, whether quality and priority are there; and how many there are in all."""
    first = chunks.orderBy(*order).limit(sample)
    kind = F.coalesce("source_type", F.lit("rulebook")) if "source_type" in chunks.columns else F.lit("rulebook")
    method = F.coalesce("extraction_method", F.lit("unknown")) if "extraction_method" in chunks.columns else F.lit("unknown")
    some = lambda c, v, name: F.coalesce(F.bool_or(c == v), F.lit(False)).alias(name)
    flags = first.agg(*(some(kind, k, f"has_{k}") for k in ("rulebook", "faq", "forum")), *(some(method, m, f"has_{m}") for m in ("pdf", "ocr")), *((F.lit(c in chunks.columns) & (F.count("*") > 0)).alias(n) for c, n in (("quality_score", "has_quality_scores"), ("priority", "has_priority"))))
    return flags.join(F.broadcast(chunks.agg(F.count("*").alias("total_chunks"))), F.lit(True))  # one row each


def chunk_details(hits: DataFrame, question: str, first: int = 5) -> DataFrame:
    """The first chunks of each question as a debug view shows them: by source text, score, place, author, address and quality."""
    forum, faq = F.col("source_type").eqNullSafe("forum"), F.col("source_type").eqNullSafe("faq")
    answer = F.coalesce("answer", F.lit(""))
    shifted = F.when(F.col("score") > 1, F.least(F.lit(1.0), F.col("score") - 1)).otherwise(F.col("score"))
    return hits.where(F.col("rank") <= first).select(
        question, "rank", F.coalesce("source_type", F.lit("rulebook")).alias("source_type"), F.when(forum | faq, F.left(answer, F.lit(200))).otherwise(F.coalesce("text", F.lit(""))).alias("text"), F.when(forum, shifted).otherwise(F.col("score")).alias("score"),
        F.when(forum | faq, F.coalesce("text", F.lit(""))).alias("question_text"), F.when(~(forum | faq), F.col("page")).alias("page"), F.when(faq, F.coalesce("section", F.lit("N/A"))).when(~forum, F.coalesce("section", F.lit("Unknown"))).alias("section"),
        F.when(forum, F.coalesce("answer_user", F.lit("Unknown"))).alias("answered_by"), F.when(forum, F.coalesce("url", F.lit(""))).alias("thread_url"), F.when(forum, shown_quality(F.col("forum_quality_score"))).alias("quality_score"), F.when(faq, F.coalesce("faq_id", F.lit("N/A"))).alias("faq_id"),
    )


def student_p(t: float, df: int) -> float:
    """Two-sided p of Student's t, by the continued fraction of the incomplete beta function."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        x, a, b = 1 - x, b, a
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 - front * total if flip else front * total


def paired_t(differences: DataFrame, column: str = "d") -> dict[str, float | int]:
    """n, mean, t and two-sided p of paired differences: three sums in Spark, the rest on the driver."""
    n, mean, sd = differences.agg(F.count(column), F.avg(column), F.stddev_samp(column)).first()
    if not sd or n < 2:
        return {"n": n, "mean": mean or 0.0, "t": 0.0, "p": 1.0}
    t = mean / (sd / math.sqrt(n))
    return {"n": n, "mean": mean, "t": t, "p": student_p(t, n - 1)}
