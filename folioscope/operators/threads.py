"""Forum threads to question and answer pairs, and their checks. A thread is a row, so nothing is shuffled but duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import questions as Q
from ..functions.text import for_duplicates, let

POST = "struct<post_id:string,author:string,date:string,content:string,position:int,language:string>"
# Fixed values.
REQUIRED = ("id", "source", "thread_id", "thread_url", "question", "answer", "raw_question", "raw_answers", "metadata")
REQUIRED_METADATA = ("language", "scraped_date", "processed_date", "answer_count", "useful_answer_count")


def in_language(threads: DataFrame, language: str | None = "en") -> DataFrame:
    """threads of a language with their posts of it (a missing one is none); all where no language is asked for."""
    if not language:
        return threads
    return threads.where(F.col("language") == language).withColumn("posts", F.filter("posts", lambda p: p["language"].eqNullSafe(language)))


def _with(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a costly column that later filters and columns don't compute again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def ranked(posts: Column, question: Column) -> Column:
    """Replies of use, best first (ties in their order): score, position, cleaned_content, content, author and date."""
    asker = F.get(posts, F.lit(0))["author"]

    def rate(p: Column, i: Column) -> Column:
        return let(A.usefulness(p["content"], question, p["author"] == asker), lambda u: F.struct(
            (-u["score"]).alias("k"), i.alias("i"), u["score"].alias("score"), u["text"].alias("cleaned_content"), p["content"].alias("content"), p["author"].alias("author"), p["date"].alias("date"),
        ))

    replies = F.slice(posts, 2, F.greatest(F.size(posts) - 1, F.lit(0)))
    good = F.array_sort(F.filter(F.transform(replies, rate), lambda x: x["score"] > 0))
    return F.transform(good, lambda x, i: x.withField("rank", i + 1).dropFields("k", "i"))


def pairs(threads: DataFrame, language: str = "en", keep: int = 3) -> DataFrame:
    """A row per thread of that language with a question and a reply of use.

    threads holds thread_id, url, title, language, posts (POST) and, on demand, scraped_date. The best answers are kept;
    answer_count and useful_answer_count count all.
    """
    scraped = F.coalesce(F.col("scraped_date").cast("string"), F.lit("")) if "scraped_date" in threads.columns else F.lit("")
    processed = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    t = threads.where((F.col("language") == language) & (F.size("posts") >= 2))
    t = _with(t, "question", Q.extract(F.col("title"), F.get("posts", F.lit(0))["content"])).where("question <> ''")
    t = _with(t, "best", ranked(F.col("posts"), F.col("question"))).where(F.size("best") > 0)
    first = F.get("posts", F.lit(0))
    return t.select(
        F.concat(F.lit("forum_"), F.col("thread_id").cast("string")).alias("id"), F.lit("forum").alias("source"), "thread_id", F.col("url").alias("thread_url"), "question",
        F.col("best")[0]["cleaned_content"].alias("answer"),
        F.struct(F.col("title"), first["content"].alias("content"), first["author"].alias("author"), first["date"].alias("date")).alias("raw_question"), F.slice("best", 1, keep).alias("raw_answers"),
        F.struct(F.col("language"), scraped.alias("scraped_date"), processed.alias("processed_date"), (F.size("posts") - 1).alias("answer_count"), F.size("best").alias("useful_answer_count")).alias("metadata"),
    )


def question_pairs(threads: DataFrame, **options) -> DataFrame:
    """pairs, one row for each question of the first post; ids end in _q1, _q2 and so on."""
    p = pairs(threads, **options)
    each = p.select("*", F.posexplode(Q.split_questions(F.coalesce("raw_question.content", F.lit("")))).alias("k", "q")).where("q <> ''")
    return each.withColumn("id", F.concat("id", F.lit("_q"), (F.col("k") + 1).cast("string"))).withColumn("question", F.col("q")).drop("k", "q")


def checked(qa: DataFrame, domain: str, least: int = 10, score: int = 2) -> DataFrame:
    """qa with errors, issues and duplicate_of (the least id of the same question, else null).

    Questions are compared by digests. Null fields count as missing.
    """
    kinds, have = dict(qa.dtypes), set(qa.columns)
    inner = {f.name for f in qa.schema["metadata"].dataType} if "metadata" in have else set()

    def empty(c: str) -> Column:
        if kinds[c].startswith("array"):
            return F.coalesce(F.size(c), F.lit(0)) <= 0
        return F.col(c).isNull() if kinds[c].startswith("struct") else F.coalesce(F.col(c).cast("string"), F.lit("")) == ""

    missing = lambda f: F.col("metadata").isNotNull() & F.col(f"metadata.{f}").isNull() if f in inner else F.lit("metadata" in have)
    url = lambda part: F.coalesce(F.try_parse_url("thread_url", F.lit(part)), F.lit(""))
    note = lambda c, text: F.when(c, F.lit(text))
    errors = [note(empty(c), f"empty {c}") if c in have else F.lit(f"missing {c}") for c in REQUIRED] + [note(missing(f), f"missing metadata {f}") for f in REQUIRED_METADATA] + [note(~url("PROTOCOL").isin("http", "https"), "scheme"), note(~url("HOST").contains(domain), "domain"), note(~url("PATH").contains("/thread/"), "path")]
    no_mark = ~F.coalesce(F.col("question").contains("?"), F.lit(False)) & (F.coalesce("raw_question.content", F.lit("")) != "") & ~F.col("raw_question.content").contains("?")
    issues = [
        note(F.length("question") < least, "question too short"), note(F.length("answer") < least, "answer too short"),
        note(F.get("raw_answers", F.lit(0))["score"] < score, "low score"), note(no_mark, "no question mark"),
    ]
    out = qa.withColumns({"errors": F.array_compact(F.array(*errors)), "issues": F.array_compact(F.array(*issues)), "_h": F.sha2(for_duplicates(F.col("question")), 256)})
    first = out.groupBy("_h").agg(F.min("id").alias("_first"))
    return out.join(first, "_h", "left").withColumn("duplicate_of", F.when(F.col("_first") != F.col("id"), F.col("_first"))).drop("_h", "_first")


def summary(qa: DataFrame) -> DataFrame:
    """One row: pairs, mean best score, pairs of several answers, mean answer length, mentions, long answers."""
    n = F.col("metadata.useful_answer_count")
    return qa.agg(
        F.count("*").alias("pairs"), F.avg(F.col("raw_answers")[0]["score"]).alias("mean_score"), F.count_if(n > 1).alias("several"), F.avg(F.length("answer")).alias("mean_length"),
        F.sum(F.regexp_count("answer", F.lit(r"@\w+"))).alias("mentions"), F.count_if(F.length("answer") > 500).alias("long"),
    )
