"""Collection and retrieval gates as boolean expressions, and their joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendspark.functions import text, urls

# Phrases of block pages.
BLOCK_SIGNALS = (
    "captcha", "CAPTCHA", "로봇이 아닙니다", "자동화된 요청", "비정상적인 접근", "비정상 접근", "접근이 제한", "IP가 차단",
    "too many requests", "Too Many Requests", "Access Denied", "Forbidden",
)


def relevant(keyword: Column, title: Column, body: Column) -> Column:
    return F.contains(text.normalize_gate(F.concat_ws(" ", title, body)), text.normalize_gate(keyword))


def long_enough(c: Column, least: int = 30) -> Column:
    return F.length(F.trim(F.coalesce(c, F.lit("")), F.lit(" \t\r\n\x0b\x0c"))) >= least


def recent(published: Column, now: Column, years: int = 3) -> Column:
    return published >= now - F.make_dt_interval(F.lit(365 * years))


def parse_post_date(raw: Column, now: Column) -> Column:
    """Dates as boards print them; a bare time is today; null for anything else. Two-digit years from 69 on are 19xx."""
    t = F.trim(raw)
    parts = lambda p, i: F.regexp_extract(t, p, i).try_cast("int")
    long_form, short_form = r"^(\d{4})\.(\d{1,2})\.(\d{1,2})(?: (\d{1,2}):(\d{1,2}))?$", r"^(\d{2})[./](\d{1,2})[./](\d{1,2})(?: (\d{1,2}):(\d{1,2}))?$"
    made = lambda p, y: F.try_make_timestamp(y, parts(p, 2), parts(p, 3), F.coalesce(parts(p, 4), F.lit(0)), F.coalesce(parts(p, 5), F.lit(0)), F.lit(0))
    yy = parts(short_form, 1)
    return (
        F.when(F.rlike(t, F.lit(r"^\d{1,2}:\d{2}$")), now).when(F.rlike(t, F.lit(long_form)), made(long_form, parts(long_form, 1)))
        .when(F.rlike(t, F.lit(short_form)), made(short_form, yy + F.when(yy >= 69, 1900).otherwise(2000)))
    )


def dated(posts: DataFrame, raw: str, out: str, now: Column, dropping: tuple[str, ...] = (), source: str = "source") -> DataFrame:
    """Add the parsed date; posts without one go where their source is a dropping one, and stay with null elsewhere."""
    parsed = posts.withColumn(out, parse_post_date(F.col(raw), now))
    return parsed.where(F.col(out).isNotNull() | ~F.coalesce(F.col(source).isin(*dropping), F.lit(False))) if dropping else parsed


def fetchable(url: Column) -> Column:
    return F.rlike(url, F.lit(r"^(?i:https?)://"))


def keyword_shape(keyword: Column, most: int = 3) -> Column:
    n = F.size(F.filter(F.split(F.trim(keyword), r"[\s\p{Z}]+"), lambda w: w != ""))
    return F.struct((n <= most).alias("accepted"), n.alias("n_words"), F.when(n > most, "sentence_like").alias("reason"))


def keyword_error(keyword: Column) -> Column:
    k = F.coalesce(F.trim(keyword), F.lit(""))
    return F.when(k == "", "empty").when(F.length(k) > 50, "too_long").when(F.rlike(k, F.lit(r"[\x00-\x1f]")), "control_character")


def judge_documents(docs: DataFrame, chunks: DataFrame, nfc: bool = True) -> DataFrame:
    """Match each document's keyword once, on the whole cleaned text, and give all its chunks the result."""
    m = text.match_keyword(F.col("keyword"), F.col("title"), F.col("clean_content"), nfc)
    judged = docs.select(F.col("_id").alias("parent_id"), m.alias("m"))
    return chunks.join(judged, "parent_id").select(*chunks.columns, F.col("m.matched").alias("is_relevant"), F.col("m.position").alias("relevance_position"), F.col("m.count").alias("relevance_match_count"))


def search_filter(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Chunks of each query's keyword; its sources and is_relevant filter only where they are given."""
    c, q = chunks.alias("c"), queries.alias("q")
    out = c.join(q, "keyword").where("q.sources is null or array_contains(q.sources, c.source)").where("q.is_relevant is null or c.is_relevant = q.is_relevant")
    return out.select("q.query_id", *[F.col(f"c.{x}") for x in chunks.columns])


def valid_chunk(keyword: Column, url: Column, title: Column, body: Column, is_relevant: Column, least: int = 30, nfc: bool = True) -> Column:
    """Content link, long enough, not judged irrelevant (unknown passes), keyword in text or title."""
    both = text.normalize(F.concat(F.coalesce(body, F.lit("")), F.coalesce(title, F.lit(""))), nfc)
    return urls.is_content(url) & long_enough(body, least) & ~F.coalesce(~is_relevant, F.lit(False)) & F.contains(both, text.normalize(keyword, nfc))


def exclude_homonyms(evidence: DataFrame, homonyms: DataFrame, nfc: bool = True) -> DataFrame:
    """Drop rows whose title holds an expression that is another meaning of their keyword.

    homonyms: (keyword, expression), grouped by keyword to one array and joined on it.
    """
    other = homonyms.select(F.col("keyword"), text.normalize(F.col("expression"), nfc).alias("e")).groupBy("keyword").agg(F.collect_set("e").alias("__other"))
    out = evidence.join(other, "keyword", "left").withColumn("__title", text.normalize(F.col("title"), nfc))
    return out.where("__other is null or not exists(__other, e -> contains(__title, e))").drop("__other", "__title")


def blocked(status: Column, body: Column) -> Column:
    signal = F.rlike(body, F.lit("|".join(BLOCK_SIGNALS)))
    return status.isin(403, 429, 503) | ((F.length(body) <= 3000) & signal)


def fully_irrelevant(chunks: DataFrame) -> DataFrame:
    """(parent_id, n_chunks) of the documents all of whose chunks are judged irrelevant; unknown is not."""
    g = chunks.groupBy("parent_id").agg(F.count("*").alias("n_chunks"), F.bool_and(F.coalesce(~F.col("is_relevant"), F.lit(False))).alias("all_out"))
    return g.where("all_out").drop("all_out")
