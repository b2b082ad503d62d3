"""Readers and writers: pending documents, fixtures, keyword lists, pages, comments, metrics and runs."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_SCHEMA = "_id string, keyword string, source string, url string, title string, content string, score double, published_date timestamp, crawled_at timestamp, is_embedded boolean"
COMMENT_SCHEMA = "array<struct<memo:string,del_yn:string,user:string>>"


def read_pending(docs: DataFrame, keyword: str | None = None) -> DataFrame:
    """Documents not yet processed that have any content."""
    out = docs.where(~F.coalesce(F.col("is_embedded"), F.lit(False)) & (F.trim(F.coalesce("content", F.lit("")), F.lit(" \t\r\n\x0b\x0c")) != ""))
    return out.where(F.col("keyword") == keyword) if keyword else out


def write_fixture(docs: DataFrame, path: str, limit: int | None = None, keyword: str | None = None) -> None:
    out = docs.where(F.col("keyword") == keyword) if keyword else docs
    (out.limit(limit) if limit else out).write.mode("overwrite").json(path)


def read_fixture(spark: SparkSession, path: str, schema: str = RAW_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_keywords(spark: SparkSession, path: str, comments: bool = False) -> DataFrame:
    """Trimmed non-blank lines of a text file; lines from '#' on are dropped where comments are allowed."""
    k = spark.read.text(path).select(F.trim("value").alias("keyword")).where("keyword <> ''")
    return k.where(~F.startswith("keyword", F.lit("#"))) if comments else k


def extract_page(html: Column, container: str = "article", suffix: str = "") -> Column:
    """Struct (title, body, state) of a page: tags become line breaks, script and style go.

    state: 'missing' without the container, 'empty' where it has no text (images only), else 'ok'.
    """
    inner = F.regexp_extract(html, rf"(?is)<{container}\b[^>]*>(.*?)</{container}>", 1)
    has = F.rlike(html, F.lit(rf"(?is)<{container}\b[^>]*>.*?</{container}>"))
    bare = F.regexp_replace(F.regexp_replace(inner, r"(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)>", ""), r"(?s)<[^>]+>", "\n")
    body = F.trim(F.regexp_replace(bare, r"[ \t]*\n\s*", "\n"), F.lit(" \t\r\n"))
    title = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    title = F.trim(F.regexp_replace(title, suffix + "$", "")) if suffix else title
    return F.struct(title.alias("title"), body.alias("body"), F.when(~has, "missing").when(body == "", "empty").otherwise("ok").alias("state"))


def extract_sections(html: Column) -> Column:
    """Article text where each heading becomes a section marker line; edit links, footnotes and the contents list go."""
    h = F.regexp_replace(html, r"(?is)<details\b[^>]*>.*?</details>", "")
    h = F.regexp_replace(h, r'(?is)<span class="footnote[^>]*>.*?</span>', "")
    h = F.regexp_replace(h, r"(?is)<a\b[^>]*>\[편집\]</a>", "")
    h = F.regexp_replace(h, r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>", "\n[[SECTION]] $1\n")
    h = F.regexp_replace(h, r"(?s)<[^>]+>", "\n")
    return F.trim(F.regexp_replace(h, r"\n{3,}", "\n\n"), F.lit(" \t\r\n"))


def parse_comments(json: Column) -> Column:
    """Texts of the comments that are not deleted and not blank, without tags."""
    rows = F.filter(F.from_json(json, COMMENT_SCHEMA), lambda c: (c["del_yn"] == "N") & (F.trim(F.coalesce(c["memo"], F.lit(""))) != ""))
    return F.transform(rows, lambda c: F.trim(F.regexp_replace(c["memo"], "<[^>]+>", " ")))


def to_documents(results: DataFrame, kind: str, least: int = 30, transcript: int = 4000) -> DataFrame:
    """Rows of a search API -> (url, title, content, published_date).

    kind 'web': content as given. 'video': title, description, a cut transcript and comments.
    'blog': tags and entities off, postdate yyyyMMdd at +09:00, under `least` characters dropped.
    """
    if kind == "video":
        content = F.concat_ws("\n", "title", "description", F.when(F.col("transcript").isNotNull(), F.concat(F.lit("[자막] "), F.substring("transcript", 1, transcript))), F.when(F.col("comments").isNotNull(), F.concat(F.lit("[댓글] "), F.col("comments"))))
        return results.select("url", "title", content.alias("content"), F.col("published_date").try_cast("timestamp").alias("published_date"))
    if kind == "blog":
        bare = lambda c: F.trim(F.replace(F.replace(F.regexp_replace(c, "<[^>]+>", ""), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&")))
        when = F.try_to_timestamp(F.concat("postdate", F.lit(" +09:00")), F.lit("yyyyMMdd XXX"))
        return results.select("url", bare("title").alias("title"), bare("description").alias("content"), when.alias("published_date")).where(F.length("content") >= least)
    return results.select("url", "title", "content", F.col("published_date").try_cast("timestamp").alias("published_date"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def write_metrics(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def append_run(run: DataFrame, path: str, run_id: str) -> None:
    """One record of configuration and results for each evaluation run; a run that is written again replaces its own record and no other."""
    run.drop("run_id").write.mode("overwrite").json(f"{path}/run_id={quote(run_id, safe='')}")


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All records, with their run_id (a string)."""
    return spark.read.schema(f"{schema}, run_id string").json(path)


def usable_labels(labels: DataFrame, column: str = "human_label") -> DataFrame:
    return labels.where(F.col(column).cast("string").isin("0", "1")).withColumn(column, F.col(column).cast("int"))


def export_recent(docs: DataFrame, keyword: str, minutes: int, now: Column) -> DataFrame:
    return docs.where((F.col("keyword") == keyword) & (F.col("crawled_at") >= now - F.make_dt_interval(mins=F.lit(minutes))))
