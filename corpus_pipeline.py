"""Corpus pipeline: quality rules, line dedup, near-duplicate join, decontamination, mixing.

Every stage takes (spark, docs, sf_dir), works on all rows of docs and returns the columns of
documents; the last one adds its rates. Rows with a null doc_id are dropped by the first stage,
as no later one could tell them apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.llm import decontaminate, line_dedup, mixing, ngram_join, quality_rules
from trendspark.llm.common import release, scratch_dir, table

#: The stages before leave next to no poor documents, so the mix is of two domains. The toxic one reaches it with 7 % (small tables) to 20 % of the tokens; all rates stay over 0 on either.
TARGETS = {"good": 0.85, "toxic": 0.15}
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and aren't outliers of their language and source."""
    kept = quality_rules.judge(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    return docs.select(COLUMNS).join(kept, "doc_id", "left_semi")


def by_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that others repeat; those that have no other lines go, n_chars follows the text."""
    out = line_dedup.line_dedup(docs.select(COLUMNS)).where("n_dropped = 0 or trim(text) <> ''")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def by_likeness(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the least id."""
    first = ngram_join.jaccard_join(docs).where("doc_id = class_id").select("doc_id").distinct()
    return docs.select(COLUMNS).join(first, "doc_id", "left_semi")


def by_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.decontaminate(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def by_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes (rate over 0), with their rate: how often each is to be read in an epoch."""
    rates = mixing.mixing_rates(docs, mixing.label_domains(table(spark, sf_dir, "labels")), TARGETS)
    taken = rates.groupBy("doc_id").agg(F.max("rate").alias("rate")).where("rate > 0")
    return docs.select(COLUMNS).join(taken, "doc_id")


STAGES = [
    ("quality_rules", by_quality),
    ("line_dedup", by_lines),
    ("ngram_jaccard_join", by_likeness),
    ("decontamination", by_benchmark),
    ("mixing", by_weights),
]
#: The robust estimates, the classifier and the iterations have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; the result of each is written as Parquet and read again, so that lost executors cost one stage at most."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch_dir(spark)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
