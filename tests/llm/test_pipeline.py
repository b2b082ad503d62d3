"""The pipeline and its stages, each against the operator's decisions on the stage's own input."""

import warnings

import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from trendspark.llm import decontaminate, mixing, ngram_join, quality_rules
from trendspark.llm.common import table

SMALL = "/root/testdata/sf0.001"


def assert_targets_are_met(spark, docs):
    """The pipeline's own targets, on what reaches its last stage; an unmet target warns, which is an error here."""
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        out = mixing.mixing_rates(docs, mixing.label_domains(table(spark, SMALL, "labels")), corpus_pipeline.TARGETS).toPandas()
    for k, share in corpus_pipeline.TARGETS.items():
        assert abs((out.n_tokens * out.rate * out[f"p_{k}"]).sum() / out.n_tokens.sum() - share) < 0.001
    assert out.rate.min() > 0


def test_stages_step_by_step(spark, tmp_path):
    docs = table(spark, SMALL, "documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / name))
        new = spark.read.parquet(str(tmp_path / name))
        assert new.columns[:5] == corpus_pipeline.COLUMNS and (len(new.columns) == 5) == (k < 4)
        before_mixing = docs.count()
        if name == "mixing":
            assert_targets_are_met(spark, docs)
        ids, before = {r.doc_id for r in new.collect()}, {r.doc_id for r in docs.collect()}
        assert ids <= before and new.count() == len(ids)
        if name == "quality_rules":
            assert ids == {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
        if name == "line_dedup":
            assert new.where(F.length("text") != F.col("n_chars")).count() == 0
        if name == "ngram_jaccard_join":
            classes = ngram_join.jaccard_join(docs).toPandas()
            assert ids == set(classes.groupby("class_id").doc_id.min())
        if name == "decontamination":
            assert before - ids == {r.doc_id for r in decontaminate.find_leaks(docs, table(spark, SMALL, "benchmark")).collect()}
        docs = new
    assert docs.where("rate <= 0").count() == 0
    assert docs.count() == before_mixing


def test_run_keeps_clean_documents(spark):
    out = corpus_pipeline.run(spark, SMALL).toPandas()
    labels = pd.read_parquet(f"{SMALL}/labels.parquet")
    assert len(out) == out.doc_id.nunique() and {"rate", *corpus_pipeline.COLUMNS} == set(out.columns)
    assert labels[labels.doc_id.isin(out.doc_id)].quality.mean() > labels.quality.mean()


def test_mix_meets_its_targets(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").where("length(text) > 200")
    labels = mixing.label_domains(table(spark, "/root/testdata/sf0.01", "labels"))
    out = mixing.mixing_rates(docs, labels, {"good": 0.7, "poor": 0.1, "toxic": 0.2}).toPandas()  # far from the shares of the table
    got = [(out.n_tokens * out.rate * out[f"p_{k}"]).sum() / out.n_tokens.sum() for k in ("good", "poor", "toxic")]
    assert abs(got[0] - 0.7) < 0.005 and abs(got[1] - 0.1) < 0.005 and abs(got[2] - 0.2) < 0.005


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", None, None, None), (3, "one two", "en", "a", 7), (3, "one two", "en", "a", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("rate", F.lit("x")).withColumn("kept", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).columns == corpus_pipeline.COLUMNS + ["rate"] * (name == "mixing")
        assert stage(spark, docs.limit(0), SMALL).count() == 0
