"""From raw documents to packed training sequences, in four stages.

Each stage is (name, function of (spark, docs, sf_dir)); docs is what its predecessor kept, read again from Parquet. All but
the last return the columns of documents. Models and cutoffs come from the labels of the whole corpus (labelled rows whose
fold is held out are never learnt from), so a stage doesn't depend on what earlier ones left of the bad examples.

Defined cases, for every stage: texts of any length are read whole; repeated rows are judged one by one but for the
near-duplicates stage; an empty table gives an empty one; further columns are kept as they are by all but the last stage,
whatever their names. What null, empty and tied rows mean is said at each stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import near_copies, packing, quality_classifier, quality_rules
from millrace.llm.common import id_fold, table
from millrace.session import scratch_path, write_groups


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a certified cutoff go. A null or empty text fails the base rule; a null lang is a
    stratum like others (one of few labels shares the pool's cutoffs); a null doc_id only has no label; a measure equal to a cutoff
    is rejected."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality probability under 0.7 go; one of just 0.7 stays. A null or empty text has the share of good labels
    as its probability; a null doc_id only has no label."""
    folds, held = quality_classifier.HELD
    labels = table(spark, sf_dir, "labels")
    model = quality_classifier.fit(table(spark, sf_dir, "documents"), labels, id_fold(F.col("doc_id"), folds) != held)
    scored, name = quality_classifier.add_score(docs, model)
    return scored.where(F.col(name) >= 0.7).select(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id: five-word shingles, similarity 0.8 or more.

    Null and empty texts are copies of each other; rows with a null doc_id all stay; of equal rows one stays; an id with several
    texts is a document for each of them, so a text that resembles no other always stays."""
    return near_copies.keep_one(docs, width=5, similarity=0.8)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 1024 ids. A null or empty text is its end id alone; a null doc_id is carried along;
    equal rows are packed one by one; columns other than doc_id and text are left out."""
    return packing.pack(docs, packing.tokenizer_path(), as_array=True)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_duplicates", near_duplicates_stage),
    ("packing", packing_stage),
]

#: Neither the certified cutoffs nor the classifier can be expressed in SQL; tests/llm/test_pipeline.py checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        write_groups(stage(spark, docs, sf_dir), path)
        docs = spark.read.parquet(path)
    return docs
