"""The corpus pipeline: quality classifier, quality rules, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of ``documents``; the last returns the
pieces of the packed sequences. ``run`` writes each stage's rows to the shared folder before the next one reads them, and lets go of what it has read.

In every stage null text counts as empty, rows that repeat are judged each for itself (the near-duplicates keep one of them), rows without doc_id take
part, texts are read whole, extra columns stay (the packing leaves them out), and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm import classifier, packing, rules, simhash
from kinfold.llm.common import discard, table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade is 0.5 or more; fitted on the labels of these documents. Without labels all stay."""
    model = classifier.train(docs, table(spark, sf_dir, "labels"))
    return classifier.score(docs, model).filter("kept").select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the full policy."""
    return rules.ledger(docs).filter(rules.passes(rules.FULL)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): the one with the smallest doc_id."""
    return simhash.keep_one_of_each(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left and their places in sequences of at most 2048 tokens; equal lengths go by doc_id."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("best-fit packing", best_fit_packing),
]

#: The classifier and the packing are not expressible in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs, path = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(spark, before)
        before = path
    return docs
