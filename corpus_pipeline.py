"""Corpus pipeline: stages over ``documents``, each written as Parquet and reread by the next.

Every stage takes ``(spark, docs, sf_dir)`` and calls one of the training-data operators; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from semlake.llm import decontam, mixing, pii, simhash
from semlake.llm import toxicity as toxic
from semlake.llm.common import materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go; the classifier is fitted on the labelled ones of its input."""
    model = toxic.fit(docs, table(spark, sf_dir, "labels"))
    return toxic.score(docs, model).filter("score < 0.5").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group the document with the smallest id stays."""
    return simhash.keep_first(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to surrogates; n_chars follows the new text."""
    out = pii.pseudonymise(docs)
    return out.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as bigint) as n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by probabilities that meet the target weights of source, language and topic."""
    return mixing.mixed(docs).filter("sampled").select(*COLUMNS, "topic", "n_tokens", "weight", "probability")


STAGES = [
    ("toxicity", toxicity),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("pii surrogates", privacy),
    ("mixing to target weights", mix),
]
#: Stages 1 to 5 hold a trained classifier, fingerprints and keyed draws, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
