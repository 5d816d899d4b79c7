"""Cleaning a training corpus: each stage is one operator over what its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from postlift.llm import byte_bpe, decontaminate, ngram_join, pii, toxicity
from postlift.llm.queries import PATTERN, table, vocabulary
from postlift.session import ARROW, materialize, prepare


def bounded(stage: Callable) -> Callable:
    """A stage whose batches to and from Python are bounded by their bytes."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(prepare(spark, ARROW), docs, sf_dir)
    return run


@bounded
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, scores below one half."""
    model = toxicity.fit_documents(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


@bounded
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of every group linked by shingle Jaccard of 0.8."""
    return ngram_join.keep_one(docs)


@bounded
def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_holders(docs, table(spark, sf_dir, "benchmark"))


@bounded
def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every personal span replaced by its kind; ``n_chars`` follows."""
    return pii.redact_documents(docs, pii.fit_documents(docs))


@bounded
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids): the token ids of every text."""
    return byte_bpe.encode_documents(docs, vocabulary("byte_bpe_50k.tiktoken"), PATTERN)


STAGES = [
    ("toxicity", reject_toxic),
    ("n-gram jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_test_items),
    ("personal data", redact_personal_data),
    ("byte-level bpe", encode),
]

#: SQL expresses neither the fitted models nor byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
