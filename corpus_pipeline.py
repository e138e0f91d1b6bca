"""The corpus pipeline over ``documents``: quality classifier, exact dedup, SimHash near-dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of ``documents``; the last returns one row per packed piece. Rows are told apart by their place in the stage's
input, so neither a null doc_id nor one that several rows share loses or merges a text.

Cases: a null text counts as empty and, where it stays, stays null; of rows that agree in all columns one stays; extra
columns, also with the names of an operator's own, pass through the first four stages; without labelled rows the
classifier keeps all; an empty table gives an empty result. What a stage wrote goes when its successor has been written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from titrant.llm import exact_dedup, packing, quality, secrets, simhash
from titrant.llm.common import forget, scratch, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts; it learns from the rows of ``docs`` that ``labels`` marks."""
    return quality.drop_rejected(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with most code points, then the smallest doc_id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its sequence and offset."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: A convolutional network and a random forest are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before = docs
        with scratch() as inner:
            docs = written(stage(spark, docs, sf_dir), name)
            inner.remove(docs)
        if k:
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
