"""Corpus pipeline: five filtering and encoding stages over ``documents``.

Each stage reads what the one before wrote. The first four return rows with the columns of
their input; the last one returns the codes of the documents that are left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fleetpulse.llm import bpe_codec, fm_decontam, minhash_oph, secret_links, toxicity_mil
from fleetpulse.llm.common import table
from fleetpulse.session import configure, stage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; learned from the labelled rows of ``docs``."""
    model = toxicity_mil.train(docs, table(spark, sf_dir, "labels"))
    return toxicity_mil.drop_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    return minhash_oph.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark text."""
    return fm_decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret's span masked."""
    return secret_links.mask_secrets(docs)


def codes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and hashes of each document's byte-level BPE ids, and of what they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_codec.coded_documents(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("bpe_codec", codes),
]

#: The first stage learns a model, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(configure(spark), sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
