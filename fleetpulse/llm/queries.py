"""Registered queries of the corpus operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fleetpulse.llm import (
    bilinear_lm,
    conversation_blocks,
    fm_decontam,
    html_tree,
    language_kernel,
    minhash_oph,
    rotation_codes,
    secret_links,
    toxicity_mil,
    url_cascade,
    whitening,
)
from fleetpulse.llm.bpe_codec import coded_documents
from fleetpulse.llm.common import table
from fleetpulse.llm.token_files import token_file_index
from fleetpulse.session import configure

# The rules that results must follow.
URL_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Host labels whose hosts are blocked where no rule fits.
LISTED_LABELS = ("spam-farm", "cheap-pills")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(configure(spark), sf_dir)

    QUERIES[build.__name__] = run
    return build


@query
def op3_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_links.secret_spans(table(spark, sf_dir, "documents"))


ORACLES["op3_secret_links"] = secret_links.sql()


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_file_index(table(spark, sf_dir, "documents"), path, end_id=1)


@query
def op6_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, LISTED_LABELS)


ORACLES["op6_url_cascade"] = url_cascade.sql(URL_RULES, LISTED_LABELS)


@query
def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return coded_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query
def op5_language_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_kernel.predict_languages(docs, language_kernel.train(docs))


@query
def op8_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_mil.train(docs, table(spark, sf_dir, "labels"))
    return toxicity_mil.toxicity_scores(docs, model)


@query
def op7_fm_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tests = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return fm_decontam.contamination_report(docs, tests)


@query
def op10_minhash_oph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_oph.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op1_rotation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotation_codes.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op2_html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_tree.main_texts(pages, html_tree.train(pages))


@query
def op11_conversation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_blocks.damaged(table(spark, sf_dir, "conversations"))
    return conversation_blocks.repair_report(rows)


ORACLES["op11_conversation_blocks"] = conversation_blocks.sql()


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op13_bilinear_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bilinear_lm.scores(table(spark, sf_dir, "documents"))
