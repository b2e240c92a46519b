"""A training corpus from raw documents: five stages, each one operator over the whole table.

Each stage takes (spark, docs, sf_dir) and returns the documents it leaves, with the columns
of documents; the last returns tokens. Between stages the documents are written and reread.

Odd rows: a null text, or one without a letter, has no language and goes in the first stage.
Repeated rows of a document are one near-duplicate group, of which one stays; of several texts
under one key, or under the null key, each is judged by itself. A null source is a source of its
own. Texts of any length go through whole. Extra columns are carried to the last stage but one,
whatever their names. An empty table stays empty through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, forest, langid, mixing, queries, suffix
from millrace.llm.sparkit import drop, settle


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model is sure of; it learns from these documents."""
    return langid.confident(docs, queries.language_model(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return forest.without_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 100 bytes or more that start earlier too."""
    return suffix.without_repeats(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weight of its source asks, in global order."""
    return mixing.mix_sources(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each document, their number, and digests of them and of their text."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(docs, path, public_tokenizers.PATTERN, columns=("n_tokens", "token_ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language ID", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("mixing", mix_to_weights),
    ("byte-level BPE", tokenize),
]

#: SQL can express neither learned nor iterative stages; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
        drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
