"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

Every stage takes nulls in any column, repeated rows, columns of any other names
and empty tables, which stay empty.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seriesloom.llm.bpe import digests, encode_documents
from seriesloom.llm.mixing import mixed_documents
from seriesloom.llm.near_copies import keep_one
from seriesloom.llm.pii import sanitised
from seriesloom.llm.scratch import scope, shared_dir, stage
from seriesloom.llm.toxicity import without_toxic


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _frees(f: Stage) -> Stage:
    """The stage first deletes the tables that earlier stages needed for results which have been written by now."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with stage(docs):
            return f(spark, docs, sf_dir)

    return run


@_frees
def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar scores 0.7 or more go; null and empty texts stay, repeated rows go or stay together."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_frees
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; of all null and empty texts together one."""
    return keep_one(docs)


@_frees
def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that give it away are replaced; null texts stay null."""
    return sanitised(docs)


@_frees
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights; a document may be taken twice, and texts without words take nothing."""
    return mixed_documents(docs)


@_frees
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids (little-endian unsigned 32-bit), with their number and digests; null texts have none."""
    coded = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_text=False)
    return coded.select("doc_id", "lang", "source", "ids", *digests(coded))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", clean_language),
    ("near_duplicates", near_duplicates),
    ("private_data", private_data),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: The stages need fitted models, fingerprints and byte pair merges: tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's table is in the folder that all executors share."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES:
        path = f"{shared_dir(spark)}/seriesloom/{uuid.uuid4().hex}-stage-{name}"
        with scope():
            work(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
