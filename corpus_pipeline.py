"""A corpus pipeline of five stages, each of which calls one operator of casequarry.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casequarry.llm import bpe, langid, line_dedup, mixing, near_copies
from casequarry.llm.common import checkpoint_dir, columns_of, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: no letter, or no language likelier than the others."""
    columns = docs.columns
    judged = langid.classify(docs, langid.train(docs), lang="__lang", score="__score")
    return judged.where(langid.accepted(F.col("__lang"), F.col("__score"))).select(*columns_of(columns))


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks go; the documents stay."""
    return line_dedup.deduplicated(docs).select(*columns_of(docs.columns))


def deduplicate_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with a five-word likeness of 0.8 or more stays."""
    return near_copies.one_of_each(docs, words=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        vocabulary = file.read()
    tokens = bpe.encode_documents(docs, vocabulary, public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"))
    return tokens.withColumn("n_tokens", F.size("tokens").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("lines", deduplicate_lines),
    ("near_duplicates", deduplicate_near),
    ("mix", mix_sources),
    ("encode", encode),
]

#: SQL can't express the stages with learned models, fingerprints and tokens.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder."""
    docs, folder = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
