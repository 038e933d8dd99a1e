"""A corpus pipeline over documents: toxicity, near-duplicates, secrets, mixing, tokens.

Each stage works on all that its predecessor kept and returns the columns of documents (the last one: tokens). run() writes what a
stage returns as Parquet to the shared folder and reads it again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sketchloom.llm import bpe, mixing, near_copies, secret_scan, toxicity
from sketchloom.llm.common import cut, table
from sketchloom.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the labels beside the documents."""
    return toxicity.clean_only(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays, the one with the smallest doc_id. Near: 0.8 or more alike on five-word shingles."""
    return near_copies.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows are put in the order of the mixing schedule, so each stretch of the output has the target weights; every document stays."""
    return mixing.reorder(docs, mixing.WEIGHTS)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the digests of an exact round trip, in the order of the rows."""
    return bpe.round_trip_digest(docs, tokenizer_path(), with_ids=True, keep=("source",))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_copies), ("secrets", mask_secrets), ("mixing", mix_sources), ("bpe", to_tokens)]

#: The toxicity stage trains a model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
