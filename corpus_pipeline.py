"""The corpus pipeline: five operators one after another over documents, each stage written and read again.

Toxic documents go; of equal texts one row stays; of each near-duplicate group one document stays; sources are mixed to
their target weights (documents appear as often as the mix takes them); every text is encoded and decoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetstops.llm import byte_bpe, exact_dedup, mixing, simhash, toxicity
from fleetstops.llm.common import materialize, shared_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model trained from the labels does not predict to be toxic."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row, against a new digest index."""
    buckets = exact_dedup.session_buckets(spark)
    return exact_dedup.keep_new(docs, exact_dedup.open_index(spark, shared_path(spark, "digest-index"), buckets), buckets)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the document with the smallest doc_id."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target weight asks."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row: doc_id, its ids, their number and digest, the digest of the decoded bytes."""
    return byte_bpe.encode_decode(docs).select("doc_id", "ids", *byte_bpe.digests())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: The first stage trains a model and the last applies a tokenizer: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
