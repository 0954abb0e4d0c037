"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup, mixing to target weights, best-fit packing.

Each stage takes what the one before kept and calls one operator; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biowave.llm import exact_dedup, mixing, packing, simhash, toxicity
from biowave.llm.common import crc32_mod, materialize, table

#: No SQL text expresses the models, the components and the packing; the stages are tested against brute force instead.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go; the labels are those of the learning fold."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), crc32_mod(F.col("doc_id"), 3) != 1)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with a resemblance of 0.8 or more (five-word shingles) the row with the smallest id stays."""
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, written in the order of the mix."""
    return mixing.in_mixed_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 2048 tokens, lots of sequences in the order that the mix has written."""
    return packing.pack(docs, order=packing.written_order(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the table documents; what a stage returns is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
