"""A corpus pipeline: each stage applies one operator to all that the stage before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.llm import bpe, decontaminate, exact_dedup, simhash, toxicity
from srcgraph.llm.common import id_hash_mod, shared_folder, table
from srcgraph.llm.queries import RANKS

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Not SQL: a trained network, XXH64, and BPE.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labelled rows that it may learn from, does not reject."""
    net = toxicity.fit(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), id_hash_mod(F.col("doc_id"), 5) != 0,
    )
    return toxicity.drop_toxic(docs, net)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest row, then the smallest id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id."""
    return simhash.drop_near_duplicates(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, benchmark passages cut out; n_chars follows."""
    return decontaminate.remove_passages(docs, table(spark, sf_dir, "benchmark"), length_col="n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every document left."""
    found = bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, room=0.25)
    return found.withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", remove_benchmark),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what lies between them is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
