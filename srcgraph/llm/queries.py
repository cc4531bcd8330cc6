"""The operators of this subpackage as queries: `name -> (spark, sf_dir) -> DataFrame`."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.llm import (
    bpe, decontaminate, exact_dedup, host_rules, line_dedup, lm, merkle, pii, quality, sharding, simhash,
    term_pipeline, toxicity,
)
from srcgraph.llm.common import id_hash_mod, table

Query = Callable[[SparkSession, str], DataFrame]

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_of("fp").alias("fingerprint"), "component_id")


def _judged(scored: DataFrame, divisor: int, held: int) -> DataFrame:
    return scored.select(
        F.col("id").alias("doc_id"), (id_hash_mod(F.col("id"), divisor) == held).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"), id_hash_mod(F.col("doc_id"), 5) != 0)
    return _judged(toxicity.score_documents(docs, net), 5, 0)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination(found).withColumnRenamed("id", "doc_id")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = lm.score_documents(docs, id_hash_mod(docs["doc_id"], 7) != 2)
    return scored.select(
        F.col("id").alias("doc_id"), (id_hash_mod(F.col("id"), 7) == 2).alias("held_out"), "n_tokens", "n_known",
        "train_tokens", "base_score", "score",
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_recurring_lines(docs)


def op6_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_recurring_passages(docs)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find_personal_data(docs, pii.fit(docs))
    return found.select(
        F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans",
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ensemble = quality.fit(docs, table(spark, sf_dir, "labels"), id_hash_mod(F.col("doc_id"), 3) != 1)
    return _judged(quality.score_documents(docs, ensemble), 3, 1)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_documents(
        table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, with_ids=False,
    )
    return found.withColumnRenamed("id", "doc_id")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_term_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = term_pipeline.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars"]
    changed = merkle.row_digest([*[docs[c] for c in fields], F.regexp_replace(docs["text"], "\n", "")])
    observed = F.when(id_hash_mod(docs["doc_id"], 2) == 0, changed)
    found = merkle.manifest(docs, [*fields, "text"], observed=observed)
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.digest(F.col("proof")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = host_rules.judge(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id").withColumnRenamed("host", "source")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_simhash_near_dedup, op2_toxicity, op3_decontamination, op4_lm_scoring, op5_exact_dedup, op6_line_dedup,
    op6_passage_dedup, op7_pii, op8_quality, op9_byte_bpe, op10_sharding,
    op11_term_pipeline, op12_merkle_manifest, op13_host_rules,
)}
