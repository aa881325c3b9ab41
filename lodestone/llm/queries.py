"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import backoff, bpe, divergence, embeddings, licences, mixing, ordinal, sharding, simhash, suffixes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ordinal.score(docs.select("doc_id", "text"), ordinal.train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"))  # whole records; size and checksum are those of what the shards hold
    crc = F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")))
    return placed.select("doc_id", sharding.record_size(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), keep=["doc_id"])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "fingerprint", "component_id")


def op9_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.score(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ordinal": op1_ordinal,
    "op2_suffixes": op2_suffixes,
    "op3_embeddings": op3_embeddings,
    "op4_sharding": op4_sharding,
    "op5_licences": op5_licences,
    "op6_divergence": op6_divergence,
    "op7_mixing": op7_mixing,
    "op8_simhash": op8_simhash,
    "op9_backoff": op9_backoff,
    "op10_bpe": op10_bpe,
}
ORACLES: dict[str, str] = {"op3_embeddings": embeddings.ORACLE, "op5_licences": licences.ORACLE, "op7_mixing": mixing.ORACLE, "op9_backoff": backoff.ORACLE}
