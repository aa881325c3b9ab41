"""From raw documents to token counts of a training mix, in five stages.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and all but the last return the
columns of `documents`. run() writes each stage as Parquet into the shared folder and reads it again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, mixing, ordinal, simhash, suffixes
from lodestone.llm.common import stash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on `labels`, does not reject. Without usable labels all stay."""
    return ordinal.rejected_removed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles have a Jaccard similarity of 0.8 or more, the one with the smallest id."""
    return simhash.near_copies_removed(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 100 bytes or more that an earlier document has; n_chars follows the text."""
    return suffixes.removed(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the digests of ids and decoded bytes, a row for each copy in the mix."""
    return bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id", "source"])


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mix", mix), ("tokens", tokens)]
#: SQL can express neither the fitted classifier nor the merges. Tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stash(docs)
    return docs
