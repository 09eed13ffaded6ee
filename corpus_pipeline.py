"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a table. All but the last
return the columns of ``documents``; each works on all that the one before kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gesso.llm import bpe, mixing, near_copies, pii, quality_table, simhash
from gesso.session import forget, keep

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the threshold table rejects."""
    return quality_table.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id: of fingerprints up to 4 bits apart, then
    of five-word shingles that are 80 % alike, which fingerprints miss."""
    fingerprinted = simhash.drop_near_dups(docs)
    left = near_copies.drop_near_copies(fingerprinted)
    forget(fingerprinted)  # its rows were written anew, with their numbers
    return left


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With personal data replaced by its kind."""
    return pii.mask_personal_data(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, lang, n_tokens, ids, round_trip``: the tokens of each document, and whether they decode to its text."""
    coded = bpe.encode(docs.select("doc_id", "source", "lang", "text"), VOCABULARY, decoded="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixed), ("tokens", tokens)]
#: span classifier, shingle hashes and byte-pair merges have no SQL; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``, each written below the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
