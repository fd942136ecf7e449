"""From raw documents to token ids: quality, near-duplicates, secrets, mixture, SentencePiece.

Defined cases: a null text counts as empty. Texts without words are no one's copies, so the near-duplicate stage keeps all of them; a null text
stays null in the secrets stage and has no token ids. Long texts are taken whole. Each stage takes an empty table and returns an
empty one. All stages but the last keep the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linklens.llm import mixing, near_dedup, quality, secrets, sentence_pieces
from linklens.llm.words import tokenizer_path
from linklens.session import stage


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted quality is 0 go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the smallest id stays."""
    return near_dedup.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; no document goes."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask."""
    return mixing.sampled(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return sentence_pieces.encode_rows(docs, tokenizer_path("piece_bpe_32k.model"), ("doc_id", "lang", "source"))


STAGES = [("quality", drop_poor), ("near_duplicates", drop_copies), ("secrets", mask_secrets), ("mixture", mix_sources), ("encode", encode)]

# The near-duplicate, quality and tokenizer stages can't be stated in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
