"""The registered queries of this package: production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linklens.llm import bit_search, collocations, context_mixing, hilbert, importance, mixing, near_dedup, pivot_search, quality, secrets, sentence_pieces, token_counts, token_files
from linklens.llm.words import tokenizer_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_codes(spark, sf_dir):
    return token_files.encoded_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 2)


def op2_exact_search(spark, sf_dir):
    return pivot_search.top_products(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op3_secret_scan(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_sentence_pieces(spark, sf_dir):
    return sentence_pieces.digest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_near_duplicates(spark, sf_dir):
    return near_dedup.components_of(table(spark, sf_dir, "documents"), near_dedup.Likeness(words=3, part=85))


def op6_nearest_neighbours(spark, sf_dir):
    return bit_search.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op7_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 512)


def op8_quality(spark, sf_dir):
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_hilbert_shards(spark, sf_dir):
    return hilbert.shard_digest(table(spark, sf_dir, "documents"))


def op10_mixture(spark, sf_dir):
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op11_context_mixing(spark, sf_dir):
    return context_mixing.scores(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark, sf_dir):
    return importance.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_codes, op2_exact_search, op3_secret_scan, op4_sentence_pieces, op5_near_duplicates,
                                   op6_nearest_neighbours, op7_token_counts, op8_quality, op9_hilbert_shards, op10_mixture, op11_context_mixing, op12_importance_resampling, op13_collocations)}
