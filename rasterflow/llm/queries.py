"""The corpus operators as registered queries, with production parameters, and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .bpe import encoding_digests
from .collocations import collocations
from .common import shared_dir, table
from .embedding_dedup import embedding_components
from .line_dedup import line_dedup
from .packing import pack_documents
from .pii import private_spans
from .quality import quality
from .sharding import shards
from .simhash import simhash_components
from .token_counts import token_counts
from .toxicity import toxicity
from .vector_codes import vector_codes
from .warc import archive_round_trip, remove


def op1_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"), count=16)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole texts less their repeats, with offsets and keepers of what went."""
    done = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "text", "removed", F.size("removed").alias("n_removed"), F.expr("aggregate(removed, 0, (a, r) -> a + r.words)").alias("removed_words"), F.array_distinct(F.flatten("removed.keepers")).alias("repeats_of"))


def op3_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op4_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    try:
        return archive_round_trip(table(spark, sf_dir, "pages"), folder)
    finally:
        remove(folder)


def op5_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), k=3, radius=2)


def op6_toxicity_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op7_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=4096)


def op9_embedding_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"), least=0.95)


def op10_distinct_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op11_hamerly_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)


def op12_boosted_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", F.size("added").alias("n_added"))


def op13_pivot_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), least=100, longest=5, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_feistel_sharding": op1_feistel_sharding,
    "op2_line_dedup": op2_line_dedup,
    "op3_distribution_divergence": op3_distribution_divergence,
    "op4_warc_normaliser": op4_warc_normaliser,
    "op5_simhash_bktree": op5_simhash_bktree,
    "op6_toxicity_ngrams": op6_toxicity_ngrams,
    "op7_forced_boundary_bpe": op7_forced_boundary_bpe,
    "op8_cost_balanced_packing": op8_cost_balanced_packing,
    "op9_embedding_pigeonhole": op9_embedding_pigeonhole,
    "op10_distinct_token_counts": op10_distinct_token_counts,
    "op11_hamerly_codes": op11_hamerly_codes,
    "op12_boosted_private_spans": op12_boosted_private_spans,
    "op13_pivot_collocations": op13_pivot_collocations,
}

SQL: dict[str, str] = dict(oracles.SQL)
