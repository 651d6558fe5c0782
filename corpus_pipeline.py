"""A corpus pipeline over documents: each stage works on all that the one before it kept, and its decisions take
effect. All but the last return the columns of documents, whatever further ones there are; an empty table stays empty."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterflow.llm.common import cut, drop_folder, shared_dir, spare_name, table
from rasterflow.llm.line_dedup import line_dedup
from rasterflow.llm.packing import pack_documents
from rasterflow.llm.quality import measured, references
from rasterflow.llm.simhash import drop_near_duplicates
from rasterflow.llm.toxicity import score, trained

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC = 0.3


def clean_of_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity score is 0.3 or more. Null and empty texts have no n-gram, so they stay as long
    as a text without any does; rows that repeat a text share its verdict, whatever their ids are."""
    model = trained(docs, table(spark, sf_dir, "labels"))
    name = spare_name(docs, "toxicity")
    return score(docs, model, score_col=name).filter(F.col(name) < TOXIC).select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or lie too far from their language's histograms. Null, empty and very
    short texts fail the base rules; rows that repeat a text share its verdict; a null language has the pooled reference."""
    return measured(docs, cut(references(docs))).filter("kept").select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more. It is the one
    with the lowest id; null ids rank last, and of rows that repeat id and text one stays. Null and empty texts are one group."""
    return drop_near_duplicates(docs, k=5, least=0.8)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines and passages that another document, or an earlier line, has; n_chars follows the text. No row
    goes: one that is all repeats stays with an empty text. Null texts stay null; rows with a null id lose only what
    they repeat themselves."""
    name = spare_name(docs, "removed")
    done = line_dedup(docs, removed_col=name).drop(name)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens. A null or empty text is its end token alone; repeated rows and
    null ids are packed like others."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=4096)


STAGES = [
    ("toxicity", clean_of_toxic),
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("line_dedup", without_repeats),
    ("packing", packed),
]

#: No SQL expresses hashing with XXH64, a classifier's fit or a tokenizer; the tests hold brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again; what a stage wrote
    goes once the next one has."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            drop_folder(spark, f"{folder}/{before}")
        before = name
    return docs
