"""The corpus pipeline: quality rules, near duplicates, repeated passages, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.bpe import bpe_encode_decode
from folioflow.llm.common import remove, settled
from folioflow.llm.mixing import mix_documents
from folioflow.llm.ngram_join import keep_one_of_each
from folioflow.llm.quality import quality_filter
from folioflow.llm.queries import vocabulary
from folioflow.llm.substring import substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words of a window that counts as a repeated passage, and the similarity of near duplicates.
WINDOW_WORDS, SIMILARITY = 50, 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go.

    Null, blank and short texts fail the base rules and go; null languages and sources are groups of their
    own; rows that are equal are judged alike; very long texts are measured whole; an empty table stays
    empty. Columns beside those of documents don't matter, here and in the other stages.
    """
    return quality_filter(docs.select(COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar documents, the one with the least doc_id stays.

    Null and blank texts and rows without a doc_id are like no other and stay; of rows that are equal in
    doc_id and text one stays; of unlike texts with one doc_id all stay; an empty table stays empty.
    """
    return keep_one_of_each(docs.select(COLUMNS), threshold=SIMILARITY)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a document with a smaller doc_id has go; documents of which all words go are dropped.

    A text that loses words is joined anew by single spaces and its n_chars counted; all others come as
    they are, null and blank ones and rows without a doc_id among them. Equal rows have equal doc_ids, so
    none takes words from the other; an empty table stays empty.
    """
    found = substring_dedup(docs.select(COLUMNS), length=WINDOW_WORDS)
    left = found.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    counted = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars").cast("long"))
    return left.withColumn("n_chars", counted).select(COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole passes over documents, and parts of them, until each source has its target.

    A document can come several times, or only in part. Null and blank texts give nothing and go; the
    null source is a source, last in order; equal rows are rows of their own; an empty table stays empty.
    """
    return mix_documents(docs.select(COLUMNS)).select(COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text, how many they are, and the text that they decode to.

    Null texts count as empty: no ids and an empty text. Every row is handled by itself, so equal rows give
    equal results; an empty table stays empty.
    """
    found = bpe_encode_decode(docs.select(COLUMNS), vocabulary())
    return found.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", source_mix),
    ("BPE encoding and decoding", token_ids),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote on its way goes when it is whole, and its rows when the next is."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if held:
            remove(spark, held)
        held = path
    return docs
