"""From raw documents to packed training windows, stage by stage.

Each stage takes what the one before kept, as documents, and its decisions take effect: rejected documents
go, one document of each near-duplicate group stays, repeated passages are cut out, and what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcast.llm import cotraining, quality_rules
from weekcast.llm.common import read_table, stored
from weekcast.llm.packing import pack
from weekcast.llm.simhash import keep_one
from weekcast.llm.suffix_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the trusted target is what `labels` marks as quality 1."""
    trusted = read_table(spark, sf_dir, "labels").where(F.col("quality") == 1)
    return quality_rules.keep_good(docs.select(*COLUMNS), trusted)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    return cotraining.keep_good(docs.select(*COLUMNS), read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by three-word shingles and at most two differing bits."""
    return keep_one(docs.select(*COLUMNS), shingle_words=3, max_bits=2)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 50 bytes that a document with a smaller id has; a character of which
    a byte goes goes whole. A document of which nothing is left stays, with an empty text."""
    cut = remove_repeats(docs.select(*COLUMNS), extra=("lang", "source"), as_text=True)
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 4096 ids."""
    return pack(docs)


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeats),
    ("packing", packing),
]

#: No stage but the base rules can be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written and read again before the next stage."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
