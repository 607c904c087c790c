"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet to the shared checkpoint folder and reads it again as the next
stage's docs.  All stages but the last return the columns of documents.

Defined cases: rows with a null or empty text stay up to the last stage, where
each is a piece that holds the end id; so do texts of which a stage leaves no
word.  Rows with a null id are judged by their text alone: they link with
nothing, lose no passage and can be toxic or hold a test item.  Of rows with
one id the Jaccard stage keeps one.  Very long texts are read whole, other columns
are kept whatever their names, and an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, jaccard, packing, shared, substrings, toxicity

#: Words that a passage must have for the substring stage to take it out of later documents.
PASSAGE = 50


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.keep_clean(docs, shared.table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity of 0.8 or more on five-word shingles, the smallest id stays."""
    return jaccard.keep_one(docs, k=5, percent=80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has, too, go."""
    return substrings.deduplicated(docs, PASSAGE)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go."""
    return decontamination.keep_clean(docs, shared.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", without_near_copies),
    ("substring_dedup", without_repeats),
    ("benchmark_decontamination", without_test_items),
    ("best_fit_packing", packed),
]

#: Tokens and alignments are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.prepare(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
