"""From raw documents to packed training sequences, in five written stages.

Each stage takes (spark, docs, sf_dir), with docs being what the stage before left, and returns a DataFrame; all but
the last return the columns of documents. Further columns of docs, whatever their names, pass through these four
unchanged; a table without rows gives one without rows; texts are taken whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import jaccard, mixing, packing, pii, quality
from tidemark.llm.common import release, shared_dir, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-supervision rules reject go. Null and empty texts are rejected; repeated rows are judged
    one by one, alike."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar documents stays: five-word shingles, similarity 0.8 or more. The one
    with the smallest doc_id stays, null ids last; of repeated rows one stays; documents without words all stay."""
    return jaccard.keep_one(docs, shingle=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to marks, and n_chars to the new length. Null texts stay null, all rows stay."""
    return pii.masked(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times. Rows with equal doc_id and text are taken alike; a
    null source is a source of its own; documents without words cost nothing."""
    return mixing.mix_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences, for each row of docs; a null text is one end token. Rows that are
    repeated have pieces that are repeated, each with a place of its own."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("skip_chain_pii", personal_data),
    ("source_mixing", source_mix),
    ("best_fit_packing", packed_sequences),
]

#: Shingle joins, message passing and tokenisers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again. What the operators write on their way
    goes when their stage stands."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        before = written()
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
        release(spark, before)
    return docs
