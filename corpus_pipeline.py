"""A corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, benchmark decontamination, packing.

Each stage takes all that the one before kept. Between stages the documents are written as Parquet in the cluster's shared folder and
read again, so a lost executor costs at most the running stage's tasks; a stage's input goes once its output is written.

Defined cases, as the operators state them: a null or empty text is never toxic, near another or a leak, of several equal ones exact dedup
keeps one, and it packs as one token; rows that repeat, or share a doc_id or have none, are rows of their own, of which the dedup stages
keep one for each group; an empty table gives no rows; other columns pass through unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, exact_dedup, jaccard_join, packing, toxicity
from tidemark.llm.common import discard, store, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for blanks, the one that stays."""
    return exact_dedup.keep_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, placed in sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: Learned scores, approximate matches and tokens are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, store(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
