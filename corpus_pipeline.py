"""The corpus pipeline: stages from raw documents to packed sequences, each written and read again.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the columns of
documents; the last returns the packed pieces. Files go to the folder that the cluster shares. Any stage gives no rows of an empty
table, and hands on columns besides those of documents as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import line_dedup, packing, quality, simhash, toxicity
from strandweave.llm.common import scratch, stored, table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents scored 0.5 or more go. Null and empty texts score 0 without hits and stay; rows are judged each, repeated ones alike; null ids don't matter."""
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return quality.keep_scored(docs, scorer, lambda score: score < 0.5)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents scored below 0.5 go. Null and empty texts are one empty block and get its score; rows are judged each, repeated ones alike; null ids don't matter."""
    scorer = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.keep_scored(docs, scorer, lambda score: score >= 0.5)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: lines equal or near to an earlier one go; every document stays, with what is left of it.

    Null text becomes empty; null ids come first; rows that share id and text are one document and keep one result each; ties between texts of one id go by their hashes.
    """
    return line_dedup.rewrite(docs, short_lines=True)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6, on shingles of five words: of each component the document of the smallest id stays.

    Null ids come first, then texts of one id by their hashes; of repeated rows one stays. Null and empty texts are one component.
    """
    return simhash.keep_first(docs, words=5)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the rest, packed in sequences of 2048 tokens. Null and empty texts are their end token alone; rows are packed each, repeated ones and null ids too."""
    return packing.pack_digests(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("quality", quality_filter),
    ("line_dedup", line_dedup_stage),
    ("simhash", simhash_stage),
    ("packing", packing_stage),
]

#: Learned scores and shared offsets aren't for SQL; tests hold each stage's rows to brute force on what it was given.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages kept; what a stage wrote on its way is removed when its rows are written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir).select(*[F.col(f"`{c}`") for c in docs.columns]), f"pipeline-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
