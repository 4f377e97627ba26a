"""A corpus pipeline of five stages, each written and read again by the next.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import decontaminate, linededup, nbsvm, near, unigram
from tracewell.scratch import table, written

#: SQL can't express the classifier, the fingerprints or the segmentation; tests hold each stage against brute force.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the classifier rejects; it is learnt from the labelled rows among docs."""
    return nbsvm.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All of docs, their texts without passages of over 50 words and multi-line chunks that stand in an earlier place as well."""
    return linededup.drop_repeated_chunks(written(linededup.drop_repeated_passages(docs), "passages_gone"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: sets of five words of a similarity of 0.8 or more."""
    return near.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, text): each text's piece ids and the text that they decode to."""
    return unigram.round_trip(docs).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "text")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
