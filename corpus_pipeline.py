"""The corpus pipeline: quality rules, near duplicates, repeated lines, test leaks, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep
the columns of ``documents``.  The last adds mix_size and mix_taken: the words of each
document and the words of it that the mix takes, repeats counted.

Defined results: a null, empty or short text fails the quality rules; a row with a null doc_id
is judged like any other, but kept by the near-duplicate and leak stages, which can't
name it; of rows with one doc_id and equal texts one stays; ties are settled by doc_id;
very long texts are handled whole; empty tables go through; extra columns pass, whatever
their names, but for mix_size and mix_taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, linededup, mixing, ngram_join, quality_rules
from tidemark.llm.common import store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document or place has go; kept_spans aren't columns of documents, so only the text tells."""
    return linededup.dedup(docs)


def test_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words taken."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", test_leaks),
    ("mixing sources", mixed),
]

#: Divergence from learned references and the join by sketches aren't written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = store(docs).df
    return docs
