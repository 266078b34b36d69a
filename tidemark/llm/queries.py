"""The registered queries of this subpackage: thin wrappers with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, language_id, license_scan, linededup, lm_scoring, mixing, ngram_join, quality_classifier, quality_rules
from .common import fold_of


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 4) == 2
    found = language_id.predict(docs, language_id.fit(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contained(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # This query's SQL fixes the words at which units begin; elsewhere they begin at every word.
    cut = linededup.dedup(_read(spark, sf_dir, "documents"), offsets=True, anchor=4)
    spans = F.array_join(F.transform("kept_spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string"))), ";")
    return cut.select("doc_id", "text", F.col("n_removed").cast("long").alias("n_removed"), spans.alias("kept_spans"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(_read(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.decisions(_read(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 5) == 0
    model = quality_classifier.fit(docs, _read(spark, sf_dir, "labels"), ~held_out)
    found = quality_classifier.predict(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality_classifier.THRESHOLD).cast("int").alias("predicted"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(_read(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 5) == 1
    found = lm_scoring.score(docs, *lm_scoring.fit(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_decontamination,
        op3_substring_dedup,
        op4_quality_rules,
        op5_mixing,
        op6_quality_classifier,
        op7_ngram_join,
        op8_lm_scoring,
        op9_html_extraction,
        op10_license_scan,
    )
}
