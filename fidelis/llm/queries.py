"""One query for each operator, over its whole table and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import html_extract, language_id, media, mixing, ngram_join, periodic_runs, quality_classifier, quality_rules, sentencepiece_lattice, simhash_anchors, source_divergence, token_counts, token_output
from .common import read

#: Shares of a round by source; every other source has one.
SHARES, BLOCK = {"src0": 4, "src1": 3, "src2": 2}, 16


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(read(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_lattice.sentencepiece_summary(read(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source"), SHARES, block=BLOCK, many=True)
    return mixed.select("doc_id", "source", "mix_block", "mix_slot", "mix_position", "mix_on_target")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(read(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.html_text(read(spark, sf_dir, "pages"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(read(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_classifier(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(read(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.source_divergence(read(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(read(spark, sf_dir, "documents"))


def op13_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_anchors.simhash(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_token_counts, op3_sentencepiece, op4_source_mixing, op5_quality_rules, op6_ngram_join, op7_html_text, op8_media_columns, op9_quality_classifier, op10_token_output, op11_source_divergence, op12_periodic_runs, op13_simhash_anchors)}
ORACLE_SQL: dict[str, str] = {"op11_source_divergence": source_divergence.divergence_sql()}
