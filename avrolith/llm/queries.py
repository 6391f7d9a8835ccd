"""The thin queries over the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from avrolith.llm import bpe, exact_dedup, html_extract, language_id, mixing, near_dedup, quality, toxicity, url_filters, warc
from avrolith.llm.common import read_table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(read_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read_table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = language_id.held_out("doc_id", 3, 1)
    labels = read_table(spark, sf_dir, "labels").where(~out).select("doc_id", "toxic")
    return toxicity.score(docs, labels).withColumn("held_out", language_id.held_out("doc_id", 3, 1)).select("doc_id", "held_out", "score", "predicted")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read_table(spark, sf_dir, "pages"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), k=4)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~language_id.held_out("doc_id", 4, 2)))
    return language_id.identify(docs, model).withColumn("held_out", language_id.held_out("doc_id", 4, 2)).select("doc_id", "held_out", "lang_pred", "score")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(read_table(spark, sf_dir, "pages"), url_filters.rules_table(spark))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_mix_sources, op3_bpe, op4_quality_rules, op5_warc, op6_toxicity, op7_html_text, op8_near_dedup, op9_language_id, op10_url_filters)}

ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op2_mix_sources": mixing.ORACLE,
    "op5_warc": warc.ORACLE,
    "op10_url_filters": url_filters.ORACLE,
}
