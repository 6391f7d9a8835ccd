"""A corpus pipeline: quality rules, exact dedup, near dedup, mixing, BPE.

Each stage takes what the stage before it kept, written as Parquet and read
again. All but the last return the columns of documents. Rows that repeat an id and
a text are one document here.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from avrolith.llm import bpe, exact_dedup, mixing, near_dedup, quality
from avrolith.llm.common import discard, materialize, read_table


def _digest() -> Column:
    return F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)


def _keep(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose own verdict, found by all columns of kept (null equals null), is to stay."""
    keys = kept.columns
    kept = kept.distinct().toDF(*[f"__kept_{k}" for k in keys])
    return docs.join(kept, [F.col(k).eqNullSafe(F.col(f"__kept_{k}")) for k in keys], "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go; null and empty texts with them. Each
    row is judged by itself, also without an id or with one that others have."""
    row = F.to_json(F.struct("doc_id", "lang", "source"), {"ignoreNullFields": "false"})
    keyed = docs.withColumn("__key", F.sha2(F.concat(_digest(), row), 256))
    kept = quality.judge(keyed, id_col="__key").where("kept").select(F.col("doc_id").alias("__key"))
    return _keep(keyed, kept).select(*docs.columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays; one without an id if none has any. A null
    text equals an empty one."""
    keyed = docs.withColumn("__digest", _digest())
    kept = exact_dedup.exact_dedup(docs).where("kept").select("doc_id", F.col("text_sha256").alias("__digest"))
    return _keep(keyed, kept).dropDuplicates(["doc_id", "__digest"]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, 0.8) the smallest id stays.

    Rows without an id, and those of an id's texts that don't have its smallest digest,
    are compared under ids of their own, beyond all others."""
    keyed = docs.withColumn("__digest", _digest())
    pairs = materialize(keyed.select("doc_id", "__digest").distinct(), "pairs")
    first = pairs.where("doc_id is not null").groupBy("doc_id").agg(F.min("__digest").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    odd = pairs.where("doc_id is null").unionByName(pairs.join(first, "doc_id").where("__digest <> first").select("doc_id", "__digest"))
    beyond = (pairs.agg(F.max("doc_id")).first()[0] or 0) + 1
    odd = materialize(odd.select(F.col("doc_id").alias("__odd"), F.col("__digest").alias("__odd_digest"), (F.lit(beyond) + F.monotonically_increasing_id()).alias("__new")), "odd")
    if odd.isEmpty():
        return _keep(docs, near_dedup.near_duplicates(docs).where("kept").select("doc_id"))
    keyed = keyed.join(odd, F.col("doc_id").eqNullSafe(F.col("__odd")) & (F.col("__digest") == F.col("__odd_digest")), "left")
    keyed = keyed.select(*docs.columns, F.coalesce("__new", "doc_id").alias("__id"))
    kept = near_dedup.near_duplicates(keyed, id_col="__id").where("kept").select(F.col("doc_id").alias("__id"))
    return _keep(keyed, kept).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, sorted by their place in it over
    the whole output: partitions, and the files written of them by name, follow the schedule. A null
    source is one source; an empty table stays empty."""
    mixed = mixing.mix(docs)
    return mixed.repartitionByRange("__slot", "__place").sortWithinPartitions("__slot", "__place").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and the digest of the text that they decode to, in
    the order of the mix: that of the files by name and of the rows in them, which Spark's
    reader doesn't keep by itself. A null text has no tokens."""
    place = ["__file", "__start", "__row"]
    rows = docs.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("__row"))
    try:
        rows = rows.select("*", F.input_file_name().alias("__file"), F.input_file_block_start().alias("__start"))
    except AnalysisException:  # not read from files of one table: partitions are in order
        place = ["__row"]
    rows = rows.repartitionByRange(*place).sortWithinPartitions(*place)
    encoded = bpe.encode_documents(rows.select("doc_id", "source", "text"), digest_col="decoded_sha256")
    return encoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("near dedup", near_duplicates),
    ("mix sources", mix_sources),
    ("bpe", encode),
]

#: The outlier test and near-duplicate components can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        discard(before)  # the table of documents isn't one of ours
    return docs
