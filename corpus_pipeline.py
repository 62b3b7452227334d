"""A corpus pipeline: languages, near-duplicates, secrets, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm import language_id, mixing, packing, secret_scan, similar
from vectide.llm.common import BATCH_BYTES, bound_batches, delete, free_name, new_path, quoted, scratch, table

#: SQL can't express the stages.
ORACLE_SQL = None


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in some language that the labelled ones teach; the rest (und) go."""
    bound_batches(spark)
    model = language_id.learn(docs.where(~language_id.held_out(F.col("doc_id"))))
    told = tuple(free_name(docs, x) for x in language_id.TOLD)
    return language_id.identify(docs, model, docs.columns, told=told).where(F.col(told[0]) != "und").select(*quoted(docs.columns))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group whose 5-word shingle sets have similarity 0.8 or more."""
    bound_batches(spark)
    return similar.keep_one(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which sources take turns by their target weights."""
    return mixing.in_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place; sequences go by the order in which the documents are, that of the mix."""
    bound_batches(spark)
    return packing.pack_as_given(docs)


STAGES = [("language_id", keep_languages), ("simhash_dedup", keep_one_of_each), ("secret_scan", hide_secrets), ("source_mixing", mix_sources), ("best_fit_packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's result is written as Parquet in the shared folder and read again.

    What stages write for themselves is deleted once their result is written, and that once the next one is.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    bounded = bound_batches(spark)
    try:
        for name, stage in STAGES:
            path = new_path(spark, name)
            with scratch(spark):
                after = stage(spark, docs, sf_dir)
                after.write.option("compression", "zstd").parquet(path)
            docs = spark.read.schema(after.schema).parquet(path)
            if last is not None:
                delete(spark, last)
            last = path
    finally:
        if bounded:
            spark.conf.unset(BATCH_BYTES)
    return docs
