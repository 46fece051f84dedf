"""A training-data pipeline of five operators; each stage's rows are written as Parquet and read again as the next one's input.

All stages but the last return the columns of ``documents`` (and any further columns of their input).  Rejected and
duplicate documents go, secrets are written over, the rest is laid out in the order of the mixing schedule and packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kbspark.llm import mixing, near_dedup, packing, quality, secrets
from kbspark.llm.common import table
from kbspark.llm.queries import tokenizer_path
from kbspark.sources.durable import release, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the trees keep, judged by their own text; null and empty texts go, repeated rows fare alike."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies and one row of each repeated row, told apart by doc_id and text.

    Rows without a doc_id all stay, as do texts without words; a doc_id that comes with several unlike texts keeps each.
    """
    return near_dedup.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets written over; null and empty texts stay as they are, repeated rows are treated alike."""
    return secrets.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order that gives the sources their target weights; a null source is one of its own."""
    return mixing.in_order(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences; null and empty texts are one end token."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_duplicates), ("secret_scan", secret_scan), ("source_mixing", source_mixing), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark, name) as keep:  # what a stage wrote for itself goes when its result is written
            docs = keep(stage(spark, docs, sf_dir))
        release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained trees, the schedule and the packing have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None
