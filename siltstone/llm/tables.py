"""The training-data tables as the operators want them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.runtime import spread, table

#: Other spellings of a split (fixed values).
SPLIT_NAMES = {"validation": "val", "dev": "val", "training": "train"}
#: What Unicode counts as white space and Spark's trim doesn't take (fixed values).
SPACE = r"[\s   -     　\u0085\u001c-\u001f]"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def split_of(c: Column) -> Column:
    """train, val or test; null for null, blank and unknown names."""
    name = F.lower(stripped(c))
    known = F.when(name.isin("validation", "dev"), "val").when(name == "training", "train").otherwise(name)
    return F.when(known.isin("train", "val", "test"), known)


def has_text(c: str = "text") -> Column:
    return F.col(c).isNotNull() & F.col(c).rlike(r"(?U)[^\s\u001c-\u001f]")


def examples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_examples").withColumn("split", split_of(F.col("split")))


def held_out_items(spark: SparkSession, d: str) -> DataFrame:
    """(id, text) of the held-out raw_examples and of benchmark_docs."""
    own = examples(spark, d).where("split in ('val', 'test')").select(F.col("doc_id").alias("id"), "text")
    return spread(own.unionByName(table(spark, d, "benchmark_docs").select(F.col("doc_id").alias("id"), "text")).where(has_text()))


def records(spark: SparkSession, d: str) -> DataFrame:
    """(id, text) of raw_records."""
    return spread(table(spark, d, "raw_records").select(F.col("source_record_id").alias("id"), "text").where(has_text()))
