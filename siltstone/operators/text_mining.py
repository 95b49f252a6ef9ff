"""Aggregates over words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T


def top_words(docs: DataFrame, key: str, n: int, least_length: int = 4) -> DataFrame:
    """(key, topic): the n most frequent Latin words that aren't stopwords, ties by first occurrence.

    Words are counted per document with partial sums; texts without such words have no row.
    """
    words = docs.where("text is not null").select(key, F.posexplode(T.latin_words(F.col("text"))).alias("p", "w"))
    counts = words.where((F.length("w") >= least_length) & ~F.col("w").isin(T.ENGLISH_STOPWORDS)).groupBy(key, "w").agg(F.count("*").alias("n"), F.min("p").alias("p"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "p"))).where(F.col("r") <= n)
    return ranked.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "w"))), lambda x: x["w"]), ", ").alias("topic"))
