"""Cleaning gates: ordered reasons, of which a text's first is counted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as T


@dataclass(frozen=True)
class LengthPolicy:
    min_chars: int = 200
    min_tokens: int = 50
    max_tokens: int = 20_000


@dataclass(frozen=True)
class QualityPolicy:
    max_symbol_ratio: float = 0.20
    max_repeated_line_ratio: float = 0.30
    min_mean_word_length: float = 2.5
    max_mean_word_length: float = 12.0
    min_unique_word_ratio: float = 0.20


@dataclass(frozen=True)
class LanguagePolicy:
    language: str = "en"
    min_score: float = 0.85


@dataclass(frozen=True)
class CleaningPolicy:
    length: LengthPolicy = LengthPolicy()
    quality: QualityPolicy = QualityPolicy()
    language: LanguagePolicy = LanguagePolicy()

    @classmethod
    def from_config(cls, config: dict) -> "CleaningPolicy":
        """Policy from a nested dict; unknown keys are an error."""
        return cls(LengthPolicy(**config.get("length", {})), QualityPolicy(**config.get("quality", {})), LanguagePolicy(**config.get("language", {})))


def length_reason(c: Column, policy: LengthPolicy = LengthPolicy()) -> Column:
    """First length reason, null if there is none."""
    tokens = T.let(T.token_count(c), lambda n: F.when(n < policy.min_tokens, "too_short_tokens").when(n > policy.max_tokens, "too_long_tokens"))
    return F.when(F.length(c) < policy.min_chars, "too_short_chars").otherwise(tokens)


def quality_reason(c: Column, policy: QualityPolicy = QualityPolicy()) -> Column:
    anomalous = T.let(T.mean_word_length(c), lambda m: ~m.between(policy.min_mean_word_length, policy.max_mean_word_length))
    return (
        F.when(T.symbol_ratio(c) > policy.max_symbol_ratio, "high_symbol_ratio")
        .when(T.repeated_line_ratio(c) > policy.max_repeated_line_ratio, "repetitive_lines")
        .when(anomalous, "anomalous_word_length")
        .when(T.unique_word_ratio(c) < policy.min_unique_word_ratio, "low_lexical_diversity")
    )


def language_reason(language: Column, score: Column, policy: LanguagePolicy = LanguagePolicy()) -> Column:
    return F.when(~language.eqNullSafe(F.lit(policy.language)) | F.coalesce(score < policy.min_score, F.lit(True)), "language")


def schema_reason(record_id: Column, c: Column) -> Column:
    return F.when(record_id.isNull() | (record_id.cast("string") == "") | c.isNull() | (T.trim_all(c) == ""), "empty_or_unidentified")


def reject_reason(record_id: Column, c: Column, language: Column, score: Column, policy: CleaningPolicy = CleaningPolicy()) -> Column:
    """First reason in the order schema, length, language, quality; null for a kept text."""
    return F.coalesce(schema_reason(record_id, c), length_reason(c, policy.length), language_reason(language, score, policy.language), quality_reason(c, policy.quality))


def cleaning_stats(judged: DataFrame, by: str | None = None) -> DataFrame:
    """(by, reason, n) of a frame with ``reject_reason``; kept rows count as ``kept``."""
    keys = [by] if by else []
    return judged.groupBy(*keys, F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def merge_stats(stats: DataFrame) -> DataFrame:
    """Totals over segments of (reason, n)."""
    return stats.groupBy("reason").agg(F.sum("n").alias("n"))


def merge_segments(records: DataFrame) -> DataFrame:
    """One row over segment statistics (segment, seen, kept, worker, seconds, error): what was read, failed, seen and kept, by how many workers, how long.

    ``failed`` lists the segments with an error, in order; a crawl has some ten thousand segments at most.
    """
    bad = F.col("error").isNotNull()
    return records.agg(
        F.count_if(~bad).alias("segments_read"), F.array_sort(F.collect_list(F.when(bad, F.col("segment")))).alias("failed"), F.coalesce(F.sum("seen"), F.lit(0)).alias("seen"), F.coalesce(F.sum("kept"), F.lit(0)).alias("kept"),
        F.bround(F.coalesce(F.try_divide(F.sum("kept"), F.sum("seen")), F.lit(0.0)), 4).alias("keep_rate"), F.count_distinct("worker").alias("workers"), F.round(F.coalesce(F.max("seconds"), F.lit(0.0)), 3).alias("seconds_max"), F.round(F.coalesce(F.sum("seconds"), F.lit(0.0)), 3).alias("seconds_sum"),
    )


def keep_rate(judged: DataFrame) -> DataFrame:
    kept = F.count_if(F.col("reject_reason").isNull())
    return judged.agg(F.count("*").alias("seen"), kept.alias("kept"), F.bround(F.coalesce(F.try_divide(kept, F.count("*")), F.lit(0.0)), 4).alias("keep_rate"))


def policy_violations(written: DataFrame, tokens: str, policy: LengthPolicy = LengthPolicy()) -> DataFrame:
    """One row: how many written texts are outside the token limits, and the least and most found."""
    bad = ~F.col(tokens).between(policy.min_tokens, policy.max_tokens)
    return written.agg(F.count_if(bad).alias("n_outside"), F.min(tokens).alias("least"), F.max(tokens).alias("most"))
