"""The cleaning statistics of one text in Python, for scans that hold the text there anyway.

They equal the column expressions of ``functions.text``, which stay in the JVM where no Python stage is needed.
"""

from __future__ import annotations

import re

from siltstone.functions.text import ENGLISH_STOPWORDS

RUNS = re.compile(r"\w+")
ASCII_WORDS = re.compile(r"\b[a-z']+\b")
STOPWORDS = frozenset(ENGLISH_STOPWORDS)


def english_score(low: str) -> float:
    """Share of stopwords among the ASCII words of a lower-cased text, against a quarter; 0 without words."""
    found = ASCII_WORDS.findall(low)
    return min(sum(map(STOPWORDS.__contains__, found)) / len(found) / 0.25, 1.0) if found else 0.0


def detected_language(low: str, upstream: str | None, upstream_score: float | None) -> tuple[str, float | None, str]:
    if upstream is not None:
        return upstream, upstream_score, "upstream"
    score = english_score(low)
    return "en" if score >= 0.5 else "unknown", round(score, 4), "heuristic"


def length_fault(text: str, policy) -> str | None:
    if len(text) < policy.min_chars:
        return "too_short_chars"
    n = len(text.split())
    return "too_short_tokens" if n < policy.min_tokens else "too_long_tokens" if n > policy.max_tokens else None


def quality_fault(text: str, low: str, policy) -> str | None:
    runs = RUNS.findall(text)
    chars = sum(map(len, runs))
    if (len(text) - chars - (len(text) - sum(map(len, text.split())))) / len(text) > policy.max_symbol_ratio:
        return "high_symbol_ratio"
    lines = list(filter(None, map(str.strip, text.split("\n"))))
    if len(lines) > 1 and 1.0 - len(set(lines)) / len(lines) > policy.max_repeated_line_ratio:
        return "repetitive_lines"
    if not policy.min_mean_word_length <= (chars / len(runs) if runs else 0.0) <= policy.max_mean_word_length:
        return "anomalous_word_length"
    lower = RUNS.findall(low)
    if (len(set(lower)) / len(lower) if lower else 0.0) < policy.min_unique_word_ratio:
        return "low_lexical_diversity"
    return None


def reject_fault(record_id: str | None, text: str | None, low: str, language: str | None, score: float | None, policy) -> str | None:
    """First reason in the order schema, length, language, quality; null for a kept text."""
    if not record_id or text is None or not text.strip():
        return "empty_or_unidentified"
    wrong = language != policy.language.language or score is None or score < policy.language.min_score
    return length_fault(text, policy.length) or ("language" if wrong else None) or quality_fault(text, low, policy.quality)
