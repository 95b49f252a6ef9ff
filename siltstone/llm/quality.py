"""Problem 5: per-record text statistics, robust Mahalanobis distances and policy breaks.

One scan computes the statistics of every text. Per prose language (the language most of a text's
common words belong to) a robust centre and covariance are found by distributed sums: medians and
median deviations mark a core, whose mean and covariance are then re-estimated over the records
within the chi-square limit (two concentration steps). The squared distance of a record splits into
one contribution per statistic, ``z_i * (P z)_i``, which add up to it.

Breaking a limit of a source means to be at least as far out as the limit: for a limit at distance
``delta`` from the centre in statistic j, ``d**2 >= delta**2 / cov_jj``. So the least distance at which a
limit of a source can break is known per language and source; records nearer than that are done,
the others are checked against the limits exactly.

Null and blank texts give no row; no words means a mean word length and word ratios of 0.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.runtime import cut

STATS = ["symbol_ratio", "repeated_line_ratio", "mean_word_length", "unique_word_ratio", "line_end_ratio", "common_word_ratio", "digit_ratio", "log_words"]
LIMITS = ["max_symbol_ratio", "max_repeated_line_ratio", "min_mean_word_length", "max_mean_word_length", "min_unique_word_ratio", "min_line_end_ratio", "min_common_word_ratio"]
#: Chi-square 0.975 quantile for as many degrees of freedom as statistics (fixed value).
CHI2_975_8 = 17.5345
#: Core of the first step, in robust standard deviations; least standard deviation of each statistic.
CORE = 3.5
LEAST_DEVIATION = 0.01
NO_LANGUAGE = "und"

RUNS = re.compile(r"\w+")
#: Marks a sentence ends with, and what may follow them (fixed values).
STOPS = (".", "!", "?", "…")
CLOSERS = "\"'”’»)]"


def ends_sentence(line: str) -> bool:
    """Whether a trimmed line ends in a stop, closing quotes and brackets aside."""
    return line.rstrip(CLOSERS).endswith(STOPS)


def statistics_of(text: str, common: dict[str, str]) -> tuple[str, list[float]]:
    """Prose language and statistics of a text; ``common`` maps a word to its languages, blank-separated."""
    runs = RUNS.findall(text)
    low = " ".join(runs).lower().split()
    joined = "".join(runs)
    n = len(low)
    blanks = len(text) - sum(map(len, text.split()))
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    hits = list(filter(None, map(common.get, low)))
    votes: dict[str, int] = {}
    for langs in hits:
        votes[langs] = votes.get(langs, 0) + 1
    per: dict[str, int] = {}
    for langs, k in votes.items():
        for lang in langs.split():
            per[lang] = per.get(lang, 0) + k
    language = min(per, key=lambda x: (-per[x], x)) if per else NO_LANGUAGE
    digits = 0 if joined.isalpha() else sum(map(joined.count, "0123456789"))
    return language, [
        (len(text) - len(joined) - blanks) / len(text),
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        len(joined) / n if n else 0.0,
        len(set(low)) / n if n else 0.0,
        sum(map(ends_sentence, lines)) / len(lines) if lines else 0.0,
        len(hits) / n if n else 0.0,
        digits / len(text),
        float(np.log1p(n)),
    ]


def breaks_policy(limits: tuple, s: list[float]) -> bool:
    """Whether the statistics break one of the limits (in the order of LIMITS); a null limit never breaks."""
    if limits is None:
        return False
    symbol, repeated, low, high, unique, end, common = limits
    return bool(
        (symbol is not None and s[0] > symbol)
        or (repeated is not None and s[1] > repeated)
        or (low is not None and s[2] < low)
        or (high is not None and s[2] > high)
        or (unique is not None and s[3] < unique)
        or (end is not None and common is not None and s[4] < end and s[5] < common)
    )


def common_map(words: DataFrame) -> dict[str, str]:
    """The list of common words (a fixed table of a few hundred rows) by word."""
    out: dict[str, list[str]] = {}
    for row in words.where("word is not null and lang is not null").select("word", "lang").distinct().orderBy("word", "lang").collect():
        out.setdefault(row["word"], []).append(row["lang"])
    return {w: " ".join(v) for w, v in out.items()}


def policy_map(policy: DataFrame) -> dict[str, tuple]:
    """The policies (a fixed table of one row a source) by source."""
    return {r["source_id"]: tuple(r[c] for c in LIMITS) for r in policy.select("source_id", *LIMITS).collect()}


def statistics(records: DataFrame, common: dict[str, str]) -> DataFrame:
    """(id, source, lang, the STATS) of ``records`` (id, source, text)."""

    def scan(rows):
        for batch in rows:
            langs, values = [], []
            for text in batch.column(2).to_pylist():
                language, s = statistics_of(text, common)
                langs.append(language)
                values.append(s)
            table = np.array(values, dtype=float).reshape(len(langs), len(STATS))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), *(pa.array(table[:, k]) for k in range(len(STATS)))], ["id", "source", "lang", *STATS])

    return records.where(r"text is not null and text <> ''").select("id", "source", "text").mapInArrow(scan, "id string, source string, lang string, " + ", ".join(f"{s} double" for s in STATS))


def _moments(stats: DataFrame, inside) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean and covariance per language over the rows where ``inside``."""
    k = len(STATS)
    sums = [F.sum(s).alias(f"s{i}") for i, s in enumerate(STATS)]
    products = [F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]
    out = {}
    for r in stats.where(inside).groupBy("lang").agg(F.count("*").alias("n"), *sums, *products).collect():
        n, mean = r["n"], np.array([r[f"s{i}"] for i in range(k)]) / r["n"]
        cov = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] / n for j in range(k)] for i in range(k)]) - np.outer(mean, mean)
        out[r["lang"]] = (mean, cov + np.eye(k) * LEAST_DEVIATION**2)
    return out


def _distances(model: dict, stats: DataFrame) -> DataFrame:
    inverse = {lang: (mean, np.linalg.inv(cov)) for lang, (mean, cov) in model.items()}

    def scan(rows):
        for batch in rows:
            x = np.column_stack([batch.column(3 + i).to_numpy(zero_copy_only=False) for i in range(len(STATS))]) if batch.num_rows else np.zeros((0, len(STATS)))
            langs = np.array(batch.column(2).to_pylist(), dtype=object)
            parts = np.full(x.shape, np.nan)
            for lang, (mean, precision) in inverse.items():
                at = langs == lang
                z = x[at] - mean
                parts[at] = z * (z @ precision)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(parts.ravel()), len(STATS)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.sqrt(np.maximum(parts.sum(axis=1), 0))), lists], [*batch.schema.names, "distance", "contributions"])

    return stats.mapInArrow(scan, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema) + ", distance double, contributions array<double>")


def robust_model(stats: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Robust mean and covariance of the statistics per language; only sums per language reach the driver."""
    medians = stats.groupBy("lang").agg(F.count("*").alias("n"), *(F.percentile_approx(s, 0.5, 1000).alias(s) for s in STATS))
    spread = stats.join(F.broadcast(medians.select("lang", *(F.col(s).alias(f"m_{s}") for s in STATS))), "lang")
    found = medians.collect()
    centre = {r["lang"]: [r[s] for s in STATS] for r in found}
    mads = spread.groupBy("lang").agg(*(F.percentile_approx(F.abs(F.col(s) - F.col(f"m_{s}")), 0.5, 1000).alias(s) for s in STATS))
    width = {r["lang"]: [1.4826 * r[s] + LEAST_DEVIATION for s in STATS] for r in mads.collect()}
    inside = F.lit(False)
    for lang in centre:
        near = F.col("lang") == lang
        for s, c, w in zip(STATS, centre[lang], width[lang]):
            near &= F.abs(F.col(s) - c) <= CORE * w
        inside |= near
    model = _moments(stats, inside)
    for lang in centre:  # a language without a core keeps its medians
        model.setdefault(lang, (np.array(centre[lang]), np.diag(np.array(width[lang]) ** 2)))
    closer = _moments(_distances(model, stats), F.col("distance") <= CHI2_975_8**0.5)
    model |= closer
    known = [r for r in found if r["lang"] != NO_LANGUAGE]
    if known:  # texts without common words are held against the prose of the most frequent language
        model[NO_LANGUAGE] = model[max(known, key=lambda r: (r["n"], r["lang"]))["lang"]]
    return model


def least_breaking(model: dict, policies: dict[str, tuple]) -> dict[tuple[str, str], float]:
    """Per (language, source) the least distance at which a limit can break."""
    out = {}
    for lang, (mean, cov) in model.items():
        dev = np.sqrt(np.diag(cov))
        for source, (symbol, repeated, low, high, unique, end, common) in policies.items():
            above = lambda limit, i: np.inf if limit is None else max(0.0, (limit - mean[i]) / dev[i])
            below = lambda limit, i: np.inf if limit is None else max(0.0, (mean[i] - limit) / dev[i])
            both = max(below(end, 4), below(common, 5))
            out[lang, source] = min(above(symbol, 0), above(repeated, 1), below(low, 2), above(high, 2), below(unique, 3), both)
    return out


def scored(records: DataFrame, common: dict[str, str], policies: dict[str, tuple]) -> DataFrame:
    """Statistics, distance, contributions and ``breaks`` of each record (id, source, text).

    ``suspect`` says that the distance reaches the least one at which the source's limits can break;
    only suspects are checked. A source without policy breaks nothing.
    """
    stats = cut(statistics(records, common))
    model = robust_model(stats)
    least = least_breaking(model, policies)

    def check(rows):
        for batch in rows:
            cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names) if n in ("source", "lang", "distance", *STATS)}
            suspect, breaks = [], []
            for i, (source, lang, distance) in enumerate(zip(cols["source"], cols["lang"], cols["distance"])):
                limit = least.get((lang, source))
                far = limit is not None and distance >= limit * (1 - 1e-6) - 1e-9
                suspect.append(far)
                breaks.append(far and breaks_policy(policies.get(source), [cols[s][i] for s in STATS]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(suspect, pa.bool_()), pa.array(breaks, pa.bool_())], [*batch.schema.names, "suspect", "breaks"])

    far = _distances(model, stats)
    return far.mapInArrow(check, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in far.schema) + ", suspect boolean, breaks boolean")
