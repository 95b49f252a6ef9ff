"""Detector metrics over (y_true, score) frames; label 1 is machine text, a hit is ``score >= threshold``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.runtime import cut


RANGES = 64


def rates(df: DataFrame, threshold: float, by: list[str] = ()) -> DataFrame:
    """fpr, fnr and precision; null where undefined."""
    hit, ai = F.col("score") >= threshold, F.col("y_true") == 1
    return df.groupBy(*by).agg(
        F.try_divide(F.count_if(hit & ~ai), F.count_if(~ai)).alias("fpr"), F.try_divide(F.count_if(~hit & ai), F.count_if(ai)).alias("fnr"), F.try_divide(F.count_if(hit & ai), F.count_if(hit)).alias("precision")
    )


def value_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows per distinct score: ranks over these need no window over all rows."""
    return df.groupBy(*by, "score").agg(F.count("*").alias("n"), F.sum("y_true").alias("pos"))


def score_at_rank(df: DataFrame, rank: int) -> float:
    """The ``rank``-th smallest score (from 1), by counts per value range: exact, without sorting all rows in one task."""
    w = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = df.groupBy("score").agg(F.count("*").alias("n"))
    low, high = None, None
    # narrow to a range of few distinct scores first
    while True:
        part = counts if low is None else counts.where(F.col("score").between(low, high))
        base = 0 if low is None else (counts.where(F.col("score") < low).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        stats = part.agg(F.min("score"), F.max("score"), F.count("*")).first()
        if stats[2] <= 50_000 or stats[0] == stats[1]:
            return part.withColumn("c", F.sum("n").over(w)).where(F.col("c") + base >= rank).agg(F.min("score")).first()[0]
        step = (stats[1] - stats[0]) / 1000
        cells = part.groupBy(F.least(F.floor((F.col("score") - stats[0]) / step), F.lit(999)).alias("cell")).agg(F.sum("n").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).orderBy("cell").collect()
        seen = base
        for cell in cells:
            seen += cell["n"]
            if seen >= rank:
                low, high = cell["lo"], cell["hi"]
                break


def threshold_at_fpr(df: DataFrame, budget: float) -> float:
    """Lowest threshold whose false positives among human texts keep to the budget: just above the k-th smallest human score."""
    human = df.where("y_true = 0")
    n = human.count()
    if not n:
        raise ValueError("no human texts to fit a threshold to")
    k = min(max(math.ceil((1.0 - budget) * n) - 1, 0), n - 1)
    return math.nextafter(score_at_rank(human, k + 1), math.inf)


def ranked_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, score, n, pos, below): rows of each distinct score, and how many of the group score less.

    Running sums go over about RANGES ranges of near-equal numbers of distinct scores, then within each range, so
    that no task holds all scores of a group.
    """
    counts = cut(value_counts(df.where(F.col("score").isNotNull()), by))
    edges = counts.agg(F.percentile_approx("score", [i / RANGES for i in range(1, RANGES)], 10 * RANGES)).first()[0] or []
    place = F.size(F.filter(F.array(*map(F.lit, sorted(set(edges)))), lambda e: e < F.col("score"))) if edges else F.lit(0)
    ranged = counts.withColumn("_range", place)
    sizes = ranged.groupBy(*by, "_range").agg(F.sum("n").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    within = F.sum("n").over(Window.partitionBy(*by, "_range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1))
    met = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in [*by, "_range"]]
    inner = ranged.withColumn("_within", F.coalesce(within, F.lit(0)))
    return inner.alias("x").join(base.alias("y"), met).select("x.*", (F.col("y._base") + F.col("_within")).alias("below")).drop("_range", "_within")


def auroc(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Area under the ROC curve with averaged ranks of ties; null if a class is missing."""
    by = list(by)
    ranked = ranked_counts(df, by).withColumn("rank", F.col("below") + (F.col("n") + 1) / 2)
    pos, neg = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    return ranked.groupBy(*by).agg(F.try_divide(F.sum(F.col("rank") * F.col("pos")) - pos * (pos + 1) / 2, pos * neg).alias("auroc"))


def calibration_error(df: DataFrame, by: list[str] = (), bins: int = 15) -> DataFrame:
    """Expected calibration error over equal bins, open below but for the first."""
    edges = [i / bins for i in range(bins + 1)]
    bin_no = F.lit(bins - 1)
    for i in range(bins - 2, -1, -1):
        bin_no = F.when(F.col("score") <= edges[i + 1], i).otherwise(bin_no)
    right = ((F.col("score") >= 0.5).cast("int") == F.col("y_true")).cast("double")
    per = df.groupBy(*by, bin_no.alias("bin")).agg(F.count("*").alias("n"), F.avg(right).alias("acc"), F.avg(F.greatest("score", 1 - F.col("score"))).alias("conf"))
    return per.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"))


def condition_cost(df: DataFrame, threshold: float, by: list[str] = ()) -> DataFrame:
    """What human texts score: rate above the threshold, median, nearest-rank p95 and p99, maximum.

    Ranks come from counts of distinct scores, so no buffer holds a group's scores.
    """
    by = list(by)
    human = df.where("y_true = 0")
    ranked = ranked_counts(human, by)
    total = ranked.groupBy(*by).agg(F.sum("n").alias("_total"))
    met = [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in by]
    both = ranked.alias("r").join(total.alias("t"), met) if by else ranked.alias("r").crossJoin(total.alias("t"))  # without groups one row
    both = both.select("r.*", "t._total")
    upto, n = F.col("below") + F.col("n"), F.col("_total")
    at = lambda rank: F.min(F.when(upto >= rank, F.col("score")))
    hit = F.sum(F.when(F.col("score") >= threshold, F.col("n")).otherwise(0))
    return both.groupBy(*by).agg(
        (hit / F.sum("n")).alias("fpr"), F.sum("n").alias("n_human"), ((at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2).alias("median"),
        at(F.ceil(n * 0.95)).alias("p95"), at(F.ceil(n * 0.99)).alias("p99"), F.max("score").alias("maximum"),
    )


def measurable(df: DataFrame, budget: float, by: list[str] = ()) -> DataFrame:
    """Whether there are enough human texts to see the budget (at least 5 expected false positives)."""
    return df.groupBy(*by).agg(F.count_if(F.expr("y_true = 0")).alias("n_human")).withColumn("measurable", F.col("n_human") >= math.ceil(5 / budget))


def group_scores(df: DataFrame) -> DataFrame:
    """Mean score and last label per group. ``df``: (group, pos, y_true, score)."""
    return df.groupBy("group").agg(F.avg("score").alias("score"), F.max_by("y_true", "pos").alias("y_true"))


def polarity(df: DataFrame, margin: float = 0.05) -> DataFrame:
    """Mean scores by class and whether machine texts are above human ones by the margin; null without both classes."""
    ai, human = F.avg(F.when(F.col("y_true") == 1, F.col("score"))), F.avg(F.when(F.col("y_true") == 0, F.col("score")))
    return df.agg(ai.alias("mean_ai"), human.alias("mean_human")).withColumn("holds", F.col("mean_ai") > F.col("mean_human") + margin)


def mcnemar_counts(df: DataFrame, threshold_a: float, threshold_b: float) -> DataFrame:
    """Discordant machine texts of two arms and the continuity-corrected chi-square. ``df``: (y_true, a, b); a miss is ``score <= threshold``."""
    miss_a, miss_b = F.col("a") <= threshold_a, F.col("b") <= threshold_b
    per = df.where("y_true = 1").agg(F.count_if(miss_a & ~miss_b).alias("b"), F.count_if(~miss_a & miss_b).alias("c"))
    n = F.col("b") + F.col("c")
    return per.withColumn("chi2", F.try_divide(F.pow(F.abs(F.col("b") - F.col("c")) - 1, 2), n))


def exact_binomial(b: int, c: int) -> float:
    """Two-sided exact McNemar p-value."""
    n, k = b + c, min(b, c)
    return 1.0 if not n else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)


def mcnemar_values(df: DataFrame, threshold_a: float, threshold_b: float) -> DataFrame:
    """(b, c, chi2, p_chi2, p_exact) of two arms: the p-values of the continuity-corrected statistic and of the exact binomial test."""
    row = mcnemar_counts(df, threshold_a, threshold_b).first()
    p = math.erfc(math.sqrt(row["chi2"] / 2)) if row["chi2"] is not None else 1.0
    return df.sparkSession.createDataFrame([(row["b"], row["c"], row["chi2"], p, exact_binomial(row["b"], row["c"]))], "b long, c long, chi2 double, p_chi2 double, p_exact double")


def chance_margin(n: int, sigmas: float = 4.0) -> float:
    """How far from a half an AUROC of ``n`` samples may be by chance."""
    if n <= 0:
        raise ValueError("needs at least one sample")
    return sigmas / (2 * math.sqrt(n))


def negative_control(df: DataFrame, sigmas: float = 4.0) -> DataFrame:
    """(auroc, n, margin, passed) of scores against arbitrary labels: a pipeline without leaks stays within the margin of a half. ``df``: (y_true, score)."""
    n = df.count()
    margin = chance_margin(n, sigmas)
    return auroc(df).select("auroc", F.lit(n).cast("long").alias("n"), F.lit(margin).alias("margin"), (F.abs(F.col("auroc") - 0.5) <= margin).alias("passed"))


def budget_threshold(df: DataFrame, budget: float) -> float:
    """Highest threshold that lets at most floor(budget * n) human scores through (``score > threshold``)."""
    human = df.where("y_true = 0")
    n = human.count()
    allowed = math.floor(budget * n)
    if allowed >= n:
        raise ValueError("the budget admits every human text")
    return score_at_rank(human, n - allowed)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def token_f1(tokens: DataFrame, ignore: int = -100) -> DataFrame:
    """Per class: f1 and support over (y_true, y_pred) tokens; ignored truth is left out."""
    real = tokens.where(F.col("y_true") != ignore)
    t = real.groupBy(F.col("y_true").alias("cls")).agg(F.count("*").alias("n_true"), F.count_if(F.expr("y_true = y_pred")).alias("tp"))
    p = real.groupBy(F.col("y_pred").alias("cls")).agg(F.count("*").alias("n_pred"))
    both = t.join(p, "cls", "full").fillna(0, ["n_true", "tp", "n_pred"])
    return both.select("cls", f1(F.col("tp"), F.col("n_pred") - F.col("tp"), F.col("n_true") - F.col("tp")).alias("f1"), F.col("n_true").alias("support"))
