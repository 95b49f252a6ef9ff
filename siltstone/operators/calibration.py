"""Temperature and abstention band, fitted by a few aggregation passes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.metrics import score_at_rank, threshold_at_fpr


def fit_temperature(df: DataFrame, low: float = 0.05, high: float = 10.0, grid: int = 25, passes: int = 5) -> tuple[float, bool]:
    """(temperature, at the edge of the range) of least negative log likelihood. ``df``: (y_true 0/1, human_logit, ai_logit).

    The loss has one minimum in log t, so each pass evaluates a grid of temperatures in one aggregation and the next
    pass refines between the neighbours of the best: five passes instead of one job per search step.
    """
    margin = F.when(F.col("y_true") == 1, F.col("ai_logit") - F.col("human_logit")).otherwise(F.col("human_logit") - F.col("ai_logit"))
    rows = df.where("y_true is not null and human_logit is not null and ai_logit is not null").select(margin.alias("m"))
    a, b = math.log(low), math.log(high)
    for _ in range(passes):
        points = [a + (b - a) * i / (grid - 1) for i in range(grid)]
        # log(1 + e^-x) without overflow
        loss = lambda x: F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
        losses = rows.agg(*(F.avg(loss(F.col("m") / math.exp(p))).alias(f"p{i}") for i, p in enumerate(points))).first()
        if losses[0] is None:
            raise ValueError("no rows to fit a temperature to")
        best = min(range(grid), key=lambda i: losses[i])
        a, b = points[max(best - 1, 0)], points[min(best + 1, grid - 1)]
    t = math.exp(points[best])
    return t, t <= low * 1.02 or t >= high * 0.98


def abstention_band(df: DataFrame, budget: float, fraction: float = 0.02) -> tuple[float, float]:
    """(low, high) around the threshold of the budget that covers ``fraction`` of the rows. ``df``: (y_true, score)."""
    if not 0.0 <= fraction < 1.0:
        raise ValueError("fraction must be in [0, 1)")
    threshold = threshold_at_fpr(df, budget)
    if fraction == 0.0:
        return threshold, threshold
    counts = df.agg(F.count("score").alias("n"), F.count_if(F.col("score") < threshold).alias("below")).first()
    half = max(int(counts["n"] * fraction / 2), 1)
    low = score_at_rank(df, max(counts["below"] - half, 0) + 1)
    high = score_at_rank(df, min(counts["below"] + half, counts["n"] - 1) + 1)
    return min(low, threshold), max(high, threshold)
