"""Paired bootstrap over rows that stay distributed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.runtime import cut, shuffle_width


def weights(doc_id, resamples: int) -> np.ndarray:
    """Poisson(1) weight of a row in each resample, seeded by its id, and 1 for the rows as they are."""
    return np.append(np.random.default_rng(xxhash.xxh3_64_intdigest(str(doc_id))).poisson(1.0, resamples), 1).astype(float)


def paired_bootstrap(df: DataFrame, resamples: int = 10_000, level: float = 0.95) -> DataFrame:
    """(difference, low, high, resamples): AUROC of b minus a with a percentile interval. ``df``: (doc_id, y_true, a, b).

    Each row gets a Poisson(1) weight per resample (the bootstrap of very large samples), the same in both arms. Every task
    has a range of the sorted scores and gives what it adds to each resample's area, which is exact: only equal scores
    are tied, and a score that several tasks share is put together afterwards. Resamples of one class have no area and don't count.
    """

    def segments(rows):
        def segment(arm, lo, hi, p, n, s):
            return pa.RecordBatch.from_pydict({"arm": pa.array([arm], pa.int32()), "lo": [lo], "hi": [hi], "p": [p], "n": [n], "s": [s]})

        def ties():
            arm = score = w = None
            for batch in rows:
                for k, label, x, z in zip(*(c.to_pylist() for c in batch.columns)):
                    if (x, z) != (arm, score):
                        if w is not None:
                            yield arm, score, *w
                        arm, score, w = x, z, np.zeros((2, resamples + 1))
                    w[0 if label == 1 else 1] += weights(k, resamples)
            if w is not None:
                yield arm, score, *w

        def flush(arm, inner, last):
            if inner:
                yield segment(arm, *inner)
            if last:
                yield segment(arm, last[0], last[0], last[1], last[2], last[1] * last[2] / 2)

        at = inner = last = None
        for arm, score, p, n in ties():
            if arm != at:
                yield from flush(at, inner, last)
                at, inner, last = arm, None, None
                yield segment(arm, score, score, p, n, p * n / 2)
                continue
            if last:
                z, lp, ln = last
                lo, _, ip, i_n, s = inner or (z, z, 0.0, 0.0, 0.0)
                inner = (lo, z, ip + lp, i_n + ln, s + lp * (i_n + ln / 2))
            last = (score, p, n)
        yield from flush(at, inner, last)

    rows = cut(df.select("doc_id", "y_true", F.explode(F.array(*(F.struct(F.lit(i).alias("arm"), F.col(c).cast("double").alias("score")) for i, c in enumerate("ab")))).alias("x")).select("doc_id", "y_true", "x.*"))
    width = shuffle_width(df.sparkSession, rows.count(), 100_000)
    parts = rows.repartitionByRange(width, "arm", "score", "doc_id").select("doc_id", "y_true", "arm", "score").sortWithinPartitions("arm", "score")
    found = cut(parts.mapInArrow(segments, "arm int, lo double, hi double, p array<double>, n array<double>, s array<double>"))
    long = found.select("arm", "lo", "hi", F.posexplode(F.arrays_zip("p", "n", "s")).alias("r", "x")).select("arm", "lo", "hi", "r", "x.*")
    cells = long.groupBy("arm", "r", "lo", "hi").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    own = F.when(F.col("lo") == F.col("hi"), F.col("p") * F.col("n") / 2).otherwise(F.col("s"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy("arm", "r").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    auc = cells.withColumn("below", below).groupBy("arm", "r").agg(F.try_divide(F.sum(F.col("p") * F.col("below") + own), F.sum("p") * F.sum("n")).alias("auc"))
    diff = auc.groupBy("r").agg((F.max(F.when(F.col("arm") == 1, F.col("auc"))) - F.max(F.when(F.col("arm") == 0, F.col("auc")))).alias("d"))
    tail = (1 - level) / 2
    draws = F.when(F.col("r") < resamples, F.col("d"))
    return diff.agg(F.max(F.when(F.col("r") == resamples, F.col("d"))).alias("difference"), F.percentile(draws, tail).alias("low"), F.percentile(draws, 1 - tail).alias("high"), F.count(draws).alias("resamples"))
