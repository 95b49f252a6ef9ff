"""Confident-error scans, ledger, cluster summaries and selection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.runtime import cut

NOISE = -1


def confident_errors(scored: DataFrame, ledger: DataFrame, threshold: float, min_confidence: float) -> DataFrame:
    """Human texts scored at ``min_confidence`` or more, not mined before. ``scored``: (doc_id, score, ...), ``ledger``: (doc_id)."""
    if min_confidence < threshold:
        raise ValueError("min_confidence is below the operating threshold")
    return scored.where(F.col("score") >= min_confidence).join(ledger.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("confidence", F.col("score")).withColumn("failure_type", F.lit("human_false_positive"))


def missed_machine(scored: DataFrame, most: float = 0.10) -> DataFrame:
    return scored.where(F.col("score") <= most).withColumn("confidence", 1 - F.col("score")).withColumn("failure_type", F.lit("ai_false_negative"))


def scan_report(scored: DataFrame, ledger: DataFrame, threshold: float, min_confidence: float) -> DataFrame:
    """(scanned, errors, error_rate, mined, already_mined) in one pass."""
    known = ledger.select("doc_id").distinct().withColumn("known", F.lit(True))
    hit = F.col("score") >= min_confidence
    return scored.join(known, "doc_id", "left").agg(
        F.count("*").alias("scanned"), F.count_if(F.col("score") >= threshold).alias("errors"), F.avg((F.col("score") >= threshold).cast("double")).alias("error_rate"), F.count_if(hit & F.col("known").isNull()).alias("mined"), F.count_if(hit & F.col("known")).alias("already_mined")
    )


def with_texts(failures: DataFrame, pool: DataFrame, key: str) -> DataFrame:
    """``failures`` with the columns of the pool they were found in; a failure without a text there is left out."""
    return failures.join(pool, key)


def cluster_summary(failures: DataFrame, exemplars: int = 5) -> DataFrame:
    """(cluster, size, share, mean_confidence, exemplar_ids) of clusters other than noise; failures (doc_id, cluster, confidence)."""
    own = failures.where(F.col("cluster") != NOISE)
    best = own.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("confidence"), "doc_id"))).where(F.col("r") <= exemplars)
    top = best.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "doc_id"))), lambda x: x["doc_id"]).alias("exemplar_ids"))
    per = own.groupBy("cluster").agg(F.count("*").alias("size"), F.avg("confidence").alias("mean_confidence"))
    total = F.sum("size").over(Window.partitionBy(F.lit(1)))
    return per.withColumn("share", F.col("size") / total).join(top, "cluster")


def top_values(failures: DataFrame, column: str, n: int = 3) -> DataFrame:
    """(cluster, value, n, rank): most frequent values per cluster, ties by first occurrence (pos)."""
    counts = failures.where(F.col("cluster") != NOISE).groupBy("cluster", F.coalesce(column, F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"), F.min("pos").alias("p"))
    w = Window.partitionBy("cluster").orderBy(F.desc("n"), "p")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("p")


def failure_types(failures: DataFrame) -> DataFrame:
    """(cluster, failure_type, n) of clusters other than noise."""
    return failures.where(F.col("cluster") != NOISE).groupBy("cluster", "failure_type").agg(F.count("*").alias("n"))


def cluster_labels(failures: DataFrame, columns: list[str]) -> DataFrame:
    """(cluster, label): a cluster's most frequent value of each column, joined; missing values are unknown."""
    tops = [top_values(failures, c, 1).select("cluster", F.col("value").alias(c)) for c in columns]
    out = tops[0]
    for more in tops[1:]:
        out = out.join(more, "cluster")
    return out.select("cluster", F.concat_ws(" / ", *columns).alias("label"))


def quality_warnings(summary: DataFrame, max_share: float = 0.5) -> DataFrame:
    """Clusters that hold too large a share of all failures."""
    return summary.where(F.col("share") > max_share).select("cluster", "share", F.lit("probably several modes merged").alias("warning"))


def atlas_warnings(summary: DataFrame, labels: DataFrame, silhouette: float | None, embedder: str, min_silhouette: float = 0.4, max_share: float = 0.5) -> DataFrame:
    """(warning, detail): poorly_separated, merged_modes for the largest cluster, surface_embedder, split_mode for each label several clusters share."""
    spark = summary.sparkSession
    flat = []
    if silhouette is not None and silhouette == silhouette and silhouette < min_silhouette:
        flat.append(("poorly_separated", f"{silhouette:.3f}"))
    if embedder == "hashing_v1":
        flat.append(("surface_embedder", embedder))
    largest = summary.orderBy(F.desc("size"), "cluster").limit(1).where(F.col("share") > max_share)
    shared = labels.groupBy("label").agg(F.count("*").alias("n")).where("n > 1")
    return spark.createDataFrame(flat, "warning string, detail string").unionByName(largest.select(F.lit("merged_modes").alias("warning"), F.col("cluster").cast("string").alias("detail"))).unionByName(shared.select(F.lit("split_mode").alias("warning"), F.col("label").alias("detail")))


def silhouette(vectors: DataFrame, block: int = 4096) -> DataFrame:
    """(silhouette, n) over all rows against all rows; Euclidean, singletons skipped, null below two clusters, NaN if a point's distances are all 0.

    Every pair of blocks of about ``block`` rows is one group; it gives each of its points the sum and number of its
    distances per cluster. ``vectors``: (id, cluster, v array<double>), ids are unique.
    """
    s = cut(vectors.where((F.col("cluster") != NOISE) & F.col("v").isNotNull()).select("id", "cluster", "v"))
    blocks = max(4, -(-s.count() // block))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("z")
    paired = s.withColumn("own", own).select("*", other).select(F.least("own", "z").alias("i"), F.greatest("own", "z").alias("j"), "own", "id", "cluster", "v")
    kind = dict(s.dtypes)
    sums = paired.groupBy("i", "j").applyInArrow(_distance_sums, f"id {kind['id']}, own {kind['cluster']}, other {kind['cluster']}, d double, n long")
    per = sums.groupBy("id", "own", "other").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    same = F.col("own") == F.col("other")
    mean = per.groupBy("id", "own").agg(F.max(F.when(same & (F.col("n") > 1), F.try_divide("d", F.col("n") - 1))).alias("a"), F.min(F.when(~same, F.col("d") / F.col("n"))).alias("b"))
    ok = mean.where("a is not null and b is not null")
    score = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(float("nan")))
    return ok.agg(F.avg(score).alias("silhouette"), F.count("*").alias("n"))


def _distance_sums(pair: pa.Table) -> pa.Table:
    """Sums and numbers of distances of each point to each cluster of the other block (of its own, itself at 0, if both are one)."""
    i, j = pair["i"][0].as_py(), pair["j"][0].as_py()
    sides = [pair.filter(pc.equal(pair["own"], k)).combine_chunks() for k in ([i] if i == j else [i, j])]
    if not all(len(t) for t in sides):
        sides = []
    out = [pa.table({"id": pair["id"][:0], "own": pair["cluster"][:0], "other": pair["cluster"][:0], "d": pa.array([], pa.float64()), "n": pa.array([], pa.int64())})]
    for x, y in [(t, sides[1 - k] if len(sides) > 1 else t) for k, t in enumerate(sides)]:
        v, w = (np.asarray(pc.list_flatten(t["v"])).reshape(len(t), -1) for t in (x, y))
        labels, code = np.unique(np.asarray(y["cluster"]), return_inverse=True)
        member = np.eye(len(labels))[code]
        step = max(1, 4_000_000 // w.size)
        d = np.concatenate([np.sqrt(np.einsum("abc,abc->ab", q, q)) @ member for q in (v[a : a + step, None, :] - w[None] for a in range(0, len(v), step))])
        rows = np.repeat(np.arange(len(v)), len(labels))
        took = x.take(pa.array(rows))
        out.append(pa.table({"id": took["id"], "own": took["cluster"], "other": pa.array(np.tile(labels, len(v)), took["cluster"].type), "d": d.ravel(), "n": np.tile(member.sum(axis=0).astype(np.int64), len(v))}))
    return pa.concat_tables(out)


def kmeans(vectors: DataFrame, k: int, seed: int = 7, iterations: int = 100) -> DataFrame:
    """``vectors`` with ``cluster``, by Spark's distributed k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    features = vectors.withColumn("_f", array_to_vector(F.col("v").cast("array<double>")))
    return KMeans(k=k, seed=seed, maxIter=iterations, featuresCol="_f", predictionCol="cluster").fit(features).transform(features).drop("_f")
