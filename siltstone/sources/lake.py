"""Parquet sinks, manifests and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import hashlib

import pyarrow as pa

from siltstone.functions.hashing import hex_number

ROWS_PER_FILE = 1_000_000


def write_partitioned(df: DataFrame, path: str, *by: str, mode: str = "errorifexists") -> DataFrame:
    """Zstd Parquet under ``by`` folders (the columns live in the paths only); returns rows per partition, counted from what was written."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"))
    files = sizes.select(*by, F.ceil(F.col("_n") / ROWS_PER_FILE).cast("long").alias("_files"))
    content = F.xxhash64(*(F.col(f.name) for f in df.schema if f.dataType.typeName() != "map"))
    met = [F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by]
    spread = df.withColumn("_content", content).alias("d").join(files.alias("s"), met).select("d.*", F.pmod(F.col("_content"), F.col("_files")).alias("_file"))
    spread.repartition(*by, "_file").drop("_file", "_content").write.mode(mode).option("compression", "zstd").partitionBy(*by).parquet(path)
    return df.sparkSession.read.parquet(path).groupBy(*by).agg(F.count("*").alias("n"))


def write_parts(df: DataFrame, path: str, part: str) -> DataFrame:
    """Adds ``df`` to a tree of its splits, under ``part`` in each (several runs add up, one part written twice is an error); returns rows per split.

    The split stays a column of the files as well.
    """
    df.withColumn("_split", F.col("split")).withColumn("_part", F.lit(part)).write.mode("append").option("compression", "zstd").partitionBy("_split", "_part").parquet(_unwritten(df, path, part))
    return df.sparkSession.read.parquet(path).where(F.col("_part") == part).groupBy("split").agg(F.count("*").alias("n"))


def _unwritten(df: DataFrame, path: str, part: str) -> str:
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path}/_split=*/_part={part}")
    if pattern.getFileSystem(conf).globStatus(pattern):
        raise ValueError(f"part {part!r} is there already under {path}")
    return path


def shard_of(sha: Column, shards: int) -> Column:
    return F.pmod(hex_number(sha, 8), F.lit(shards)).cast("int")


def write_shards(df: DataFrame, path: str, sha: str, key: str, shards: int, mode: str = "errorifexists") -> None:
    """Content-addressed shards: a row's shard follows from its hash, rows are sorted by key inside it."""
    out = df.withColumn("shard", shard_of(F.col(sha), shards))
    out.repartition(shards, "shard").sortWithinPartitions("shard", key).write.mode(mode).option("compression", "zstd").partitionBy("shard").parquet(path)


def metadata_only(df: DataFrame, allowed: Column) -> DataFrame:
    """Rows that may not be passed on, without their text; a null permission is none."""
    return df.where(~F.coalesce(allowed, F.lit(False))).drop("text")


def write_metadata_only(df: DataFrame, allowed: Column, path: str, mode: str = "errorifexists") -> None:
    """``metadata_only`` in a tree of its own."""
    metadata_only(df, allowed).write.mode(mode).option("compression", "zstd").parquet(path)


def redistributable_view(df: DataFrame, allowed: Column) -> DataFrame:
    return df.withColumn("text", F.when(F.coalesce(allowed, F.lit(False)), F.col("text")))


def _digest_of_sorted(rows: DataFrame, by: list[str], line: str, end: str, every: bool) -> DataFrame:
    """(by, n, sha): sha-256 over the sorted lines of each group, with ``end`` between them or, if ``every``, after each.

    A group's lines pass through its task in order (Spark's sort spills), and only the digest's state is held. Null lines are left out; without
    groups and rows there is one row, the digest of nothing.
    """
    key = F.to_json(F.struct(*by)) if by else F.lit("")
    lines = rows.where(F.col(line).isNotNull()).select(key.alias("_key"), F.col(line).cast("string").alias("_text"))
    lines = (lines.repartition("_key") if by else lines.repartition(1)).sortWithinPartitions("_key", "_text")

    def digest(batches):
        now, n, sha = None if by else "", 0, hashlib.sha256()
        out = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([n], pa.int64()), pa.array([sha.hexdigest()])], ["_key", "n", "sha"])
        for batch in batches:
            for k, text in zip(*(c.to_pylist() for c in batch.columns)):
                if k != now:
                    if now is not None:
                        yield out()
                    now, n, sha = k, 0, hashlib.sha256()
                sha.update(((end if n and not every else "") + text + (end if every else "")).encode())
                n += 1
        if now is not None:
            yield out()

    digests = lines.mapInArrow(digest, "_key string, n long, sha string")
    if not by:
        return digests.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("sha"), F.lit(hashlib.sha256().hexdigest())).alias("sha"))  # one row, or none of an empty frame
    names = rows.groupBy(*by).agg(F.count("*").alias("_c")).select(*by, key.alias("_key"))
    return names.join(digests, "_key").drop("_key")


def manifest(df: DataFrame, group: str, key: str) -> DataFrame:
    """(group, n_docs, ids_sha256): digest over the sorted ids joined by line feeds; null groups are left out."""
    ids = df.where(F.col(group).isNotNull()).select(group, F.col(key).cast("string").alias("_line"))
    return _digest_of_sorted(ids, [group], "_line", "\n", False).select(group, F.col("n").alias("n_docs"), F.col("sha").alias("ids_sha256"))


def fingerprint(lines: DataFrame, line: str) -> DataFrame:
    """One row (fingerprint, n): the first 16 digits of the digest over all sorted lines, each with a line feed.

    The digest is one sequential sha-256 by definition. For corpora whose identities don't fit a task,
    ``tree_fingerprint`` is the one to use.
    """
    return _digest_of_sorted(lines, [], line, "\n", True).select(F.substring("sha", 1, 16).alias("fingerprint"), "n")


def tree_fingerprint(lines: DataFrame, line: str, buckets: int = 4096) -> DataFrame:
    """(fingerprint, n) independent of order: digests of 4 096 hash buckets of lines, then of those digests in order."""
    own = lines.select(F.col(line).alias("_line"), F.pmod(F.xxhash64(line), F.lit(buckets)).alias("bucket"))
    per = _digest_of_sorted(own, ["bucket"], "_line", "\n", True)
    top = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "sha"))), lambda x: x["sha"]), "\n"), 256)
    return per.agg(F.substring(top, 1, 16).alias("fingerprint"), F.sum("n").alias("n"))


def pool_audit(spark, path: str, required: list[str], refused: list[str] = ("generator", "label", "sample_id")) -> DataFrame:
    """(file, n) per Parquet file of a pool, in order; a pool without the required columns or with a refused one is an error.

    Row counts come from the footers (no column is read).
    """
    df = spark.read.parquet(path)
    missing, marks = sorted(set(required) - set(df.columns)), sorted(set(refused) & set(df.columns))
    if missing or marks:
        raise ValueError(f"missing columns {missing}, refused columns {marks}")
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n")).orderBy("file")
