"""Crawl plans: the segment list of a crawl, its checks, its fingerprint, and the manifest of what was written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import hashing
from siltstone.sources import lake

FORMATS = ("wet", "warc")


class CrawlError(ValueError):
    """A crawl that can't be planned."""


@dataclass(frozen=True)
class CrawlPlan:
    crawl: str
    fmt: str
    segments: tuple[str, ...]
    partitions: int
    shards: int
    fingerprint: str

    def buckets(self) -> list[list[str]]:
        """The segments in turn over the partitions."""
        return [list(self.segments[k :: self.partitions]) for k in range(self.partitions)]


def segment_index(spark: SparkSession, path: str, limit: int | None = None) -> list[str]:
    """The paths listed in a crawl's index (plain or gzipped, one a line), the first ``limit`` of them; a missing index is an error.

    The list of segments is some ten thousand lines for a whole crawl; ``limit`` is part of the plan, not of the data read.
    """
    try:
        lines = [r[0].strip() for r in spark.read.text(path).collect()]
    except Exception as e:  # noqa: BLE001 - Spark names the missing path in an AnalysisException
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raise CrawlError(f"no segment index at {path}") from e
    return [x for x in lines if x][:limit]


def segment_name(path: Column) -> Column:
    """What names a segment: a local path's last part, any other path as it is."""
    return F.when(path.startswith("/"), F.element_at(F.split(path, "/"), -1)).otherwise(path)


def segment_fingerprint(segments: DataFrame, path: str) -> DataFrame:
    """(fingerprint, n) of a list of segments, whatever its order."""
    return lake.fingerprint(segments.where(F.col(path).isNotNull()).select(segment_name(F.col(path)).alias("_segment")), "_segment")


def plan_crawl(spark: SparkSession, crawl: str, paths: list[str], fmt: str = "wet", partitions: int = 1, shards: int = 1) -> CrawlPlan:
    """The checked plan of a crawl. Wrong formats, no segments, repeated ones and more partitions than segments are errors."""
    faults = [
        (fmt not in FORMATS, f"the format must be one of {FORMATS}, not {fmt!r}"),
        (min(partitions, shards) < 1, "needs at least one partition and one shard"),
        (not paths, f"crawl {crawl!r} has no {fmt} segments"),
        (len(set(paths)) < len(paths), "a segment is listed twice"),
        (partitions > len(paths) > 0, f"{partitions} partitions for {len(paths)} segments"),
    ]
    for wrong, why in faults:
        if wrong:
            raise CrawlError(why)
    print_ = segment_fingerprint(spark.createDataFrame([(p,) for p in paths], "path string"), "path").first()["fingerprint"]
    return CrawlPlan(crawl, fmt, tuple(paths), partitions, shards, print_)


def crawl_manifest(docs: DataFrame, by: str, key: str) -> DataFrame:
    """(by, n_docs, ids_sha256, train, val, test) of written documents; a document's split follows from its group."""
    split = hashing.split_of_group(hashing.group_id(F.col(key)))
    splits = docs.where(F.col(by).isNotNull()).groupBy(by).agg(*(F.count_if(split == s).alias(s) for s in ("train", "val", "test")))
    return lake.manifest(docs, by, key).join(splits, by)
