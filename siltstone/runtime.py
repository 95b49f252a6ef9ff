"""Session defaults, table access and lineage cuts shared by every plan."""

from __future__ import annotations

import atexit
import os
import sys
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}


def build_session(app: str = "siltstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans count on (UTC, AQE with skew splitting, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.executorEnv.OMP_NUM_THREADS": "1",
    } | conf
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it is a scan of too few splits (one small file, say) for costly per-row work.

    Tables of many files or row groups are left as they are: no shuffle where the scan is parallel already.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session; on a local master without one, a folder of our own.

    On a cluster a folder of one machine would give each executor another table, so the setting is required there.
    """
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
    if "dir" not in _OWN_DIR:
        _OWN_DIR["dir"] = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(_remove, _OWN_DIR["dir"][7:])
    return _OWN_DIR["dir"]


def _remove(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def cut(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The result survives lost executors, is computed once however often it is used, and gives
    Catalyst true sizes. It is deleted at the end of the enclosing ``scratch``, else when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siltstone-{uuid.uuid4().hex}"
    _doomed(spark, path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SCRATCH: list[list[str]] = []


def _hadoop_path(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _doomed(spark: SparkSession, path: str) -> None:
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    else:
        place, fs = _hadoop_path(spark, path)
        fs.mkdirs(place.getParent())
        fs.deleteOnExit(place)


@contextmanager
def scratch(spark: SparkSession):
    """Tables cut inside are deleted at the end; results must be written or collected before."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            place, fs = _hadoop_path(spark, path)
            fs.delete(place, True)


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` with ``name``, the place (from 0) of each row in the order: ranks within ranges of it plus the rows before the range, so no task holds all.

    Rows equal in the order are numbered in no particular order.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(width, *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # a row per range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range").withColumn(name, F.col("_before") + within).drop("_range", "_before")


def shuffle_width(spark: SparkSession, rows: int = 0, per_task: int = 500_000) -> int:
    """Tasks for a stage whose input rows were counted: the session's width, or more for more rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))
