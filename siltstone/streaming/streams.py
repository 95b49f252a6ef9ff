"""Structured Streaming: the batch operators' incremental forms."""

from __future__ import annotations

import os
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.operators.evaluation import TRANSITIONS
from siltstone.runtime import shared_dir, table


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A table of the data folder as a stream of its files, all new ones in a micro-batch or ``files_per_batch``."""
    schema = table(spark, folder, name).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    path = f"{folder}/{name}.parquet"
    if os.path.isdir(path.removeprefix("file://")):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything a stream has now, through a real streaming query with a checkpoint, as a table in the shared folder.

    Batches are written by ``foreachBatch``; in complete mode the last batch holds, in append and update mode all do. A stream without data gives an empty table.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = stream.schema

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/out")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    out = spark.read.schema(schema.add("batch", "long")).parquet(f"{base}/out")
    if mode == "complete":
        last = out.agg(F.max("batch")).first()[0]
        out = out.where(F.col("batch") == F.lit(last))
    return out.drop("batch")


def timed(stream: DataFrame, column: str = "ts", delay: str = "1 hour") -> DataFrame:
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def tumbling_counts(stream: DataFrame, keys: list[str], size: str = "1 day", slide: str | None = None) -> DataFrame:
    """(start, keys, n, total) per tumbling or sliding window of ``ts``, with the sum of ``value``."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return stream.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes") -> DataFrame:
    """(key, start, n) of sessions with no pause of ``gap``."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def first_of_hash(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Stateful exact deduplication: the first row of each key, whenever another arrives; state is one entry a key."""
    return stream.dropDuplicates(keys)


def first_of_hash_lately(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark's delay: state is bounded, and a key that comes back later counts again."""
    return stream.dropDuplicatesWithinWatermark(keys)


def feedback_machine(stream: DataFrame) -> DataFrame:
    """(item, state, n_illegal) updated per micro-batch; events (item, pos, to) are folded in order of pos."""
    legal = set(TRANSITIONS)

    def fold(key, frames, state: GroupState):
        now, bad = state.get if state.exists else ("submitted", 0)
        events = pd.concat(list(frames)).sort_values("pos")
        for to in events["to"]:
            if (now, to) in legal:
                now = to
            else:
                bad += 1
        state.update((now, bad))
        yield pd.DataFrame({"item": [key[0]], "state": [now], "n_illegal": [bad]})

    return stream.groupBy("item").applyInPandasWithState(fold, "item long, state string, n_illegal long", "state string, bad long", "update", GroupStateTimeout.NoTimeout)
