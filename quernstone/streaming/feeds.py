"""Feeds: incremental ingestion past a frontier, and windows with late data."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.rows import first_per_key, insert_absent
from quernstone.session import ensure_checkpoint_dir
from quernstone.sources import storage


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events as a file stream with event time in UTC."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    files = {"pathGlobFilter": name} if name.endswith(".parquet") else {}
    return spark.readStream.schema(schema).options(**files).parquet(folder if files else path).withColumn("ts", F.col("ts").cast("timestamp"))


def ingest(stream: DataFrame, target: str, key: str, time: str, source: str, checkpoint: str) -> None:
    """Appends records past each source's frontier whose key is not stored yet; runs over what is there and ends.

    A record not newer than the greatest time stored for its source is never taken, as is a
    record whose key exists; repeated records in a batch count once.
    """

    frontiers = f"{checkpoint}-frontiers"  # one small table for each batch: the greatest time of every source

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = first_per_key(batch, [key], [F.asc(time), F.asc(key)])
        before = [int(x) for x in storage.children(spark, frontiers) if x.isdigit() and int(x) < n]
        known = spark.read.parquet(f"{frontiers}/{max(before)}") if before else None
        if known is None and storage.exists(spark, target):  # rows that are there without a frontier
            known = spark.read.parquet(target).groupBy(source).agg(F.max(time).alias("__frontier"))
        if known is not None:
            new = new.join(known, source, "left").where(F.col("__frontier").isNull() | (F.col(time) > F.col("__frontier"))).drop("__frontier")
            if storage.exists(spark, target):  # a replayed batch finds its own rows here
                new = new.join(spark.read.parquet(target).select(key), key, "left_anti")
        new.write.mode("append").parquet(target)
        reached = batch.groupBy(source).agg(F.max(time).alias("__frontier"))
        both = reached if known is None else reached.unionByName(known)
        both.groupBy(source).agg(F.max("__frontier").alias("__frontier")).write.mode("overwrite").parquet(f"{frontiers}/{n}")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows and sums of events by window and type; a watermark bounds the state."""
    base = events.withWatermark("ts", late) if events.isStreaming else events
    return base.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    base = events.withWatermark("ts", late) if events.isStreaming else events
    return base.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "user_id", "n")


def deduplicated(stream: DataFrame, key: str, time: str, late: str = "2 hours") -> DataFrame:
    """The first record of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there into the shared folder and returns its result; append mode needs a watermark."""
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(f"{base}/out").awaitTermination()
    else:  # each batch's result replaces the one before
        writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/out")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


__all__ = ["deduplicated", "event_stream", "ingest", "insert_absent", "run_to_table", "sessions", "windowed_counts"]
