"""Ledger events as a stream: exactly-once append, replay, windowed counts, latest state per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import shared_folder


def follow(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """A stream over the files of an event table, in micro-batches of bounded size."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # a stream takes folders and patterns, a table may be one file
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def append(events: DataFrame, table: str, checkpoint: str) -> None:
    """Appends everything available now to a ledger table; a rerun with the same checkpoint adds nothing."""
    events.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", table).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def windowed(events: DataFrame, at: str, by: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts per tumbling window and key; rows later than the watermark are dropped."""
    stamped = events.withColumn("_at", F.col(at).cast("timestamp"))
    return stamped.withWatermark("_at", late).groupBy(F.window("_at", width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def replayed(spark: SparkSession, path: str) -> DataFrame:
    """The ledger as a stream would have written it: source → append sink → batch read."""
    table, checkpoint = shared_folder(spark, "ledger"), shared_folder(spark, "offsets")
    append(follow(spark, path), table, checkpoint)
    append(follow(spark, path), table, checkpoint)  # nothing new: exactly once
    return spark.read.parquet(table)
