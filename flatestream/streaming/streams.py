"""Structured Streaming: archives as they arrive, telemetry windows, sessions and first arrivals with late data."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving_archives(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Streaming file_id, content of the files that come into a folder. A batch has `files_per_batch` at most: Spark's back-pressure."""
    layout = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(layout).option("maxFilesPerTrigger", files_per_batch).load(path)
    return rows.select(F.col("path").alias("file_id"), "content")


def telemetry_windows(samples: DataFrame, width: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Samples and the greatest value by event-time window and type. In a stream, samples later than `late` are dropped."""
    if samples.isStreaming:
        samples = samples.withWatermark("ts", late)
    return samples.groupBy(F.window("ts", width, slide), "event_type").agg(F.count(F.lit(1)).alias("samples"), F.max("value").alias("most"))


def sessions(samples: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Samples of each user's sessions, which end after `gap` without one."""
    if samples.isStreaming:
        samples = samples.withWatermark("ts", late)
    return samples.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("samples"))


def first_arrivals(samples: DataFrame, key: str, late: str = "10 minutes") -> DataFrame:
    """One row for each key; repeats within the watermark are dropped, and rows later than it."""
    return samples.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def finished(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what there is now and read back the rows it appended. `folder` is shared by all executors."""
    at = f"{folder}/{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{at}/state").option("path", f"{at}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/rows")


def telemetry_windows_stream(spark: SparkSession, path: str, width: str, folder: str) -> DataFrame:
    """telemetry_windows as a stream over the files of a table, run to its end.

    Each batch appends the windows it changed to files in `folder`, that all executors share; a window's row is that of its last batch. So neither
    the driver nor memory holds the windows, and those that the watermark hasn't closed are there too.
    """
    at = f"{folder}/{uuid.uuid4().hex}"
    layout = spark.read.parquet(path).schema
    base, _, name = path.rpartition("/")
    rows = spark.readStream.schema(layout).option("recursiveFileLookup", "true").parquet(f"{base}/{name.replace('.parquet', '.parquet*')}")
    rows = telemetry_windows(rows.withColumn("ts", F.col("ts").cast("timestamp")), width)

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={number}")  # a repeated batch replaces its own rows

    query = rows.writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").foreachBatch(append).trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema(rows.schema.add("batch", "long")).parquet(f"{at}/rows")
    last = found.groupBy("window", "event_type").agg(F.max_by(F.struct("samples", "most"), "batch").alias("x"))
    ends = F.struct(F.col("window.start").cast("timestamp_ntz").alias("start"), F.col("window.end").cast("timestamp_ntz").alias("end"))
    return last.select(ends.alias("window"), "event_type", "x.samples", "x.most")
