"""Files and job events as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.operators.batch import counterpart_name
from planloom.sources.files import BINARY_SCHEMA, route_by_content, route_by_suffix


#: Longer than any file has existed: the file source must not leave files out for their age.
ANY_AGE = "1000000d"


def stream_intake(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """New files of a folder, each routed and named once, however old they are.

    The file source keeps the paths it has read in its checkpoint, so a path
    comes once; nothing is decided by modification times, which copied archives
    keep from before.
    """
    files = (spark.readStream.format("binaryFile").schema(BINARY_SCHEMA)
             .option("maxFilesPerTrigger", max_files).option("maxFileAge", ANY_AGE).load(folder))
    twin = counterpart_name(F.regexp_extract("path", r"([^/]+)$", 1))
    route = F.coalesce(route_by_suffix(F.col("path")), route_by_content(F.col("content")))
    return (files.select("path", "modificationTime", route.alias("route"), twin["name"].alias("mirrored_name"),
                         twin["naming_warning"].alias("naming_warning"))
            .withColumn("problem", F.when(F.col("route").isNull(), "unrecognised format")))


def status_counts(events: DataFrame, delay: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Events per hour and status, for batch and streaming input alike."""
    source = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        source = source.withWatermark("ts", delay)
    return (source.groupBy(F.window("ts", window).alias("w"), "status").agg(F.count("*").alias("n"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "status", "n"))


def running_status(events: DataFrame) -> DataFrame:
    """Running number of events per status."""
    return events.groupBy("status").agg(F.count("*").alias("n"))


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet"):
    """Process everything that is there, then stop (restartable)."""
    query = (df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint)
             .outputMode(mode).trigger(availableNow=True).start())
    query.awaitTermination()
    return query
