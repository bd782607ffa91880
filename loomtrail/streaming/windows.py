"""Streams of events: windowed counts with a watermark, and sessions by a gap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of events as a stream; ts becomes a zoned timestamp, as watermarks need."""
    schema = spark.read.parquet(folder).schema
    at, _, name = folder.rstrip("/").rpartition("/")
    one = name.endswith(".parquet") and not spark.read.parquet(folder).select("_metadata.file_path").where(F.col("file_path").endswith("/" + name)).isEmpty()
    reader = spark.readStream.schema(schema)
    source = reader.option("pathGlobFilter", name).parquet(at) if one else reader.parquet(folder)  # a stream reads folders
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
