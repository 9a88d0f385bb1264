"""Windowed metrics and latest corrections; the same functions serve batch and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly(events: DataFrame) -> DataFrame:
    w = F.window("ts", "1 hour")
    return (
        events.groupBy(w.alias("w"), "event_type")
        .agg(F.count("*").alias("n"), (F.floor(F.sum("value") * 100 + 0.5) / 100).alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return (
        events.groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("n"))
        .select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")
    )


def stream(spark: SparkSession, folder: str, schema, late: str = "1 hour") -> DataFrame:
    """Files as they arrive; events later than the watermark are left out, and repeats of an event within it."""
    read = spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    return read.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def json_log(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """An append-only JSON log as a stream; lines that do not parse give nulls."""
    return spark.readStream.schema(schema).json(folder)


def uploads(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Uploaded files as they arrive, with their type by suffix."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(folder)
    return found.withColumn("file_type", file_type(F.col("path")))


def file_type(path):
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when(suffix == "pdf", "PDF")
        .when(suffix.isin("png", "jpg", "jpeg", "webp"), "IMAGE")
        .when(suffix.isin("xlsx", "xls", "xlsm"), "XLSX")
        .when(suffix == "csv", "CSV")
        .when(suffix.isin("txt", "md"), "TXT")
        .otherwise("Unsupported")
    )
