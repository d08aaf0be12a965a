"""Streams of JSON lines with event time: counts by kind in tumbling windows and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "kind STRING, src STRING, dst STRING, ts TIMESTAMP"


def read_lines(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """New files of a folder as they come; comments and malformed lines are passed over."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    parsed = lines.where("not startswith(trim(value), '#')").select(F.from_json("value", EVENT).alias("e"))
    return parsed.where("e.ts is not null").select("e.*")


def counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(started, kind, n) by tumbling window; rows later than `late` behind the stream are dropped with their window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), "kind", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(src, started, ended, n): bursts of calls of a workflow with no longer pause than gap."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "src").agg(F.count("*").alias("n"))
    return grouped.select("src", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")
