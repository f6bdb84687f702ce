"""Streaming views of audit and tool rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blocks_per_window(events: DataFrame, late: str = "10 minutes", size: str = "15 minutes") -> DataFrame:
    """Events per kind in tumbling windows; rows later than the watermark are dropped."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = rows.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Activity of each user in sessions that end after a gap."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("session_window.start").alias("start"), "n")


def tool_vocabulary(tools: DataFrame) -> DataFrame:
    """Each (workspace, word) once: the growing vocabulary of declared tools."""
    parts = F.array_union(F.array("tool"), F.split("tool", r"[_.\-]+"))
    return tools.select("workspace", F.explode(parts).alias("word")).where("word <> ''").dropDuplicates(["workspace", "word"])
