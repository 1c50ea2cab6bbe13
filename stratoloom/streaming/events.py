"""Streams of events as counts: the tables above kept up to date as batches arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def read_events(spark: SparkSession, folder: str, pattern: str = "events*.parquet") -> DataFrame:
    """A stream of the event files that appear in a folder."""
    return spark.readStream.schema(SCHEMA).option("pathGlobFilter", pattern).parquet(folder)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, cell, feature, x): events of each user and type in tumbling windows; rows later than ``late`` are dropped."""
    found = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "user_id", "event_type").agg(F.count("*").cast("double").alias("x"))
    return found.select(F.col("w.start").alias("start"), F.col("user_id").alias("cell"), F.col("event_type").alias("feature"), "x")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(start, end, cell, n): runs of a user's events without a gap."""
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.col("user_id").alias("cell"), "n")
