"""Rows with a time: frames by time, parts of dates, values of small JSON texts, distinct counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recent(events: DataFrame, seconds: int, quarters: int = 4) -> DataFrame:
    """(event_id, recent, before, part): of each user's events the sum of values over the last ``seconds``, the value before, and the part by value."""
    at = F.unix_timestamp("ts")
    user = Window.partitionBy("user_id")
    return events.withColumn("__at", at).select(
        "event_id", F.sum("value").over(user.orderBy("__at").rangeBetween(-seconds, Window.currentRow)).alias("recent"),
        F.lag("value").over(user.orderBy("ts", "event_id")).alias("before"), F.ntile(quarters).over(user.orderBy("value", "event_id")).alias("part"),
    )


def parts(events: DataFrame, key: str = "k") -> DataFrame:
    """(event_id, day, hour, weekday, number): the date, hour and weekday (Monday is 1) of an event and a whole number of its JSON properties."""
    return events.select(
        "event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.hour("ts").alias("hour"), (F.weekday("ts") + 1).alias("weekday"),
        F.get_json_object("props", f"$.{key}").cast("int").alias("number"),
    )


def distinct_features(counts: DataFrame) -> DataFrame:
    """(cell, n): different features of each cell."""
    return counts.where("x <> 0").groupBy("cell").agg(F.count_distinct("feature").alias("n"))
