"""Streaming counterparts of the aggregates: an extension beyond the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    events = spark.readStream.schema(EVENTS).parquet(folder)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_means(events: DataFrame, late: str = "1 hour", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Mean and count by type and event-time window; rows later than the watermark are left out."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.avg("value").alias("mean"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "mean", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def running_climatology(events: DataFrame) -> DataFrame:
    """Mean by type and hour of the day, kept as sums and counts in state."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, n = state.get if state.exists else (0.0, 0)
        for pdf in batches:
            total, n = total + float(pdf["value"].sum()), n + len(pdf)
        state.update((total, n))
        yield pd.DataFrame([(*key, total / n if n else None, n)], columns=["event_type", "hour", "mean", "n"])

    keyed = events.withColumn("hour", F.hour("ts")).select("event_type", "hour", "value")
    return keyed.groupBy("event_type", "hour").applyInPandasWithState(update, "event_type string, hour int, mean double, n long", "total double, n long", "update", GroupStateTimeout.NoTimeout)
