"""The streaming extension gives the batch results."""

import shutil

from pyspark.sql import functions as F
from seriesforge.streaming import events as streams


def run(query_df, spark, name, mode):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_windowed_means(spark, sf_dir, tmp_path):
    shutil.copy(f"{sf_dir}/events.parquet", tmp_path / "e.parquet")
    got = run(streams.windowed_means(streams.read_events(spark, str(tmp_path))), spark, "means", "complete")
    batch = spark.read.parquet(str(tmp_path)).groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").start.alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert {tuple(r) for r in got.select("start", "event_type", "n").collect()} == {tuple(r) for r in batch.collect()}


def test_running_climatology(spark, sf_dir, tmp_path):
    shutil.copy(f"{sf_dir}/events.parquet", tmp_path / "e.parquet")
    got = run(streams.running_climatology(streams.read_events(spark, str(tmp_path))), spark, "climatology", "update")
    last = got.groupBy("event_type", "hour").agg(F.max("n").alias("n"))
    batch = spark.read.parquet(str(tmp_path)).groupBy("event_type", F.hour(F.col("ts").cast("timestamp")).alias("hour")).agg(F.count("*").alias("n"))
    assert {tuple(r) for r in last.collect()} == {tuple(r) for r in batch.collect()}
