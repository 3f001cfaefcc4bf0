"""Structured Streaming queries, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.queries.registry import ORACLES, QUERIES
from tessera.streaming.histogram import live_histogram, newest_by_type


def finished(stream: DataFrame, mode: str) -> DataFrame:
    name = f"stream_{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, so that it may be a file or a folder


def stream_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = events(spark, sf_dir).select((F.pmod(F.col("event_id") * 37, F.lit(1009)) / 1009.0).alias("confidence"))
    return finished(live_histogram(outcomes), "complete")


def stream_newest_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = newest_by_type(events(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "event_id"), "ts", "event_type")
    return finished(newest, "complete").select("event_type", "newest.event_id")


QUERIES |= {f.__name__: f for f in (stream_histogram, stream_newest_by_type)}
ORACLES["stream_histogram"] = "SELECT CAST(floor(((event_id * 37) % 1009) / 1009.0 * 10) AS INT) AS bin, count(*) AS n FROM events GROUP BY 1"
ORACLES["stream_newest_by_type"] = "SELECT event_type, arg_max(event_id, ts) AS event_id FROM events GROUP BY 1"
