"""Streams: a live confidence histogram and the newest event of each type, as Structured Streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.control import confidence_bin


def source(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format("parquet")
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def live_histogram(outcomes: DataFrame, column: str = "confidence") -> DataFrame:
    """Counts by bin, for update or complete mode. A correction is a pair of rows: weight -1 for the old bin, 1 for the new."""
    weight = F.col("weight") if "weight" in outcomes.columns else F.lit(1)
    return outcomes.groupBy(confidence_bin(F.col(column)).alias("bin")).agg(F.sum(weight).alias("n"))


def newest_by_type(events: DataFrame, time: str, by: str) -> DataFrame:
    """The newest event of each type; its state is one row for each type, which is never dropped, so there is no watermark."""
    rest = [c for c in events.columns if c not in (by, time)]
    return events.groupBy(by).agg(F.max(F.struct(time, *rest)).alias("newest"))
