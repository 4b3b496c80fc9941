"""Reading the engine's inputs as DataFrames with one schema for each role."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades from `events`: (symbol, ts, event_id, price, size)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
        F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("size"),
    )
