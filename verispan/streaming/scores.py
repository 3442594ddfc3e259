"""Scoring of features as they arrive. Beyond batch use; the score needs no state, so any batch may come late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.calibration import Calibration, apply_calibration


def scored_stream(spark: SparkSession, path: str, schema: StructType, state: Calibration, files_per_batch: int = 100) -> DataFrame:
    """A stream of feature shards with the frozen score."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return apply_calibration(rows, state)


def windowed_means(scored: DataFrame, time: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Mean scores by task in event-time windows; later rows than ``late`` are dropped with their window's state."""
    return scored.withWatermark(time, late).groupBy(F.window(time, width), "task").agg(F.avg("score").alias("mean_score"), F.count("*").alias("n"))


def write_scores(scored: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append scored rows as Parquet, exactly once; by default all that is there, then stop."""
    writer = scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
