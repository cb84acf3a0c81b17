"""Streams: means over time windows, and correction by a static table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.operators.wind import correct


def windowed_mean(stream: DataFrame, keys: list[str], value: str, time: str = "time", size: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, keys, value, n): means by window, given out when the watermark passes a window's end. Batch frames work too."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark(time, late)
    out = timed.groupBy(F.window(time, size), *keys).agg(F.avg(value).alias(value), F.count(value).alias("n"))
    return out.select(F.col("window.start").alias("start"), *keys, value, "n")


def corrected(stream: DataFrame, factors: DataFrame, resolution: str) -> DataFrame:
    """A stream of winds, corrected by factors that don't change: a stream-static join without state."""
    return correct(stream, factors, resolution)


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes all that is there now to Parquet and ends; the next call goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def read_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
