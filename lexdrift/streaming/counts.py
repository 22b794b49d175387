"""Streaming counts: an extension for sources that arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, by, n: counts by tumbling window; rows later than ``late`` behind the newest are dropped once their window has closed."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def token_counts(texts: DataFrame, time: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """window_start, word, n of the tokens of arriving texts (``time``, text)."""
    from lexdrift.operators.text import preprocess

    rows = texts.select(time, F.explode(preprocess(F.col("text"))).alias("word"))
    return windowed_counts(rows, time, ["word"], width, late)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Work off what has arrived and end; the checkpoint lets the next run go on from there."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
