"""Time slices: labels, midpoints, sliding windows over years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def midpoint(label: Column) -> Column:
    """Middle of wYYYY_YYYY, year of yYYYY, value of a number, else 0."""
    window = F.regexp_extract(label, r"^w(\d+)_(\d+)$", 1), F.regexp_extract(label, r"^w(\d+)_(\d+)$", 2)
    year = F.regexp_extract(label, r"^y(\d+)$", 1)
    return F.when(window[0] != "", (window[0].cast("double") + window[1].cast("double")) / 2).when(year != "", year.cast("double")).otherwise(F.coalesce(label.try_cast("double"), F.lit(0.0)))


def window_label(start: Column, size: int) -> Column:
    return F.concat(F.lit("w"), start.cast("string"), F.lit("_"), (start + (size - 1)).cast("string"))


def sliding_windows(spark: SparkSession, start: int, end: int, size: int = 5, step: int = 1) -> DataFrame:
    """label, start_year, end_year, mid, ord of each whole window within the years."""
    starts = spark.range(start, max(start, end - size + 2), step).select(F.col("id").cast("int").alias("start_year"))
    return starts.select(window_label(F.col("start_year"), size).alias("label"), "start_year", (F.col("start_year") + size - 1).alias("end_year"), (F.col("start_year") + (size - 1) / 2.0).alias("mid"), (((F.col("start_year") - start) / step) + 1).cast("int").alias("ord"))


def in_windows(df: DataFrame, start: int, end: int, size: int = 5, step: int = 1, year: str = "year") -> DataFrame:
    """A row for each window that holds the row's year, with its label in ``slice``. An explosion of at most ``size`` a row, not a range join."""
    y = F.col(year)
    first = F.greatest(F.lit(start), y - size + 1)
    aligned = F.ceil((first - start) / step) * step + start
    last = F.least(y, F.lit(end - size + 1))
    starts = F.when((y >= start) & (y <= end) & (aligned <= last), F.sequence(aligned.cast("int"), last.cast("int"), F.lit(step)))
    return df.withColumn("__start", F.explode(starts)).withColumn("slice", window_label(F.col("__start"), size)).drop("__start")


def single_years(df: DataFrame, year: str = "year") -> DataFrame:
    return df.withColumn("slice", F.concat(F.lit("y"), F.col(year).cast("string")))
