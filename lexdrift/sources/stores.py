"""Readers and writers of the tables between stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TEXTS = "celex string, url string, language string, text string, paragraphs array<string>, paragraph_nums array<string>, paragraph_count int, char_count int, status string, error string"
USAGES = "word string, celex string, para_idx int, char_start int, char_end int, year int"
USAGE_EMBEDDINGS = "word string, year int, usage_id long, emb array<float>"
SLICE_VECTORS = "slice string, word string, cnt long, vec array<float>"


def read_records(spark: SparkSession, path: str | list[str], schema: str | StructType) -> DataFrame:
    """JSON records a line; blank and malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_records(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def existing_ids(records: DataFrame, field: str) -> DataFrame:
    return records.where(F.col(field).isNotNull()).select(F.col(field).cast("string").alias(field)).distinct()


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """tokens of each line of one or more text files."""
    rows = spark.read.text(paths)
    return rows.select(F.filter(F.split(F.trim("value"), r"\s+"), lambda t: t != "").alias("tokens"))


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_by(df: DataFrame, path: str, by: str) -> None:
    """Parquet by partition; only the partitions at hand are replaced, so a stage can be run again for some."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def missing_parts(df: DataFrame, done: DataFrame, by: str) -> DataFrame:
    """Rows whose partition is not stored yet."""
    return df.join(done.select(by).distinct(), by, "left_anti")


def load_usage_embeddings(spark: SparkSession, path: str, years: list[int] | None = None, words: DataFrame | None = None, min_usages: int = 1) -> DataFrame:
    """Usages of the years and words asked for, of cells with enough of them. Years prune partitions; cells are counted without reading vectors."""
    rows = spark.read.schema(USAGE_EMBEDDINGS).parquet(path)
    if years is not None:
        rows = rows.where(F.col("year").isin(years))
    if words is not None:
        rows = rows.join(words.select("word").distinct(), "word", "left_semi")
    if min_usages > 1:
        cells = rows.groupBy("word", "year").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= min_usages)
        rows = rows.join(cells, ["word", "year"], "left_semi")
    return rows


def save_vocabulary(df: DataFrame, path: str) -> None:
    df.orderBy("word").coalesce(1).write.mode("overwrite").json(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def year_of(date: Column) -> Column:
    """Year of a date in text; null where it is none."""
    return F.year(F.try_to_date(date)) if hasattr(F, "try_to_date") else F.year(F.try_to_timestamp(date))


def in_years(df: DataFrame, first: int, last: int, date: str = "date") -> DataFrame:
    return df.withColumn("year", year_of(F.col(date))).where(F.col("year").between(first, last))


def read_word_settings(path: str) -> tuple[dict, dict[str, list[str]]]:
    """(settings, words by category) of a YAML file: lists are categories of words, everything else is a setting."""
    import yaml

    with open(path, encoding="utf-8") as f:
        told = yaml.safe_load(f) or {}
    lists = {k: [str(w) for w in v] for k, v in told.items() if isinstance(v, list)}
    return {k: v for k, v in told.items() if k not in lists}, lists


def write_word_settings(path: str, settings: dict, words: dict[str, list[str]]) -> None:
    """The same file again, settings first, in the order given; it takes its name once it is whole."""
    import os

    import yaml

    with open(f"{path}.new", "w", encoding="utf-8") as f:
        yaml.safe_dump(settings | words, f, sort_keys=False, allow_unicode=True)
    os.replace(f"{path}.new", path)


def categories(spark: SparkSession, words: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame([(c, w) for c, own in words.items() for w in own], "category string, word string")
