"""Ranks, bins and quantiles with the conventions of data-frame libraries where those differ from SQL's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))


def average_rank(df: DataFrame, value: str, name: str, by: list[str] | None = None) -> DataFrame:
    """Rank from 1, ties sharing their mean rank; nulls get null.

    The running count is taken over distinct values, not rows, so what one
    task sorts is as long as the column has different values.
    """
    by = by or []
    counts = value_counts(df, value, by)
    before = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn(name, F.coalesce(F.sum("__n").over(before), F.lit(0)) + (F.col("__n") + 1) / 2.0).drop("__n")
    return df.join(ranked, [*by, value], "left")


def quantile_bins(df: DataFrame, value: str, name: str, bins: int, first: int = 1) -> DataFrame:
    """Bins between ``bins`` even quantiles, right-closed, the lowest value included; equal edges fall together, so ties share a bin.

    Edges are a single small row: joined by broadcast, its size is ``bins`` + 1.
    """
    cuts = F.percentile(value, F.array(*[F.lit(k / bins) for k in range(bins + 1)]))
    edges = df.agg(F.array_distinct(cuts).alias("__edges"))
    below = F.size(F.filter("__edges", lambda e: e < F.col(value)))
    return df.crossJoin(F.broadcast(edges)).withColumn(name, F.when(F.col(value).isNotNull(), F.greatest(below, F.lit(1)) + (first - 1))).drop("__edges")


def fraction_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Average rank over the count of values."""
    ranked = average_rank(df, value, name)
    n = df.agg(F.count(value).alias("__all"))
    return ranked.crossJoin(F.broadcast(n)).withColumn(name, F.col(name) / F.col("__all")).drop("__all")


def competition_place(df: DataFrame, value: str, place: str, percentile: str) -> DataFrame:
    """``place``: how many rows have this value or a higher one; ``percentile``: 100 times the share of rows with a lower one."""
    counts = value_counts(df, value, [])
    down = Window.orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    n = df.agg(F.count(value).alias("__all"))
    ranked = counts.withColumns({place: F.sum("__n").over(down), "__below": F.coalesce(F.sum("__n").over(up), F.lit(0))}).drop("__n")
    return df.join(ranked, value, "left").crossJoin(F.broadcast(n)).withColumn(percentile, 100.0 * F.col("__below") / F.col("__all")).drop("__below", "__all")


def sum_in_order(value: Column, *order: str) -> Column:
    """An aggregate: the sum of a group's values in the given order, so that it has the same last digits however rows are dealt.

    Nulls add nothing; a sum of nothing is null. A group's values stand in one
    row, so groups are those of a word or of one of its slices, not whole tables.
    """
    listed = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(*order, value.cast("double").alias("__x")))))
    return F.when(F.count(value) > 0, F.aggregate(listed, F.lit(0.0), lambda s, e: s + e["__x"]))


def mean_in_order(value: Column, *order: str) -> Column:
    return sum_in_order(value, *order) / F.count(value)


def guarded_ratio(above: Column, below: Column, least: float = 1e-10) -> Column:
    """``above`` over ``below``, null unless ``below`` exceeds ``least``."""
    return F.when(below > least, above / below)
