"""Vector arithmetic on array columns, as Catalyst expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-10


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, e: s + e.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector over its norm, guarded against nought."""
    return F.transform(a, lambda x: x.cast("double") / (norm(a) + EPS))


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") * by)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + EPS)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine with a guard on each norm."""
    return 1 - dot(a, b) / ((norm(a) + EPS) * (norm(b) + EPS))


def vector_sums(df: DataFrame, keys: list[str], vector: str = "vec", name: str = "vsum") -> DataFrame:
    """keys, ``name`` (array<double>: sums by component), n: how many vectors.

    Vectors are summed as such within each task and a row a group and task is
    shuffled, whatever a group's size. Those of a group have one length; rows
    with a null vector are left out.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = df.where(F.col(vector).isNotNull()).select(*keys, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("__v"))
    sums = rows.groupBy(*keys).agg(Summarizer.metrics("sum", "count").summary(F.col("__v")).alias("__s"))
    return sums.select(*keys, vector_to_array("__s.sum").alias(name), F.col("__s.count").alias("n"))


def vector_means(df: DataFrame, keys: list[str], vector: str = "vec", name: str = "centroid") -> DataFrame:
    """keys, ``name``, n: the mean vector of each group."""
    return vector_sums(df, keys, vector, name).withColumn(name, F.transform(name, lambda x: x / F.col("n")))


def mean_pairwise_cosine(unit_sum: Column, n: Column) -> Column:
    """Mean cosine over all pairs of ``n`` unit vectors, from their sum; null below two."""
    return F.when(n >= 2, (dot(unit_sum, unit_sum) - n) / (n * (n - 1)))


def mean_cosine_between(df: DataFrame, keys: list[str], word: str, vector: str, name: str) -> DataFrame:
    """keys, ``name``: mean cosine over all pairs of a group's unit vectors that have different words; null if there are none.

    A word may have several vectors, which are not paired with each other.
    """
    own = vector_sums(df, [*keys, word], vector, "__s")
    n = F.col("n").cast("double")
    sums = vector_sums(own.select(*keys, F.concat(F.array(n, n * n, dot(F.col("__s"), F.col("__s"))), "__s").alias("__p")), keys, "__p", "__p")
    # Sums come as means times counts: whole numbers are made whole again.
    n, same, inside = F.round(F.get("__p", F.lit(0))), F.round(F.get("__p", F.lit(1))), F.get("__p", F.lit(2))
    whole = F.expr("slice(__p, 4, size(__p) - 3)")
    return sums.select(*keys, F.when(n * n > same, (dot(whole, whole) - inside) / (n * n - same)).alias(name))
