"""Connected components of an edge table, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexdrift.llm.common import drop_path, scratch


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, label (the least node of its component) of every node of ``edges`` (u, v: long).

    Each round joins the edges with one least neighbour a node: aggregates are
    combined before their shuffle, and written, so that the joins have shuffles
    of their own on both sides, which Spark can split where a node is hot.
    Edges are written to the shared folder after each round. No edge, node or
    label comes to the driver, which sees the sums that tell the end.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    paths: list[str] = []

    def written(df: DataFrame) -> DataFrame:
        path = scratch(spark, "edges")
        df.write.parquet(path)
        paths.append(path)
        return spark.read.schema(df.schema).parquet(path)

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = written(now)
    before = mark(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        lower = written(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(lower, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = written(small)
        after = mark(now)
        for path in paths[:-1]:
            drop_path(spark, path)
        del paths[:-1]
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components are not settled after {most_rounds} rounds")
    heads = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(heads.select("node", F.col("node").alias("label")))
