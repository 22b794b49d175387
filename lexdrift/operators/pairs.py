"""Distances between all usages of a word: pairs of blocks, exact sums, and counts in fine bins that tell median and dip."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexdrift.lineage import cut
from lexdrift.operators import kernels

#: Bins of cosine distances, which lie between 0 and 2: a median is off by less than a bin's width, 3.1e-5.
BINS = 1 << 16
#: Usages in a block; a task holds the distances of two blocks.
BLOCK = 1024
SUMMARY = "n_values long, mean double, median double, std double, dip double, dip_pvalue double"


def pair_bins(usages: DataFrame, by: list[str], ident: str = "usage_id", block: int = BLOCK) -> DataFrame:
    """by, bin, n, s, q: how many pairs of a key's usages have a distance in each bin, and the sums of those distances and of their squares.

    Usages are dealt to blocks by a hash of ``ident``; each two blocks meet
    once, so a key of n usages is as many tasks as pairs of blocks, and none
    holds more than ``block`` squared distances. Bins are added up before and
    after the shuffle. Null vectors take no part.
    """
    rows = usages.where("emb is not null")
    blocks = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = rows.join(blocks, by).withColumn("own", F.pmod(F.xxhash64(*by, ident), F.col("blocks")).cast("int"))
    left = rows.select(*by, F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)).alias("j"), "emb")
    # New names keep the two sides of one table apart.
    right = rows.select(*(F.col(c).alias(f"{c}_b") for c in by), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("k"), F.col("own").alias("l"), F.col("emb").alias("other"))
    kinds = {f.name: f.dataType.simpleString() for f in usages.schema}

    def count(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        columns = [*by, "bin", "n", "s", "q"]
        if a.empty or b.empty:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in columns})
        d = 1 - kernels.unit_matrix(np.stack(a["emb"].to_numpy())) @ kernels.unit_matrix(np.stack(b["other"].to_numpy())).T
        d = d[np.triu_indices(len(d), 1)] if key[-2] == key[-1] else d.ravel()
        at = np.clip((d * (BINS / 2)).astype("i8"), 0, BINS - 1)
        bins, inverse, n = np.unique(at, return_inverse=True, return_counts=True)
        out = pd.DataFrame({"bin": bins, "n": n, "s": np.bincount(inverse, d, len(bins)), "q": np.bincount(inverse, d * d, len(bins))})
        for c, v in zip(by, key):
            out[c] = v
        return out[columns]

    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", bin long, n long, s double, q double"
    found = left.groupBy(*by, "i", "j").cogroup(right.groupBy(*(f"{c}_b" for c in by), "k", "l")).applyInPandas(count, schema)
    return added(found, by)


def value_bins(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """The same for a column of distances."""
    d = F.col(value).cast("double")
    at = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(d * (BINS / 2))))
    return added(values.where(d.isNotNull()).select(*by, at.cast("long").alias("bin"), F.lit(1).cast("long").alias("n"), d.alias("s"), (d * d).alias("q")), by)


def added(bins: DataFrame, by: list[str]) -> DataFrame:
    return bins.groupBy(*by, "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))


def summaries(bins: DataFrame, by: list[str], nulls: dict[int, np.ndarray] | None = None) -> DataFrame:
    """by, n_values, mean, median, std, dip, dip_pvalue of binned distances; a task holds one key's bins, ``BINS`` rows at most.

    Mean and deviation are exact; for median and dip a bin's values stand at
    their mean, so they are exact where bins hold one value. Below four values
    no dip is unusual: p is 1.
    """
    kinds = {f.name: f.dataType.simpleString() for f in bins.schema}

    def told(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin")
        n, s = rows["n"].to_numpy(), rows["s"].to_numpy()
        total, x, upto = int(n.sum()), s / n, np.cumsum(n)
        mean = s.sum() / total
        middle = [x[np.searchsorted(upto, q, side="right")] for q in ((total - 1) // 2, total // 2)]
        spread = max(0.0, rows["q"].sum() / total - mean * mean) ** 0.5
        dip = kernels.dip_of_counts(x, n)
        p = kernels.dip_p_value(dip, total, nulls=nulls)
        return pd.DataFrame([(*key, total, mean, sum(middle) / 2, spread, dip, p)], columns=[*by, "n_values", "mean", "median", "std", "dip", "dip_pvalue"])

    return bins.groupBy(*by).applyInPandas(told, ", ".join(f"{c} {kinds[c]}" for c in by) + ", " + SUMMARY)


def null_dips(spark: SparkSession, largest: int, draws: int = 1000, seed: int = 42, path: str | None = None) -> dict[int, np.ndarray]:
    """Sorted dips of ``draws`` uniform samples at each tabulated size, as far as samples of up to ``largest`` values need them.

    Drawn by executors; ``draws`` numbers a size come to the driver. With a
    ``path`` the table is written there once, by seed and draws, and read from
    then on.
    """
    sizes = [s for k, s in enumerate(kernels.DIP_SIZES) if k == 0 or kernels.DIP_SIZES[k - 1] < largest]
    schema = "size int, dip double"

    def draw(frames):
        for frame in frames:
            rows = [(int(s), kernels.dip(np.random.default_rng([seed, int(s), int(k)]).random(int(s)))) for s, k in zip(frame["size"], frame["k"])]
            yield pd.DataFrame(rows, columns=["size", "dip"])

    def drawn(wanted: list[int]) -> DataFrame:
        grid = spark.range(draws).select(F.explode(F.array(*map(F.lit, wanted))).alias("size"), F.col("id").alias("k"))
        # The sizes' costs differ by far: each task gets some of each.
        return grid.repartition(8 * max(1, spark.sparkContext.defaultParallelism // 8), "k").mapInPandas(draw, schema)

    if path is None:
        found = drawn(sizes)
    else:
        where = f"{path}/draws={draws}/seed={seed}"
        jvm = spark.sparkContext._jvm
        done = jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
        if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            drawn(kernels.DIP_SIZES).write.mode("overwrite").parquet(where)
        found = spark.read.schema(schema).parquet(where).where(F.col("size").isin(sizes))
    return {r.size: np.sort(r.dips) for r in found.groupBy("size").agg(F.collect_list("dip").alias("dips")).collect()}


def distance_summaries(usages: DataFrame, by: list[str], ident: str = "usage_id", draws: int = 1000, seed: int = 42, block: int = BLOCK, null_path: str | None = None) -> DataFrame:
    """by, n_values, mean, median, std, dip, dip_pvalue of all pairwise distances of each key's usages; a key with one usage has no row."""
    bins = cut(pair_bins(usages, by, ident, block), "pairs")
    most = usages.where("emb is not null").groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    return summaries(bins, by, null_dips(usages.sparkSession, most * (most - 1) // 2, draws, seed, null_path))
