"""Whitening of embeddings (operator 12): covariances by SQL sums over the upper triangle, decomposed by LAPACK.

Three things are aggregated, each a row to the driver: sums of each dimension,
sums of the centred products of every pair of dimensions i <= j (generated SQL
expressions of one aggregation), and the same over the whitened vectors, which
tells how far their covariance is from the identity. What the driver holds
grows with the square of the dimensions, never with the rows.

Defined results: vectors that are null or hold null or non-finite entries take
no part, nor do those for which 64 times an entry reaches 2^61, as no whole
number of 64 bits would hold its sums. Vectors of another length than the most
common one (the longer, at a tie) take no part either. Repeated rows count, and
come back, as often as they are there. A component without variance, to double
precision, has no whitened values: they are null, and it is left out of the
error. Without vectors there is no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexdrift.llm.common import tune

SCALE, SHIFT = 64, 1_000_000
#: Sums in one aggregation; only vectors of over 90 dimensions need more than one.
MOST_SUMS = 4096


@dataclass
class Whitening:
    """What was fitted: rows, sums of dimensions, eigenvalues (falling), unit components as columns, and which have variance."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def live(self) -> np.ndarray:
        return self.values > max(len(self.sums), 1) * np.finfo(float).eps * max(self.values.max(initial=0.0), 0.0)

    @property
    def explained(self) -> list[float | None]:
        return [float(e / self.trace) if self.trace > 0 else None for e in self.values]


def whole_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, x: whole numbers floor(64 * component) + 1,000,000 of the vectors that take part."""
    most = float(2**61 / SCALE)
    fit = F.forall(column, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(most), F.lit(False)))
    return vectors.where(F.col(column).isNotNull()).where(fit).select("vec_id", F.transform(column, lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))) + F.lit(SHIFT)).alias("x"))


def covariance(df: DataFrame, columns: list[str], n: int) -> np.ndarray:
    """Covariances, divisor ``n``, of SQL expressions that are centred already: one sum for each pair of the upper triangle."""
    d = len(columns)
    # Sums of what cannot be null need no look at each value.
    centred = df.selectExpr(*(f"coalesce({c}, 0D) as c{i}" for i, c in enumerate(columns)))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    out = np.zeros((d, d))
    for at in range(0, len(pairs), MOST_SUMS):
        block = pairs[at : at + MOST_SUMS]
        for (i, j), s in zip(block, centred.agg(*(F.expr(f"sum(c{i} * c{j})") for i, j in block)).first(), strict=True):
            out[i, j] = out[j, i] = s / n
    return out


def fit_whitening(whole: DataFrame, n_components: int = 32) -> Whitening | None:
    """Fit on all of ``whole`` (x: array of long of one length); None without rows."""
    d = whole.select(F.size("x").alias("d")).groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    if d is None or not d[0]:
        return None
    same = whole.where(F.size("x") == d[0])
    n, *sums = same.agg(F.count(F.lit(1)), *(F.sum(F.get("x", F.lit(i)).cast("decimal(20,0)")) for i in range(d[0]))).first()
    sums = [int(s) for s in sums]
    # x - sum / n: the whole part is taken off exactly.
    v = covariance(same, [f"cast(get(x, {i}) - {s // n}L as double) - {s % n / n!r}D" for i, s in enumerate(sums)], n)
    values, components = np.linalg.eigh(v)
    order = np.argsort(values)[::-1][:n_components]
    return Whitening(n, sums, values[order], components[:, order], float(np.trace(v)))


def apply_whitening(whole: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, w: whitened values of each component (null without variance), deviation: decimal, exact."""
    n, sums, live = model.n, model.sums, model.live
    floors, rests = np.array([s // n for s in sums], "i8"), np.array([s % n / n for s in sums])
    scaled = np.where(live, model.components / np.sqrt(np.where(live, model.values, 1.0)), np.nan)
    vec_id = whole.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            off = x - floors
            w = pa.array(((off - rests) @ scaled).ravel(), from_pandas=True)
            places = pa.array(np.arange(0, len(w) + 1, scaled.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.ListArray.from_arrays(places, w), pa.array(deviations(off, n, sums), pa.string())], ["vec_id", "w", "deviation"])

    out = whole.where(F.size("x") == len(sums)).mapInArrow(run, f"vec_id {vec_id}, w array<double>, deviation string")
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def deviations(off: np.ndarray, n: int, sums: list[int]) -> list[str]:
    """Sum over dimensions of (n * x - sum)^2, as decimals; ``off`` is x less the whole part of the mean."""
    rest = np.array([s % n for s in sums], object)
    if int(np.abs(off).max(initial=0)) * n + n < 2**31 / max(1, len(sums)):
        return [str(v) for v in ((off * n - rest.astype("i8")) ** 2).sum(1)]
    return [str(v) for v in ((off.astype(object) * n - rest) ** 2).sum(1)]


def identity_error(whitened: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity, over components with variance."""
    live = np.flatnonzero(model.live)
    if not len(live):
        return 0.0
    means = whitened.agg(*(F.sum(F.get("w", F.lit(int(k)))) for k in live)).first()
    v = covariance(whitened, [f"get(w, {k}) - ({m / model.n!r}D)" for k, m in zip(live, means, strict=True)], model.n)
    return float(np.abs(v - np.eye(len(live))).max())


def whiten(vectors: DataFrame, n_components: int = 32) -> DataFrame:
    """A row for each vector that takes part and component (from 1): n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    tune(spark)
    whole = whole_vectors(vectors)
    model = fit_whitening(whole, n_components)
    if model is None:
        vec_id = vectors.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {vec_id}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    whitened = apply_whitening(whole, model)
    error = identity_error(whitened, model)
    rows = whitened.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened"))
    explained = F.array(*(F.lit(e).cast("double") for e in model.explained))
    return rows.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, "k").alias("explained"), F.lit(error).alias("identity_error"))
