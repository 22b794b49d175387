"""Exact top-k search by pivot tables (operator 2).

Vectors become integers, floor(64 x). One more coordinate, the root of what a
vector's square falls short of the largest, makes the highest inner product the
smallest distance, so the triangle inequality gives bounds: a candidate's
distance from a query is no less than the largest difference of their distances
to any pivot. Candidates lie in cells by their nearest pivot; a cell keeps its
range of distances to each pivot and is cut into blocks of bounded size. A query
first searches a block of its own cell, which yields a score to beat; cells
whose bounds cannot reach it are passed over, and in the others candidates are
evaluated in the order of their bounds until none left can reach it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexdrift.llm.common import drop_tables, handed_back, materialize, tune

PIVOTS = 24
PIVOT_SAMPLE = 2048
BLOCK = 8192
QUERY_BLOCK = 4096
#: Slack for rounding in distances, which are single roots of integers below 2 ** 53.
EPS = 1e-6


#: Whole numbers that components become are below this, so that they fit a long.
LARGEST = float(1 << 62)


@dataclass
class Tally:
    """Accumulators that ``top_k`` adds to: candidates that queries met in blocks they searched, and those evaluated."""

    met: Accumulator
    evaluated: Accumulator

    @staticmethod
    def on(spark: SparkSession) -> Tally:
        return Tally(spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0))


def quantized(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id, v (array<long>): rows with a vector whose components are all finite and, times 64, below ``LARGEST``."""
    x = F.col(vector_column)
    usable = x.isNotNull() & F.col(id_column).isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    whole = F.forall(x, lambda e: F.abs(e.cast("double")) < LARGEST / 64)
    return vectors.where(usable).where(whole).select(F.col(id_column).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * 64)).alias("v"))


def matrix(column: pa.Array, width: int, kind: str = "f8") -> np.ndarray:
    """Rows of a list column, shorter ones padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(len(column), width).astype(kind)
    out = np.zeros((len(column), width), kind)
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def farthest_first(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots far apart: each next one is the row farthest from those taken."""
    taken = [0]
    away = ((sample - sample[0]) ** 2).sum(1)
    while len(taken) < min(count, len(sample)) and away.max() > 0:
        taken.append(int(away.argmax()))
        away = np.minimum(away, ((sample - sample[taken[-1]]) ** 2).sum(1))
    return sample[taken]


def lifted(v: np.ndarray, largest: float) -> np.ndarray:
    """Candidates on the sphere of the largest square."""
    return np.hstack([v, np.sqrt(np.maximum(0, largest - (v * v).sum(1)))[:, None]])


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (points * points).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(0, square))


def score_bounds(query_square: np.ndarray, largest: float, lower: np.ndarray) -> np.ndarray:
    """The highest inner product that a distance of at least ``lower`` allows."""
    return (query_square + largest - lower * lower) / 2 + EPS * (1 + query_square + largest)


def exact_kind(largest: float) -> str:
    """The cheapest type in which sums of products of vectors with such squares are exact: single, double, whole numbers of 64 bits, or of any size."""
    return "f4" if largest < 1 << 23 else "f8" if largest < 1 << 52 else "i8" if largest < 1 << 61 else "O"


def highest(scores: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller name."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda j: (-scores[j], names[j]))[:k], "i8")
    return np.lexsort((names, -scores))[:k]


def as_longs(scores: np.ndarray) -> np.ndarray:
    try:
        return scores.astype("i8")
    except OverflowError:
        raise ValueError("a score that is to be reported does not fit a long") from None


def search_block(queries: np.ndarray, query_ids: np.ndarray, to_beat: np.ndarray, table_q: np.ndarray, vectors: np.ndarray, ids: np.ndarray, table: np.ndarray, largest: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query place, candidate id, score) of each query's best ``k`` in the block that reach its score to beat, and how many candidates were evaluated."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    squares = (queries.astype("f8") ** 2).sum(1)
    evaluated = 0
    # One row a pivot, in single precision; the slack covers the rounding of both distances.
    rows, rows_q = np.ascontiguousarray(table.T.astype("f4")), table_q.astype("f4")
    slack = 1e-6 * float(max(np.abs(rows).max(initial=0), np.abs(rows_q).max(initial=0)))
    apart = np.empty(len(ids), "f4")
    # As the block's own vectors ask for: one large vector makes no other block costly.
    kind = exact_kind(max((vectors.astype("f8") ** 2).sum(1).max(initial=0), squares.max(initial=0)))
    exact, exact_q = vectors.astype(kind), queries.astype(kind)
    for q in range(len(queries)):
        lower = np.zeros(len(ids), "f4")
        for p in range(len(rows)):
            np.subtract(rows[p], rows_q[q, p], out=apart)
            np.abs(apart, out=apart)
            np.maximum(lower, apart, out=lower)
        lower = np.maximum(lower.astype("f8") - slack, 0)
        bounds = score_bounds(squares[q], largest, lower)
        bounds[ids == query_ids[q]] = -np.inf
        best_ids, best, beat = np.zeros(0, "i8"), np.zeros(0, "O" if kind == "O" else "i8"), to_beat[q]

        def take(some: np.ndarray) -> None:
            nonlocal best_ids, best, beat, evaluated
            evaluated += len(some)
            scores = exact[some] @ exact_q[q]
            scores = scores if kind == "O" else scores.astype("i8")
            high = (scores >= beat).astype(bool)
            scores, names = np.concatenate([best, scores[high]]), np.concatenate([best_ids, ids[some][high]])
            order = highest(scores, names, k)
            best, best_ids = scores[order], names[order]
            if len(best) == k:
                beat = max(beat, best[-1])

        first = np.argpartition(-bounds, 4 * k)[: 4 * k] if len(ids) > 4 * k else np.arange(len(ids))
        take(first[(bounds[first] >= beat) & (bounds[first] > -np.inf)])
        bounds[first] = -np.inf
        left, size = np.flatnonzero((bounds >= beat) & (bounds > -np.inf)), 8 * k
        left = left[np.argsort(-bounds[left], kind="stable")]
        while len(left) and bounds[left[0]] >= beat:
            some, left, size = left[:size], left[size:], size * 2
            take(some[bounds[some] >= beat])
        keep = (best >= to_beat[q]).astype(bool)
        out.append((np.full(keep.sum(), q), best_ids[keep], as_longs(best[keep])))
    found = tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, "i8"),) * 3
    return *found, evaluated


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", pivots: int = PIVOTS, tally: Tally | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` highest inner products with ``vectors`` other than itself, ties to the smaller id.

    Null vectors, and those with a null or non-finite component, take no part,
    nor do rows with a null id, or vectors with a component that times 64 is no
    long (2^62 or more). Sums of products are exact whatever their size; a score
    that is to be reported and does not fit a long is an error, not left out.
    Shorter vectors count as ended by zeros. Rows that repeat an id are
    candidates each; a query never meets rows of its own id, and query rows that
    repeat an id are one query, ranked over the scores of all of them. Fewer candidates than ``k``: all of them. No queries or no vectors: no
    rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    tune(spark)
    data, asked = quantized(vectors, id_column, vector_column), quantized(queries, id_column, vector_column)
    stats = data.agg(F.max(F.size("v")).alias("width"), F.max(F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))).alias("largest"), F.count(F.lit(1)).alias("n")).first()
    asked_width = asked.agg(F.max(F.size("v"))).first()[0]
    schema = "query_id long, rank int, vec_id long, score long"
    if not stats.n or asked_width is None:
        return spark.createDataFrame([], schema)
    width, largest = max(stats.width, asked_width), float(stats.largest)
    sample = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).select("v").collect()
    rows = np.zeros((len(sample), width))
    for r, row in zip(rows, sample):
        r[: len(row.v)] = row.v
    ground = spark.sparkContext.broadcast(farthest_first(lifted(rows, largest), pivots))

    def tabled(candidates: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots = ground.value
            for batch in batches:
                v = matrix(batch.column("v"), width)
                table = distances(lifted(v, largest) if candidates else np.hstack([v, np.zeros((len(v), 1))]), pivots)
                flat = pa.array(table.ravel())
                starts = pa.array((np.arange(len(v) + 1) * table.shape[1]).astype("i4"))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.ListArray.from_arrays(starts, flat), pa.array(table.argmin(1).astype("i4"))], names=["vec_id", "v", "dist", "cell"])

        return run

    shape = "vec_id long, v array<long>, dist array<double>, cell int"
    table = materialize(data.mapInArrow(handed_back(tabled(True)), shape), "pivot-table")
    n_pivots = len(ground.value)
    # One row a pivot comes to the driver: how many rows its cell has, which cuts it into blocks of about BLOCK, and its ranges.
    ends = [f(F.get("dist", F.lit(p))) for f in (F.min, F.max) for p in range(n_pivots)]
    cells = table.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.array(*ends).alias("ends")).collect()
    names, cuts, ends = [r.cell for r in cells], [-(-r.n // BLOCK) for r in cells], np.array([r.ends for r in cells])
    cuts_of = F.create_map(*[F.lit(x) for pair in zip(names, cuts) for x in pair])[F.col("cell")]
    cut = F.pmod(F.xxhash64("vec_id", "v"), F.coalesce(cuts_of, F.lit(1))).cast("int")
    table = table.withColumn("block", F.struct("cell", cut.alias("cut")))
    asked = asked.mapInArrow(handed_back(tabled(False)), shape).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 + stats.n // (20 * QUERY_BLOCK))).cast("int"))

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names=names)
        q, v = matrix(left.column("v"), width, "i8"), matrix(right.column("v"), width, "i8")
        query_ids = left.column("vec_id").to_numpy()
        got = search_block(q, query_ids, left.column("beat").to_numpy(), matrix(left.column("dist"), n_pivots), v, right.column("vec_id").to_numpy(), matrix(right.column("dist"), n_pivots), largest, k)
        if tally is not None:
            tally.met.add(left.num_rows * right.num_rows)
            tally.evaluated.add(got[3])
        return pa.table([pa.array(query_ids[got[0].astype("i8")]), pa.array(got[1].astype("i8")), pa.array(got[2].astype("i8"))], names=names)

    def searched(questions: DataFrame) -> DataFrame:
        """``questions``: rows of ``asked`` with block and beat. Each part of the queries meets its own copy of the block."""
        parts = questions.select(F.col("block").alias("to"), F.col("part").alias("of")).distinct()
        copies = table.join(parts, F.col("block") == F.col("to")).select("vec_id", "v", "dist", "to", "of")
        found = questions.groupBy("block", "part").cogroup(copies.groupBy("to", "of"))
        return found.applyInArrow(search, "query_id long, vec_id long, score long")

    lowest = F.lit(float("-inf"))
    home = asked.withColumns({"block": F.struct("cell", F.lit(0).alias("cut")), "beat": lowest})
    first = materialize(searched(home), "own-block")
    per_query = first.groupBy("query_id").agg(F.min("score").cast("double").alias("worst"), F.count(F.lit(1)).alias("n"))
    beat = per_query.select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("worst")).otherwise(lowest).alias("beat"))

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and cell that may hold a score to beat."""
        for batch in batches:
            v, dist = matrix(batch.column("v"), width), matrix(batch.column("dist"), n_pivots)
            reach = np.empty((len(v), len(names)))
            for c in range(len(names)):
                gap = np.maximum(np.maximum(ends[c, :n_pivots] - dist, dist - ends[c, n_pivots:]).max(1), 0)
                reach[:, c] = score_bounds((v * v).sum(1), largest, gap)
            rows, columns = np.nonzero(reach >= batch.column("beat").to_numpy()[:, None])
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, pa.array(np.array(names, "i4")[columns])], names=[*batch.schema.names, "to"])

    beaten = asked.join(beat, "vec_id", "left").select("vec_id", "v", "dist", "cell", "part", F.coalesce("beat", lowest).alias("beat"))
    others = beaten.mapInArrow(handed_back(reached), f"{shape}, part int, beat double, to int")
    cuts_of = F.create_map(*[F.lit(x) for pair in zip(names, cuts) for x in pair])[F.col("to")]
    others = others.withColumn("cut", F.explode(F.sequence(F.lit(0), cuts_of - 1))).where("cell <> to or cut <> 0").select("vec_id", "v", "dist", "part", F.struct(F.col("to").alias("cell"), "cut").alias("block"), "beat")
    every = first.unionByName(searched(others))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
