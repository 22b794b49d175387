"""Nearest neighbours within each slice, in pairs of blocks of bounded size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexdrift.functions.vectors import EPS

BLOCK = 4096
#: Rows of a block that are compared with another block at a time.
STRIP = 256
#: Pairs of points whose differences are held at a time.
PAIRS = 65_536
SCAN = "slice string, word string, neighbour string, sim double, close long"


def blocked(vecs: DataFrame, block: int) -> DataFrame:
    """slice, word, vec, block, blocks: each slice cut by a hash of its words into blocks of about ``block``."""
    counts = vecs.groupBy("slice").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    return vecs.select("slice", "word", "vec").join(F.broadcast(counts), "slice").withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))


def block_pairs(vecs: DataFrame, block: int):
    """Grouped left and right sides: every two blocks of a slice once, the one with the smaller number on the left."""
    rows = blocked(vecs, block)
    left = rows.select("slice", "word", "vec", F.col("block").alias("left"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("right"))
    # New names keep the two sides of one table apart.
    right = rows.select(F.col("slice").alias("in"), F.col("word").alias("name"), F.col("vec").alias("values"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("by"), F.col("block").alias("own"))
    return left.groupBy("slice", "left", "right").cogroup(right.groupBy("in", "by", "own"))


def unit_rows(column: pd.Series) -> np.ndarray:
    m = np.stack(column.to_numpy()).astype("f8")
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + EPS)


def cosines(a: pd.Series, b: pd.Series) -> np.ndarray:
    return unit_rows(a) @ unit_rows(b).T


def straight(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Negative Euclidean distances, from differences, so that near points keep their digits."""
    x, y = np.stack(a.to_numpy()).astype("f8"), np.stack(b.to_numpy()).astype("f8")
    out = np.zeros((len(x), len(y)))
    for i in range(x.shape[1]):
        out += (x[:, i, None] - y[None, :, i]) ** 2
    return -np.sqrt(out)


def straight_pairs(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Euclidean distances of columns ``i`` of ``x`` and ``j`` of ``y``, to the last digit as ``straight`` has them."""
    out = np.zeros(len(i))
    for at in range(0, len(i), PAIRS):
        own, p, q = out[at : at + PAIRS], i[at : at + PAIRS], j[at : at + PAIRS]
        for u, v in zip(x, y):
            own += (u[p] - v[q]) ** 2
    return np.sqrt(out)


class Products:
    """Squared distances of two sets of points from one matrix product, and by how much they may be off.

    Their last digits are lost, so they only tell which pairs are worth a
    distance from differences: with ``slack`` no other can be among the least.
    """

    def __init__(self, a: pd.Series, b: pd.Series):
        self.x, self.y = np.stack(a.to_numpy()).astype("f8"), np.stack(b.to_numpy()).astype("f8")
        self.xx, self.yy = (np.einsum("ij,ij->i", m, m) for m in (self.x, self.y))
        self.by_column = np.ascontiguousarray(self.x.T), np.ascontiguousarray(self.y.T)
        self.most = np.maximum(self.xx.max(), self.yy.max())
        #: Both roundings of each of two squares, several times over.
        self.slack = 32 * (self.x.shape[1] + 8) * np.finfo("f8").eps * self.most

    def finite(self) -> bool:
        """Whether all lengths are such that nothing overflows and no digit is lost to underflow."""
        return bool(np.isfinite(self.most) and self.most < 1e300 and (self.most == 0 or self.slack > 1e-290))

    def squares(self, at: int, strip: int) -> np.ndarray:
        out = self.x[at : at + strip] @ self.y.T
        out *= -2
        out += self.xx[at : at + strip, None]
        out += self.yy[None, :]
        return out

    def straight(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return straight_pairs(*self.by_column, i, j)


def least_pairs(i: np.ndarray, j: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` least ``d`` of each ``i``, least first, equal ones by ``j``."""
    order = np.lexsort((j, d, i))
    own = i[order]
    first = np.searchsorted(own, own)
    return order[np.arange(len(own)) - first < k]


def nearest_pairs(a: pd.Series, b: pd.Series, same: np.ndarray | None, k: int, both: bool):
    """(row of a, row of b, distance) of the ``k`` nearest of each row of ``a``, and those of each row of ``b`` if ``both``; None if some values do not allow products.

    ``same`` names for each row of ``a`` the row of ``b`` that is itself, or -1.
    """
    p = Products(a, b)
    if not p.finite():
        return None
    rows, columns, until = [], [np.zeros((3, 0))], np.full(len(p.y), np.finfo("f8").max)
    for strip, at in enumerate(range(0, len(p.x), STRIP)):
        d = p.squares(at, STRIP)
        if same is not None:
            own = same[at : at + STRIP]
            d[np.flatnonzero(own >= 0), own[own >= 0]] = np.inf
        last = np.partition(d, k - 1, axis=1)[:, k - 1] if k < d.shape[1] else np.full(len(d), np.finfo("f8").max)
        i, j = np.nonzero(d <= last[:, None] + p.slack)
        far = p.straight(i + at, j)
        kept = least_pairs(i, j, far, k)
        rows.append((i[kept] + at, j[kept], far[kept]))
        if not both:
            continue
        # A column's best so far bound what is looked at; at first those of the strip itself.
        here = np.partition(d, k - 1, axis=0)[k - 1] if not at and k < len(d) else until
        i, j = np.nonzero(d <= here + p.slack)
        columns.append(np.array([i + at, j, p.straight(i + at, j)]))
        # Kept to the best after 1, 2, 4, 8 strips and so on, so that few are sorted again.
        if strip & (strip + 1) == 0 or at + STRIP >= len(p.x) or sum(c.shape[1] for c in columns) > 1 << 21:
            found = np.concatenate(columns, axis=1)
            found = found[:, least_pairs(found[1], found[0], found[2], k)]
            columns = [found]
            who, n = np.unique(found[1].astype("i8"), return_counts=True)
            until[who[n == k]] = found[2][(np.cumsum(n) - 1)[n == k]] ** 2
    found = columns[0]
    return [np.concatenate(c) for c in zip(*rows)], (found[0].astype("i8"), found[1].astype("i8"), found[2])


def highest(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` highest of each row, highest first, equal ones from the left."""
    n = min(k, sims.shape[1])
    if n == 0:
        return np.zeros((len(sims), 0), "i8")
    if n < sims.shape[1] // 4 and not np.isnan(sims).any():
        # Ties with the last place must not be cut in any order: rows that have some are sorted whole.
        some = np.sort(np.argpartition(sims, -n, axis=1)[:, -n:], axis=1)
        values = np.take_along_axis(sims, some, 1)
        order = np.take_along_axis(some, np.argsort(-values, axis=1, kind="stable"), 1)
        tied = np.flatnonzero((sims >= values.min(1, keepdims=True)).sum(1) > n)
        if len(tied):
            order[tied] = np.argsort(-sims[tied], axis=1, kind="stable")[:, :n]
        return order
    return np.argsort(-sims, axis=1, kind="stable")[:, :n]


MEASURES = {"cosine": cosines, "euclidean": straight}


def scan(vecs: DataFrame, k: int, near: float | None = None, block: int = BLOCK, measure: str = "cosine") -> DataFrame:
    """slice, word, neighbour, sim, close: of each pair of blocks the ``k`` most similar a word, and rows without neighbour that count those above ``near``.

    Each pair is multiplied once and tells both sides, in strips of ``STRIP``
    rows, so that a task holds a strip's similarities and not those of two
    blocks. What is shuffled afterwards is ``k`` rows a word and block. Rows with
    a null vector take no part.
    """
    alike = MEASURES[measure]

    def told(name: str, words: np.ndarray, others: np.ndarray, order: np.ndarray, values: np.ndarray, close: np.ndarray) -> pd.DataFrame:
        values, n = values.ravel(), order.shape[1]
        found = np.isfinite(values)
        columns = {"word": np.repeat(words, n)[found], "neighbour": others[order.ravel()][found], "sim": values[found], "close": np.zeros(found.sum(), "i8")}
        if near is not None:
            more = {"word": words, "neighbour": np.full(len(words), None), "sim": np.full(len(words), np.nan), "close": close}
            columns = {c: np.concatenate([v, more[c]]) for c, v in columns.items()}
        return pd.DataFrame({"slice": name} | columns)

    def best(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("slice", str), ("word", str), ("neighbour", str), ("sim", float), ("close", "int64"))})
        # In order of words, so that the first of equals is the one to take.
        a, b = a.sort_values("word", kind="stable"), b.sort_values("name", kind="stable")
        words, names, both, out = a["word"].to_numpy(), b["name"].to_numpy(), key[1] != key[2], []
        if measure == "euclidean" and near is None and k:
            place = {w: q for q, w in enumerate(names)}
            if len(place) == len(names) and (found := nearest_pairs(a["vec"], b["values"], np.array([place.get(w, -1) for w in words]), k, both)) is not None:
                sides = [(words, names, found[0])] + ([(names, words, (found[1][1], found[1][0], found[1][2]))] if both else [])
                return pd.concat([pd.DataFrame({"slice": key[0], "word": left[i], "neighbour": right[j], "sim": -d, "close": 0}) for left, right, (i, j, d) in sides])
        order, values, close = np.zeros((len(b), 0), "i8"), np.zeros((len(b), 0)), np.zeros(len(b), "i8")
        for at in range(0, len(a), STRIP):
            own = words[at : at + STRIP]
            sims = alike(a["vec"].iloc[at : at + STRIP], b["values"])
            sims[own[:, None] == names[None, :]] = -np.inf
            top = highest(sims, k)
            out.append(told(key[0], own, names, top, np.take_along_axis(sims, top, 1), (sims > (np.inf if near is None else near)).sum(1)))
            if both:
                # The other side keeps its best so far.
                top = highest(sims.T, k)
                order, values = np.hstack([order, top + at]), np.hstack([values, np.take_along_axis(sims.T, top, 1)])
                kept = highest(values, k)
                order, values = np.take_along_axis(order, kept, 1), np.take_along_axis(values, kept, 1)
                close += (sims > (np.inf if near is None else near)).sum(0)
        return pd.concat(out + [told(key[0], names, words, order, values, close)] if both else out)

    return block_pairs(vecs.where(F.col("vec").isNotNull()), block).applyInPandas(best, SCAN)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """slice, word, neighbour, sim, rank (from 1) of what ``scan`` found; ties by word."""
    order = Window.partitionBy("slice", "word").orderBy(F.desc("sim"), "neighbour")
    return found.where("neighbour is not null").drop("close").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def counted(found: DataFrame) -> DataFrame:
    """slice, word, close of what ``scan`` found."""
    return found.where("neighbour is null").groupBy("slice", "word").agg(F.sum("close").alias("close"))


def neighbours(vecs: DataFrame, k: int, block: int = BLOCK, measure: str = "cosine") -> DataFrame:
    """slice, word, neighbour, sim, rank (from 1): the ``k`` most similar words of each word in its slice, itself left out, ties by word."""
    return ranked(scan(vecs, k, None, block, measure), k)


def close_counts(vecs: DataFrame, near: float = 0.5, block: int = BLOCK) -> DataFrame:
    """slice, word, close: how many other words of the slice have a cosine above ``near``."""
    return counted(scan(vecs, 0, near, block))


def nearest_of(points: DataFrame, ground: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """id, neighbour, sim, rank: the ``k`` words of ``ground`` (word, vec) nearest to each of ``points`` (id, vec) by cosine, the point's own word included."""
    blocks = lambda df, c: df.where("vec is not null").select(c, "vec", F.pmod(F.xxhash64(c), F.lit(max(1, -(-df.count() // block)))).cast("int").alias("b"))
    a, b = blocks(points, "id"), blocks(ground, "word")
    n_a, n_b = (df.agg(F.max("b")).first()[0] for df in (a, b))
    if n_a is None or n_b is None:
        return points.sparkSession.createDataFrame([], "id string, neighbour string, sim double, rank int")
    left = a.select("id", "vec", F.col("b").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n_b))).alias("j"))
    right = b.select("word", F.col("vec").alias("values"), F.explode(F.sequence(F.lit(0), F.lit(n_a))).alias("i"), F.col("b").alias("j"))

    def best(key, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"id": pd.Series(dtype=str), "neighbour": pd.Series(dtype=str), "sim": pd.Series(dtype=float)})
        y = y.sort_values("word", kind="stable")
        names, out = y["word"].to_numpy(), []
        for at in range(0, len(x), STRIP):
            strip = x.iloc[at : at + STRIP]
            sims = cosines(strip["vec"], y["values"])
            order = highest(sims, k)
            out.append(pd.DataFrame({"id": np.repeat(strip["id"].to_numpy(), order.shape[1]), "neighbour": names[order.ravel()], "sim": np.take_along_axis(sims, order, 1).ravel()}))
        return pd.concat(out)

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(best, "id string, neighbour string, sim double")
    order = Window.partitionBy("id").orderBy(F.desc("sim"), "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn_graph(vecs: DataFrame, words: DataFrame, k: int = 10, knn: DataFrame | None = None) -> DataFrame:
    """slice, u, v (u < v), weight: undirected edges between the given words.

    Candidates are the 2 k nearest of the whole slice, of which up to ``k``
    within ``words`` count; the weight is the similarity, 0 at least.
    """
    knn = neighbours(vecs, 2 * k) if knn is None else knn
    chosen = words.select("word").distinct()
    inside = knn.where(F.col("rank") <= 2 * k).join(chosen, "word", "left_semi").join(chosen.select(F.col("word").alias("neighbour")), "neighbour", "left_semi")
    order = Window.partitionBy("slice", "word").orderBy("rank")
    top = inside.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k)
    edges = top.select("slice", F.least("word", "neighbour").alias("u"), F.greatest("word", "neighbour").alias("v"), F.greatest("sim", F.lit(0.0)).alias("weight"))
    return edges.groupBy("slice", "u", "v").agg(F.max("weight").alias("weight"))
