"""A map of words in few dimensions that keeps neighbours together (after McInnes, Healy and Melville, 2018), of all slices at once.

Distances to the nearest neighbours become weights between 0 and 1, by a
bandwidth searched for each point. Points are then moved: towards neighbours,
as often as their weight says, and away from points drawn at random. Points are
dealt to parts by a hash; a part moves its own points for some epochs against
the others' last known places, then places are exchanged through a table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexdrift.lineage import cut, drop
from lexdrift.operators import knn
from lexdrift.operators.align import fit_pca_by, project_by

#: Points that one part moves, and points that it is pushed away from in a round.
PART, OTHERS = 2048, 512
WEIGHTS = "slice string, word string, neighbour string, weight double"


def bandwidth(d: np.ndarray, rounds: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(rho, sigma) of rows of distances: the least positive one, and the width at which exp(-(d - rho) / sigma) sums to log2 of their number. Absent distances are NaN."""
    rho = np.nan_to_num(np.nanmin(np.where(d > 0, d, np.inf), axis=1, initial=np.inf), posinf=0.0)
    goal = np.log2(np.maximum((~np.isnan(d)).sum(1), 2))
    over = np.maximum(d - rho[:, None], 0)
    low, high, sigma = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    for _ in range(rounds):
        much = np.nansum(np.exp(-over / sigma[:, None]), axis=1) > goal
        high, low = np.where(much, sigma, high), np.where(much, low, sigma)
        sigma = np.where(np.isinf(high), sigma * 2, (low + np.where(np.isinf(high), 0, high)) / 2)
    # No narrower than a thousandth of the mean distance, where neighbours are copies.
    return rho, np.maximum(sigma, 1e-3 * np.nan_to_num(np.nanmean(np.where(np.isnan(d), 0.0, d), axis=1)) + 1e-12)


def weighted_neighbours(near: DataFrame) -> DataFrame:
    """slice, word, neighbour, weight of ranked neighbours (sim: cosine); a word's are weighted together."""
    lists = near.groupBy("slice", "word").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour", "sim"))).alias("near"))

    def weigh(frames):
        for frame in frames:
            k = max(map(len, frame["near"]), default=0)
            d = np.full((len(frame), k), np.nan)
            for r, row in enumerate(frame["near"]):
                d[r, : len(row)] = [max(0.0, 1 - x["sim"]) for x in row]
            rho, sigma = bandwidth(d)
            w = np.exp(-np.maximum(d - rho[:, None], 0) / sigma[:, None])
            yield pd.DataFrame([(s, word, x["neighbour"], float(w[r, q])) for r, (s, word, row) in enumerate(zip(frame["slice"], frame["word"], frame["near"])) for q, x in enumerate(row)], columns=["slice", "word", "neighbour", "weight"])

    return lists.mapInPandas(weigh, WEIGHTS)


def fuzzy_edges(near: DataFrame) -> DataFrame:
    """slice, u, v, weight in both directions: a + b - a b of the two ends' weights."""
    rows = weighted_neighbours(near).select("slice", F.least("word", "neighbour").alias("u"), F.greatest("word", "neighbour").alias("v"), "weight")
    joint = rows.groupBy("slice", "u", "v").agg((F.sum("weight") - F.when(F.count(F.lit(1)) == 2, F.product("weight")).otherwise(0.0)).alias("weight"))
    return joint.unionByName(joint.select("slice", F.col("v").alias("u"), F.col("u").alias("v"), "weight"))


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """(a, b) for which 1 / (1 + a x^2b) comes closest to 1 up to ``min_dist`` and an exponential fall beyond, by Gauss-Newton steps."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    want = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    p = np.array([1.5, 0.9])
    for _ in range(100):
        power = x ** (2 * p[1])
        got = 1 / (1 + p[0] * power)
        slopes = np.stack([-power * got**2, -2 * p[0] * power * np.log(x) * got**2], 1)
        p = np.maximum(p + 0.5 * np.linalg.lstsq(slopes, want - got, rcond=None)[0], 1e-2)
    return float(p[0]), float(p[1])


def moves(a: float, b: float, dims: int, epochs: int, total: int, pushes: int, seed: int):
    """For a part of one slice: rows of own points (kind 0: word, place), of edges (kind 1: word, other, weight, the other's place) and of points to keep away from (kind 2)."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        name, part, turn = key[0], key[1], int(rows["turn"].iloc[0])
        rows = rows.sort_values(["kind", "word", "other"], kind="stable")
        own, edges, away = (rows[rows["kind"] == q] for q in range(3))
        if own.empty:
            return pd.DataFrame({"slice": pd.Series(dtype=str), "word": pd.Series(dtype=str), "place": pd.Series(dtype=object)})
        number = {w: q for q, w in enumerate(own["word"])}
        x = np.stack(own["place"].to_numpy()).astype("f8")
        # Places of others stand after the own ones and stay where they are.
        others = edges[~edges["other"].isin(number)].drop_duplicates("other")
        number.update((w, len(x) + q) for q, w in enumerate(others["other"]))
        far = away[~away["word"].isin(number)]
        number.update((w, len(x) + len(others) + q) for q, w in enumerate(far["word"]))
        fixed = [np.stack(f["place"].to_numpy()).astype("f8") for f in (others, far) if len(f)]
        n, x = len(x), np.concatenate([x, *fixed])
        u, v = edges["word"].map(number).to_numpy("i8"), edges["other"].map(number).to_numpy("i8")
        chance = edges["weight"].to_numpy("f8")
        chance = chance / chance.max() if len(chance) else chance
        pool = np.array(sorted(number[w] for w in away["word"]), "i8")
        rng = np.random.default_rng([seed, turn, int(part), n])
        for epoch in range(epochs):
            rate = 1 - (turn * epochs + epoch) / total
            drawn = rng.permutation(np.flatnonzero(rng.random(len(u)) < chance))
            for own_edges in np.array_split(drawn, max(1, min(16, len(drawn) // 8))):
                i, j = u[own_edges], v[own_edges]
                gap = x[i] - x[j]
                d2 = (gap * gap).sum(1, keepdims=True)
                pull = np.where(d2 > 0, -2 * a * b * np.maximum(d2, 1e-12) ** (b - 1) / (1 + a * d2**b), 0) * gap
                step = np.clip(pull, -4, 4)
                if len(pool):
                    q = pool[rng.integers(0, len(pool), (len(i), pushes))]
                    gap = x[i][:, None] - x[q]
                    d2 = (gap * gap).sum(2, keepdims=True)
                    push = 2 * b / ((1e-3 + d2) * (1 + a * d2**b)) * gap
                    step = step + np.where((q == i[:, None])[..., None], 0, np.clip(push, -4, 4)).sum(1)
                np.add.at(x, i, rate * step)
        return pd.DataFrame({"slice": name, "word": own["word"].to_numpy(), "place": list(x[:n])})

    return run


def layout(edges: DataFrame, start: DataFrame, dims: int = 2, min_dist: float = 0.1, epochs: int = 200, exchange: int = 10, pushes: int = 5, part: int = PART, seed: int = 42) -> DataFrame:
    """slice, word, place after ``epochs`` epochs from ``start`` (slice, word, place); places are exchanged after every ``exchange`` of them."""
    a, b = curve(min_dist)
    counts = start.groupBy("slice").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    known = cut(start.join(F.broadcast(counts), "slice").select("slice", "word", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int").alias("part"), "parts"), "parts")
    ties = cut(edges.join(known.select("slice", F.col("word").alias("u"), "part"), ["slice", "u"]).select("slice", "part", F.col("u").alias("word"), F.col("v").alias("other"), "weight"), "ties")
    now = cut(start.select("slice", "word", "place", F.lit(0).alias("turn")), "places")
    many = start.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    run = moves(a, b, dims, exchange, -(-epochs // exchange) * exchange, pushes, seed)
    for _ in range(-(-epochs // exchange)):
        own = now.join(known, ["slice", "word"]).select("slice", "part", F.lit(0).alias("kind"), "word", F.lit("").alias("other"), F.lit(0.0).alias("weight"), "place", "turn")
        there = now.select("slice", F.col("word").alias("other"), "place", "turn")
        tied = ties.join(there, ["slice", "other"]).select("slice", "part", F.lit(1).alias("kind"), "word", "other", "weight", "place", "turn")
        # About OTHERS points of a slice by hash, other ones in each round, are known to all its parts.
        some = now.join(F.broadcast(many), "slice").join(F.broadcast(counts), "slice").where(F.pmod(F.xxhash64("word", "turn"), F.greatest(F.lit(1), F.ceil(F.col("n") / OTHERS))) == 0)
        some = some.select("slice", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(2).alias("kind"), "word", F.lit("").alias("other"), F.lit(0.0).alias("weight"), "place", "turn")
        moved = own.unionByName(tied).unionByName(some).groupBy("slice", "part").applyInPandas(run, "slice string, word string, place array<double>")
        held, now = now, cut(moved.join(now.select("slice", "word", "turn"), ["slice", "word"]).select("slice", "word", "place", (F.col("turn") + 1).alias("turn")), "places")
        drop(held)
    drop(known, ties)
    return now.select("slice", "word", "place")


def neighbour_map(vecs: DataFrame, dims: int = 2, k: int = 15, min_dist: float = 0.1, epochs: int = 200, exchange: int = 10, seed: int = 42, near: DataFrame | None = None, part: int = PART) -> DataFrame:
    """slice, word, place (``dims`` coordinates) of each slice's words (slice, word, vec) by cosine distance.

    Places start at the first principal components, drawn out to 10, a slice's
    own. Runs with one seed and one ``part`` are equal. A word without
    neighbours stays at its start; rows with a null vector take no part.
    """
    vecs = vecs.where("vec is not null").select("slice", "word", "vec")
    near = knn.neighbours(vecs, k) if near is None else near.where(F.col("rank") <= k)
    edges = cut(fuzzy_edges(near), "edges")
    first = cut(project_by(vecs, fit_pca_by(vecs, dims), dims), "start")
    reach = first.groupBy("slice").agg(F.max(F.array_max(F.transform("vec", lambda c: F.abs(c)))).alias("reach"))
    start = first.join(F.broadcast(reach), "slice").select("slice", "word", F.transform("vec", lambda c: F.when(F.col("reach") > 0, c / F.col("reach") * 10).otherwise(0.0)).alias("place"))
    # A little noise by hash keeps equal vectors from one place.
    noise = lambda i: (F.xxhash64("word", F.lit(seed), i) % 1000) / 1e6
    return layout(edges, start.withColumn("place", F.transform("place", lambda c, i: c + noise(i))), dims, min_dist, epochs, exchange, 5, part, seed)


def place_words(points: DataFrame, ground: DataFrame, places: DataFrame, k: int = 15) -> DataFrame:
    """id, place of new vectors (id, vec) on the map of ``ground`` (word, vec) at ``places`` (word, place): the mean of their nearest words' places, by weight."""
    near = cut(knn.nearest_of(points, ground, k).select(F.lit("").alias("slice"), F.col("id").alias("word"), "neighbour", "sim", "rank"), "near")
    rows = weighted_neighbours(near).join(places.select(F.col("word").alias("neighbour"), "place"), "neighbour").select("word", "weight", F.posexplode("place").alias("i", "x"))
    sums = rows.groupBy("word", "i").agg((F.sum(F.col("weight") * F.col("x")) / F.sum("weight")).alias("x"))
    return sums.groupBy(F.col("word").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("place"))
