"""Clusters of dense points with noise: mutual reachability, a minimum spanning forest by joins, the condensed tree, the most stable clusters (Campello et al., 2013)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexdrift.lineage import cut, drop
from lexdrift.operators import knn

#: The least distance that the tree tells from none; its inverse bounds densities.
LEAST = 1e-10
#: Edges of the forest that one task folds at a time.
FOLD = 200_000
#: Points of a block: few and large ones, as each block a point meets gives a list to merge.
BLOCK = 4 * knn.BLOCK
EDGE = "struct<w:double,lo:string,hi:string>"
FOLDED = "slice string, kind string, a string, b string, size long, density double, below double, chosen boolean"
STATE = "slice string, comp string, size long, cluster string, density double, below double"


def core_distances(near: DataFrame, min_samples: int, k: int) -> DataFrame:
    """slice, word, core, bound: the distance at which a point has ``min_samples`` points, itself counted; no edge that its list of ``k`` lacks is shorter than ``bound``."""
    listed = near.groupBy("slice", "word").agg(F.max(F.when(F.col("rank") <= min_samples - 1, F.col("dist"))).alias("core"), F.max("dist").alias("last"), F.count(F.lit(1)).alias("n"))
    core = F.coalesce("core", F.lit(0.0))
    return listed.select("slice", "word", core.alias("core"), F.when(F.col("n") >= k, F.greatest(core, F.col("last"))).alias("bound"))


def edge(w: Column, a: str, b: str) -> Column:
    """An edge with its weight first, its ends in order: edges of equal weight are ordered too, so that a forest has no circle."""
    return F.struct(w.alias("w"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


def spanning_forest(points: DataFrame, min_samples: int = 5, k: int = 16, block: int = BLOCK) -> DataFrame:
    """slice, lo, hi, w: the minimum spanning tree of each slice's points (slice, word, vec) by mutual reachability distance.

    Rounds after Boruvka: every component takes its least edge to another one.
    Lists of ``k`` neighbours give it, unless an edge that they lack could be
    shorter; only then are the points in question compared with all others, in
    pairs of blocks. The edge that a point gets so is added to its list, and
    bounds what the list lacks from then on, as components only grow. Edges
    within a component are left out of later rounds. Components are merged by
    pointer jumping. What is held between rounds are tables.
    """
    k = max(k, min_samples)
    near = cut(knn.neighbours(points, k, block, "euclidean").select("slice", "word", "neighbour", (-F.col("sim")).alias("dist"), "rank"), "near")
    core = cut(points.select("slice", "word").join(core_distances(near, min_samples, k), ["slice", "word"], "left").select("slice", "word", F.coalesce("core", F.lit(0.0)).alias("core"), "bound"), "core")
    there = core.select("slice", F.col("word").alias("neighbour"), F.col("core").alias("other"))
    listed = cut(near.join(core.select("slice", "word", "core"), ["slice", "word"]).join(there, ["slice", "neighbour"]).select("slice", F.col("word").alias("u"), F.col("neighbour").alias("v"), F.greatest("core", "other", "dist").alias("w")), "reach")
    drop(near)
    labels, forest, parts = cut(core.select("slice", "word", F.col("word").alias("comp")), "components"), None, [listed]
    while True:
        ends = [labels.select("slice", F.col("word").alias(x), F.col("comp").alias(f"c{x}")) for x in "uv"]
        out = cut(listed.join(ends[0], ["slice", "u"]).join(ends[1], ["slice", "v"]).where("cu <> cv"), "reach")
        drop(*parts)
        listed, parts = out.select("slice", "u", "v", "w"), [out]
        best_of = lambda rows: rows.groupBy("slice", "comp").agg(F.min_by(F.struct("e", "to"), F.col("e")).alias("x")).select("slice", "comp", "x.e", "x.to")
        known = best_of(out.select("slice", F.col("cu").alias("comp"), edge(F.col("w"), "u", "v").alias("e"), F.col("cv").alias("to")))
        several = labels.groupBy("slice").agg(F.countDistinct("comp").alias("n")).where("n > 1").select("slice")
        known = cut(labels.join(several, "slice", "left_semi").select("slice", "comp").distinct().join(known, ["slice", "comp"], "left"), "least")
        unsure = core.join(labels, ["slice", "word"]).join(known.select("slice", "comp", "e"), ["slice", "comp"]).where("bound <= coalesce(e.w, double('infinity'))").select("slice", "word", "comp")
        chosen = known.where("e is not null")
        if not unsure.isEmpty():
            seen = cut(outside(points, core, labels, unsure, block), "outside")
            held, known = [known, core], cut(best_of(chosen.unionByName(seen.select("slice", "comp", "e", "to"))), "least")
            own = seen.groupBy("slice", "word").agg(F.min("e").alias("e"))
            listed, parts = listed.unionByName(own.select("slice", F.col("word").alias("u"), F.when(F.col("word") == F.col("e.lo"), F.col("e.hi")).otherwise(F.col("e.lo")).alias("v"), "e.w")), [*parts, seen]
            core = cut(core.join(own, ["slice", "word"], "left").select("slice", "word", "core", F.greatest("bound", "e.w").alias("bound")), "core")
            drop(*held)
            chosen = known
        if chosen.isEmpty():
            drop(labels, known, core, *parts)
            return forest if forest is not None else points.sparkSession.createDataFrame([], "slice string, lo string, hi string, w double")
        step = chosen.select("slice", "e.lo", "e.hi", "e.w").distinct()
        held, forest = forest, cut(step if forest is None else forest.unionByName(step), "forest")
        held_labels, labels = labels, cut(merged(labels, chosen), "components")
        drop(held_labels, known, *([held] if held is not None else []))


def outside(points: DataFrame, core: DataFrame, labels: DataFrame, unsure: DataFrame, block: int) -> DataFrame:
    """slice, word, comp, e, to: the least edges of each unsure point to points of other components, one from each pair of blocks."""
    told = points.select("slice", "word", "vec").join(core.select("slice", "word", "core"), ["slice", "word"]).join(labels, ["slice", "word"])
    counts = points.groupBy("slice").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    told = told.join(F.broadcast(counts), "slice").withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = told.join(unsure.select("slice", "word"), ["slice", "word"], "left_semi").select("slice", "word", "vec", "core", "comp", F.col("own").alias("i"), every.alias("j"))
    # New names keep the two sides of one table apart.
    right = told.select(F.col("slice").alias("in"), F.col("word").alias("name"), F.col("vec").alias("values"), F.col("core").alias("radius"), F.col("comp").alias("group"), F.col("own").alias("by"), every.alias("of"))

    def least(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(a) and len(b):
            comps, names, words, groups = a["comp"].to_numpy(), b["name"].to_numpy(), a["word"].to_numpy(), b["group"].to_numpy()
            cores, radii = a["core"].to_numpy("f8"), b["radius"].to_numpy("f8")
            codes = pd.factorize(np.concatenate([comps, groups]))[0]
            codes, others = codes[: len(a)], codes[len(a) :]
            p = knn.Products(a["vec"], b["values"])
            widest = np.maximum(cores.max(), radii.max()) ** 2
            by_products = p.finite() and widest < 1e300
            slack = np.maximum(p.slack, 32 * np.finfo("f8").eps * widest)
            for at in range(0, len(a), knn.STRIP):
                own = slice(at, at + knn.STRIP)
                if by_products:
                    w = np.maximum(np.maximum(p.squares(at, knn.STRIP), radii**2), cores[own, None] ** 2)
                else:
                    w = (-knn.straight(a["vec"].iloc[own], b["values"])).clip(min=radii[None, :]).clip(min=cores[own, None])
                w[codes[own, None] == others[None, :]] = np.inf
                # Products tell which pairs may be the least; what they weigh comes from differences.
                i, j = np.nonzero((w <= w.min(1, keepdims=True) + (slack if by_products else 0)) & (w < np.inf))
                x = np.maximum(np.maximum(p.straight(i + at, j), radii[j]), cores[i + at]) if by_products else w[i, j]
                starts = np.flatnonzero(np.diff(i, prepend=-1))
                if not len(starts):
                    continue
                low = np.minimum.reduceat(x, starts)
                equal = np.flatnonzero(x == np.repeat(low, np.diff(starts, append=len(i))))
                i, j, x = i[equal], j[equal], x[equal]
                starts = np.flatnonzero(np.diff(i, prepend=-1))
                for f, t in zip(starts, [*starts[1:], len(i)]):
                    u = words[i[f] + at]
                    # Of equal edges the one that is least by its ends.
                    q = min(j[f:t].tolist(), key=lambda q: (min(u, names[q]), max(u, names[q])))
                    rows.append((key[0], u, comps[i[f] + at], float(x[f]), min(u, names[q]), max(u, names[q]), groups[q]))
        return pd.DataFrame(rows, columns=["slice", "word", "comp", "w", "lo", "hi", "to"])

    found = left.groupBy("slice", "i", "j").cogroup(right.groupBy("in", "of", "by")).applyInPandas(least, "slice string, word string, comp string, w double, lo string, hi string, to string")
    return found.select("slice", "word", "comp", F.struct("w", "lo", "hi").cast(EDGE).alias("e"), "to")


def merged(labels: DataFrame, chosen: DataFrame) -> DataFrame:
    """``labels`` after each component joined the one that its chosen edge leads to; of two that chose each other the smaller name stays."""
    step = cut(labels.select("slice", "comp").distinct().join(chosen.select("slice", "comp", "to"), ["slice", "comp"], "left").select("slice", "comp", F.coalesce("to", "comp").alias("to")), "pointers")
    back = step.select("slice", F.col("comp").alias("to"), F.col("to").alias("further"))
    held, step = step, cut(step.join(back, ["slice", "to"]).select("slice", "comp", F.when((F.col("further") == F.col("comp")) & (F.col("comp") < F.col("to")), F.col("comp")).otherwise(F.col("to")).alias("to")), "pointers")
    drop(held)
    step = roots(step)
    return labels.join(step, ["slice", "comp"]).select("slice", "word", F.col("to").alias("comp"))


def roots(step: DataFrame) -> DataFrame:
    """Pointers (slice, comp, to) followed to their ends, twice as far a round."""
    while True:
        back = step.select("slice", F.col("comp").alias("to"), F.col("to").alias("further"))
        further = cut(step.join(back, ["slice", "to"]).select("slice", "comp", F.col("further").alias("to"), (F.col("further") != F.col("to")).alias("went")), "pointers")
        on = not further.where("went").isEmpty()
        drop(step)
        step = further.drop("went")
        step._lexdrift_path = further._lexdrift_path
        if not on:
            return step


def fold(min_size: int):
    """For one slice and one range of weights: edges between components, from the shortest on, and what is known of those components.

    A component of fewer than ``min_size`` points is no cluster yet. The first
    merge that reaches that size begins one, smaller ones that join later fall
    to it, and where two clusters meet both end and a larger one begins. A
    cluster's stability is the sum over its points of the density at which each
    left it, less that at which it began. Rows: ``fell`` (component a belongs
    to cluster b), ``ended`` (cluster a within b, chosen: more stable than what
    is below it), ``now`` (component a is part of b) and ``state``.
    """

    def run(key, edges: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        name, rows = key[0], []
        state = {r.comp: [r.size, r.cluster, r.density, r.below] for r in known.itertuples(index=False)}
        up: dict[str, str] = {}
        loose: dict[str, list[str]] = {}

        def find(x: str) -> str:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def at(x: str) -> list:
            if x not in state:
                state[x] = [1, None, 0.0, 0.0]
            if state[x][1] is None and x not in loose:
                loose[x] = [x]
            return state[x]

        for w, lo, hi, cu, cv in edges.sort_values(["w", "lo", "hi"], kind="stable")[["w", "lo", "hi", "cu", "cv"]].itertuples(index=False, name=None):
            a, b = sorted((find(cu), find(cv)))
            one, two = at(a), at(b)
            density, size = 1 / max(w, LEAST), one[0] + two[0]
            if one[1] is not None and two[1] is not None:
                cluster, below = f"{lo}\t{hi}", 0.0
                for s in (one, two):
                    stable = s[2] - density * s[0]
                    rows.append((name, "ended", s[1], cluster, s[0], stable, s[3], stable >= s[3]))
                    below += max(stable, s[3])
                new = [size, cluster, density * size, below]
            elif one[1] is not None or two[1] is not None:
                big, small, which = (one, two, b) if one[1] is not None else (two, one, a)
                rows.extend((name, "fell", c, big[1], None, None, None, None) for c in loose.pop(which))
                new = [size, big[1], big[2] + density * small[0], big[3]]
            elif size >= min_size:
                cluster = f"{lo}\t{hi}"
                rows.extend((name, "fell", c, cluster, None, None, None, None) for x in (a, b) for c in loose.pop(x))
                new = [size, cluster, density * size, 0.0]
            else:
                new = [size, None, 0.0, 0.0]
                loose[a] = loose[a] + loose.pop(b)
            up[b] = a
            state[a] = new
            state.pop(b)
        for c in list(up):
            rows.append((name, "now", c, find(c), None, None, None, None))
        rows.extend((name, "state", c, s[1], s[0], s[2], s[3], None) for c, s in state.items())
        return pd.DataFrame(rows, columns=["slice", "kind", "a", "b", "size", "density", "below", "chosen"])

    return run


def condensed_tree(points: DataFrame, forest: DataFrame, min_size: int, most: int = FOLD) -> tuple[DataFrame, DataFrame]:
    """(slice, word, cluster that the point left last; slice, cluster, parent, chosen) of the forest's edges.

    Edges are folded from the shortest on in ranges of weight of about ``most``;
    after each range points and components are relabelled by joins.
    """
    bounds = forest.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("w", F.array(*[F.lit(q / 64) for q in range(65)]), 100_000).alias("marks"))
    # Every 64th part of the weights may begin a range; as few as ``most`` allows do.
    step = F.greatest(F.lit(1), F.floor(F.lit(64 * most) / F.col("n")))
    part = F.size(F.filter("marks", lambda m: m < F.col("w")))
    rows = cut(forest.join(F.broadcast(bounds), "slice").select("slice", "lo", "hi", "w", F.floor(F.greatest(part - 1, F.lit(0)) / step).cast("int").alias("part")), "ranges")
    labels = cut(points.select("slice", "word", F.col("word").alias("comp"), F.lit(None).cast("string").alias("cluster")), "labels")
    state, ended = cut(points.sparkSession.createDataFrame([], STATE), "state"), None
    for r in rows.select("part").distinct().orderBy("part").collect():
        ends = [labels.select("slice", F.col("word").alias(x), F.col("comp").alias(c)) for x, c in (("lo", "cu"), ("hi", "cv"))]
        now = rows.where(F.col("part") == r.part).join(ends[0], ["slice", "lo"]).join(ends[1], ["slice", "hi"]).select("slice", "w", "lo", "hi", "cu", "cv")
        now = cut(now, "edges")
        met = now.select("slice", F.col("cu").alias("comp")).unionByName(now.select("slice", F.col("cv").alias("comp"))).distinct()
        known = state.join(met, ["slice", "comp"], "left_semi").withColumnRenamed("slice", "in")
        told = cut(now.groupBy("slice").cogroup(known.groupBy("in")).applyInPandas(fold(min_size), FOLDED), "folded")
        of = lambda kind: told.where(F.col("kind") == kind)
        moves, falls = of("now").select("slice", F.col("a").alias("comp"), F.col("b").alias("new")), of("fell").select("slice", F.col("a").alias("comp"), F.col("b").alias("fell"))
        held = [labels, state, now]
        labels = cut(labels.join(moves, ["slice", "comp"], "left").join(falls, ["slice", "comp"], "left").select("slice", "word", F.coalesce("new", "comp").alias("comp"), F.when(F.col("cluster").isNull(), F.col("fell")).otherwise(F.col("cluster")).alias("cluster")), "labels")
        state = cut(state.join(met, ["slice", "comp"], "left_anti").unionByName(of("state").select("slice", F.col("a").alias("comp"), "size", F.col("b").alias("cluster"), "density", "below")), "state")
        drop(*held)
        step_ended = of("ended").select("slice", F.col("a").alias("cluster"), F.col("b").alias("parent"), "chosen")
        ended = step_ended if ended is None else ended.unionByName(step_ended)
    roots_of = state.where("cluster is not null").select("slice", "cluster", F.lit(None).cast("string").alias("parent"), F.lit(False).alias("chosen"))
    tree = cut(roots_of if ended is None else roots_of.unionByName(ended), "tree")
    drop(rows)
    return labels.select("slice", "word", "cluster"), tree


def highest_chosen(tree: DataFrame) -> DataFrame:
    """slice, cluster, top: the highest chosen cluster at or above each; null where there is none. Ancestors are followed twice as far a round."""
    now = cut(tree.select("slice", "cluster", "parent", F.when(F.col("chosen"), F.col("cluster")).alias("top")), "tops")
    while not now.where("parent is not null").isEmpty():
        above = now.select("slice", F.col("cluster").alias("parent"), F.col("parent").alias("next"), F.col("top").alias("higher"))
        held, now = now, cut(now.join(above, ["slice", "parent"], "left").select("slice", "cluster", F.col("next").alias("parent"), F.coalesce("higher", "top").alias("top")), "tops")
        drop(held)
    return now.select("slice", "cluster", "top")


def density_clusters(points: DataFrame, min_cluster_size: int = 15, min_samples: int | None = None, k: int = 16, block: int = BLOCK, most: int = FOLD) -> DataFrame:
    """slice, word, cluster (from 0 by smallest member; -1: noise) of points (slice, word, vec) by straight distance, all slices at once.

    ``min_samples`` counts the point itself and is ``min_cluster_size`` by
    default. The root is no cluster, so a slice without inner structure is all
    noise. Points nearer than 1e-10 count as that far apart; rows with a null
    vector take no part.
    """
    if min_cluster_size < 2:
        raise ValueError("a cluster has two points at least")
    points = points.where("vec is not null").select("slice", "word", "vec")
    forest = spanning_forest(points, min_samples or min_cluster_size, k, block)
    left, tree = condensed_tree(points, forest, min_cluster_size, most)
    found = left.join(highest_chosen(tree), ["slice", "cluster"], "left")
    order = Window.partitionBy("slice").orderBy("first")
    numbers = found.where("top is not null").groupBy("slice", "top").agg(F.min("word").alias("first")).withColumn("n", F.row_number().over(order) - 1)
    return found.join(numbers.select("slice", "top", "n"), ["slice", "top"], "left").select("slice", "word", F.coalesce("n", F.lit(-1)).cast("int").alias("cluster"))
