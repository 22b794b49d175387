"""Maps that keep neighbours, and communities against the plain algorithm."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexdrift.operators import communities, kernels, knn, landscape
from lexdrift.plans import fixtures as fx
from lexdrift.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"


def trustworthiness(x, y, k=5):
    """Share of map neighbours that are near in truth, by rank (Venna and Kaski, 2001)."""
    n = len(x)
    u = kernels.unit_matrix(x)
    ranks = np.argsort(np.argsort(1 - u @ u.T - 9 * np.eye(n), 1), 1)
    d = ((y[:, None] - y[None]) ** 2).sum(-1) - 9 * np.eye(n)
    near = np.argsort(d, 1)[:, 1 : k + 1]
    worse = sum(max(0, ranks[i, j] - k) for i in range(n) for j in near[i])
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * worse


def test_map_keeps_neighbours(spark):
    """On a bent sheet nearly all; on vectors without a plane structure far more than principal components do. Several parts exchange places."""
    rng = np.random.default_rng(4)
    at = rng.uniform(-1, 1, (300, 2)) @ rng.normal(size=(2, 12)) * 0.9
    sheet = spark.createDataFrame([("sheet", f"p{q:03d}", v) for q, v in enumerate(np.concatenate([np.sin(at), np.cos(at)], 1).tolist())], "slice string, word string, vec array<double>")
    vecs = fx.slice_vectors(spark, DATA).where("slice < 'y2002'").withColumn("vec", F.transform("vec", lambda c: c.cast("double"))).unionByName(sheet)
    got = landscape.neighbour_map(vecs, part=100).toPandas()
    truth = vecs.toPandas()
    assert len(got) == len(truth)
    for name in truth["slice"].unique():
        x, y = (np.stack(df[df["slice"] == name].sort_values("word")[c]) for df, c in ((truth, "vec"), (got, "place")))
        flat = (x - x.mean(0)) @ np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:2].T
        kept = trustworthiness(x, y)
        assert kept > 0.95 if name == "sheet" else kept > trustworthiness(x, flat) + 0.06


def test_map_is_repeatable_and_takes_little(spark):
    vecs = spark.createDataFrame([("s", f"w{q}", [float(q % 3), float(q), 1.0]) for q in range(8)] + [("s", "null", None), ("one", "w", [1.0, 2.0, 3.0])], "slice string, word string, vec array<double>")
    a, b = (sorted((r.slice, r.word, tuple(r.place)) for r in landscape.neighbour_map(vecs, epochs=20, k=3).collect()) for _ in range(2))
    assert a == b and len(a) == 9 and all(np.isfinite(p).all() for _, _, p in a)
    assert landscape.neighbour_map(vecs.limit(0), epochs=10).count() == 0


def test_bandwidth_and_curve():
    d = np.sort(np.random.default_rng(0).uniform(0.1, 1, (20, 15)), 1)
    rho, sigma = landscape.bandwidth(d)
    assert np.allclose(rho, d[:, 0]) and np.allclose(np.exp(-np.maximum(d - rho[:, None], 0) / sigma[:, None]).sum(1), np.log2(15), atol=1e-3)
    a, b = landscape.curve(0.1)
    assert a == pytest.approx(1.577, abs=0.01) and b == pytest.approx(0.895, abs=0.01)


def test_new_words_land_among_their_neighbours(spark):
    vecs = fx.slice_vectors(spark, DATA).where("slice = 'y2001'")
    places = vecs.select("word", F.transform("vec", lambda c: c.cast("double")).alias("place"))
    got = {r.id: r.place for r in landscape.place_words(vecs.select(F.col("word").alias("id"), "vec"), vecs, places, 1).collect()}
    assert all(np.allclose(got[r.word], r.place) for r in places.collect())  # the nearest of a word is itself


def modularity(edges, label):
    m = sum(w for _, _, w in edges)
    tot = {}
    for u, v, w in edges:
        for x in (u, v):
            tot[label[x]] = tot.get(label[x], 0) + w
    return sum(w for u, v, w in edges if label[u] == label[v]) / m - sum((t / 2 / m) ** 2 for t in tot.values())


def test_communities_are_no_worse_than_the_plain_algorithm(spark):
    vecs = fx.slice_vectors(spark, DATA)
    graph = knn.knn_graph(vecs, vecs.select("word"), 5)
    plan = communities.detect_communities(graph.limit(20))._jdf.queryExecution().toString()
    assert "InPandas" not in plan
    found = QUERIES["communities_by_slice"](spark, DATA).toPandas()
    rows = graph.toPandas()
    for name, own in rows.groupby("slice"):
        edges = list(own[["u", "v", "weight"]].itertuples(index=False, name=None))
        label = dict(found[found["slice"] == name][["word", "community_id"]].itertuples(index=False, name=None))
        assert modularity(edges, label) >= modularity(edges, kernels.louvain(edges)) - 1e-9
        first = [min(w for w, c in label.items() if c == q) for q in range(max(label.values()) + 1)]
        assert first == sorted(first)


def test_communities_of_two_cliques(spark):
    edges = [(s, f"{g}{a}", f"{g}{b}", 1.0) for s in ("x", "y") for g in "ab" for a in range(4) for b in range(a + 1, 4)] + [("x", "a0", "b0", 0.1)]
    nodes = spark.createDataFrame([("x", "lone"), ("z", "only")], "slice string, word string")
    got = {(r.slice, r.word): r.community_id for r in communities.detect_communities(spark.createDataFrame(edges, "slice string, u string, v string, weight double"), nodes, tries=1).collect()}
    assert got == {(s, f"{g}{a}"): k for s in "xy" for k, g in enumerate("ab") for a in range(4)} | {("x", "lone"): 2, ("z", "only"): 0}
