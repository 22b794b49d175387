"""Density clusters against a plain tree from the top down, on all pairs."""

import numpy as np
import pytest

from lexdrift.operators import density


def by_hand(x, names, size, samples):
    """Clusters as sets of names: Prim's tree on all pairs, split from the longest edge down, chosen by stability."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, 1)[:, min(samples, n) - 1]
    m = np.maximum(np.maximum(core[:, None], core[None]), d)
    inside, edges, best = {0}, [], {j: (m[0, j], 0) for j in range(1, n)}
    while best:
        j = min(best, key=lambda q: (best[q][0], sorted((names[q], names[best[q][1]]))))
        w, i = best.pop(j)
        edges.append((w, *sorted((names[i], names[j]))))
        inside.add(j)
        for q in best:
            if (m[j, q], sorted((names[j], names[q]))) < (best[q][0], sorted((names[q], names[best[q][1]]))):
                best[q] = (m[j, q], j)

    def parts(nodes, own):
        up = {a: a for a in nodes}

        def find(a):
            while up[a] != a:
                a = up[a]
            return a

        for _, a, b in own:
            up[find(a)] = find(b)
        groups = {}
        for a in nodes:
            groups.setdefault(find(a), set()).add(a)
        return list(groups.values())

    def best_of(nodes, own, birth, is_root):
        """(stability, chosen sets) of a cluster with these nodes and edges, born at a density."""
        stability, rest, left = 0.0, sorted(own, reverse=True), set(nodes)
        while rest:
            w, a, b = rest.pop(0)
            level = 1 / max(w, 1e-10)
            two = parts(left, rest)
            pieces = [p for p in two if len(p) >= size]
            if len(pieces) == 2:
                stability += (level - birth) * len(left)
                below = [best_of(p, [e for e in rest if e[1] in p], level, False) for p in pieces]
                total = sum(s for s, _ in below)
                if is_root or stability < total:
                    return total, [c for _, found in below for c in found]
                return stability, [set(nodes)]
            gone = left - (pieces[0] if pieces else set())
            stability += (level - birth) * len(gone)
            left -= gone
            rest = [e for e in rest if e[1] in left and e[2] in left]
        return (0.0, []) if is_root else (stability, [set(nodes)])

    return best_of(set(names), edges, 0.0, True)[1] if n >= size else []


def blobs(seed, n=90, spread=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(0, 6, (4, 2))
    return np.concatenate([centres[rng.integers(0, 4, n)] + rng.normal(0, spread, (n, 2)), rng.uniform(-1, 7, (n // 4, 2))])


def frame(spark, sets):
    return spark.createDataFrame([(s, f"p{k:03d}", [float(c) for c in v]) for s, x in sets.items() for k, v in enumerate(x)], "slice string, word string, vec array<double>")


def clusters(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.slice, {}).setdefault(r.cluster, set()).add(r.word)
    return {s: sorted(sorted(v) for c, v in found.items() if c >= 0) for s, found in out.items()}


@pytest.mark.parametrize("k, block, most", [(16, 4096, 200_000), (5, 40, 12)])
def test_clusters_equal_a_plain_tree(spark, k, block, most):
    """Also where lists of neighbours are too short to give the tree, points lie in many blocks, and edges are folded in many ranges."""
    sets = {"a": blobs(1), "b": blobs(2, 60, 0.6), "few": blobs(3, 4), "one": np.zeros((1, 2))}
    got = density.density_clusters(frame(spark, sets), 5, 4, k, block, most)
    assert got.count() == sum(map(len, sets.values()))
    found = clusters(got)
    for s, x in sets.items():
        names = [f"p{q:03d}" for q in range(len(x))]
        assert found[s] == sorted(sorted(c) for c in by_hand(x, names, 5, 4)), s


def test_forest_is_minimal(spark):
    x = blobs(5, 400)
    got = density.spanning_forest(frame(spark, {"s": x}), 5, 8, 128).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, 1)[:, 4]
    m = np.maximum(np.maximum(core[:, None], core[None]), d)
    reach, total = m[0].copy(), 0.0
    left = set(range(1, len(x)))
    while left:
        j = min(left, key=lambda q: reach[q])
        total += reach[j]
        left.discard(j)
        reach = np.minimum(reach, m[j])
    assert len(got) == len(x) - 1 and sum(r.w for r in got) == pytest.approx(total)


def test_equal_points_and_no_points(spark):
    sets = {"same": np.zeros((12, 2)), "pairs": np.repeat(np.arange(6.0), 2)[:, None] * [[10.0, 0.0]]}
    found = density.density_clusters(frame(spark, sets), 3)
    assert found.count() == 24 and {r.cluster for r in found.where("slice = 'same'").collect()} == {-1}
    assert density.density_clusters(frame(spark, sets).where("slice = 'none'"), 3).count() == 0
