"""Nearest points by products first: the same rows, to the last digit, as from all differences, which only few pairs need."""

import numpy as np
import pandas as pd
import pytest

from lexdrift.operators import knn


def plain(d, k):
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    far = np.take_along_axis(d, order, 1).ravel()
    rows = np.repeat(np.arange(len(d)), order.shape[1])
    return [v[np.isfinite(far)] for v in (rows, order.ravel(), far)]


@pytest.mark.parametrize("kind", ["spread", "whole", "far", "copies"])
@pytest.mark.parametrize("n, m, k", [(700, 300, 5), (300, 700, 16), (3, 2, 4), (600, 0, 3)])
def test_nearest_equal_those_from_differences(kind, n, m, k):
    rng = np.random.default_rng(n + m)
    x, y = rng.normal(size=(n, 6)), rng.normal(size=(m or n, 6))
    if kind == "whole":
        x, y = x.round(), y.round()
    elif kind == "far":
        x, y = x * 1e-4 + 1000, y * 1e-4 + 1000
    elif kind == "copies":
        x[:], y[:] = x[0], x[0]
    y = y if m else x
    a, b = pd.Series(list(x.astype("f4"))), pd.Series(list(y.astype("f4")))
    same = np.full(n, -1) if m else np.arange(n)
    d = -knn.straight(a, b)
    if not m:
        np.fill_diagonal(d, np.inf)
    left, (i, j, far) = knn.nearest_pairs(a, b, same, k, bool(m))
    for got, want in zip(left, plain(d, k)):
        np.testing.assert_array_equal(got, want)
    if m:
        for got, want in zip((j, i, far), plain(d.T, k)):
            np.testing.assert_array_equal(got, want)


def test_few_pairs_are_compared_by_differences(monkeypatch):
    seen, all_of = [], knn.straight_pairs
    monkeypatch.setattr(knn, "straight_pairs", lambda x, y, i, j: seen.append(len(i)) or all_of(x, y, i, j))
    monkeypatch.setattr(knn, "straight", None)
    rng = np.random.default_rng(3)
    a, b = (pd.Series(list(rng.normal(size=(2000, 8)))) for _ in range(2))
    knn.nearest_pairs(a, b, np.full(2000, -1), 10, True)
    assert sum(seen) < 2000 * 2000 / 20


@pytest.mark.parametrize("value", [np.nan, np.inf, 1e200])
def test_values_without_products(value):
    for x, y in (([[value, 0.0]], [[1.0, 2.0]]), ([[1.0, 2.0]], [[value, 0.0]])):
        with np.errstate(all="ignore"):
            assert knn.nearest_pairs(pd.Series([np.array(v) for v in x]), pd.Series([np.array(v) for v in y]), np.array([-1]), 1, True) is None


def test_points_that_are_searched_bound_their_lists(spark):
    """Lists of two neighbours prove little, so points are compared with all others in rounds, and what is found extends their lists: the tree's weight is that of a plain one."""
    from lexdrift.operators import density

    rng = np.random.default_rng(5)
    rows = [("s", f"w{q:03d}", [float(v) for v in p]) for q, p in enumerate(rng.normal(size=(150, 3)))]
    points = spark.createDataFrame(rows, "slice string, word string, vec array<float>")
    asked, real = [], density.outside
    density.outside = lambda points, core, labels, unsure, block: asked.append(unsure.count()) or real(points, core, labels, unsure, block)
    try:
        forest = density.spanning_forest(points, 2, 2, 64).collect()
    finally:
        density.outside = real
    x = np.array([r[2] for r in rows], "f4").astype("f8")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, 1)[:, 1]
    w = np.maximum(d, np.maximum(core[:, None], core[None]))
    inside, total = [0], 0.0
    while len(inside) < len(x):
        rest = [q for q in range(len(x)) if q not in inside]
        at = w[np.ix_(inside, rest)].min(0)
        total += at.min()
        inside.append(rest[int(at.argmin())])
    assert len(forest) == 149 and sum(r.w for r in forest) == pytest.approx(total)
    assert asked
