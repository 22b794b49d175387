"""Comparing blocks takes the memory of a strip, not of two blocks."""

import tracemalloc

import numpy as np
import pandas as pd

from lexdrift.operators import knn


def test_highest_is_a_stable_sort():
    rng = np.random.default_rng(1)
    for columns in (3, 8, 60, 500):
        sims = rng.integers(0, 40, (50, columns)) / 8.0
        sims[rng.random(sims.shape) < 0.05] = -np.inf
        for k in (0, 1, 5, 40):
            assert (knn.highest(sims, k) == np.argsort(-sims, axis=1, kind="stable")[:, :k]).all()


def test_a_pair_of_blocks_takes_a_strip_at_a_time(monkeypatch):
    """The function that tasks run, on two blocks of full size, against a plain sort of all similarities."""
    kept = {}

    class Pairs:
        def applyInPandas(self, f, schema):
            kept["f"] = f

    class Rows:
        def where(self, condition):
            return self

    monkeypatch.setattr(knn, "block_pairs", lambda vecs, block: Pairs())
    monkeypatch.setattr(knn.F, "col", lambda c: pd.Series(dtype=float))
    monkeypatch.setattr(pd.Series, "isNotNull", lambda s: s, raising=False)
    knn.scan(Rows(), 5, 0.2)
    rng = np.random.default_rng(2)
    n = 2048
    a = pd.DataFrame({"word": [f"a{k:05}" for k in rng.permutation(n)], "vec": list(rng.standard_normal((n, 16)).astype("f4"))})
    b = pd.DataFrame({"name": [f"b{k:05}" for k in rng.permutation(n)], "values": list(rng.standard_normal((n, 16)).astype("f4"))})
    tracemalloc.start()
    found = kept["f"](("s", 0, 1), a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < n * n * 8
    sims = knn.cosines(a["vec"], b["values"])
    for own, other, m in ((a["word"], b["name"], sims), (b["name"], a["word"], sims.T)):
        rows = found[found["word"].isin(set(own))]
        near = rows[rows["neighbour"].isna()].set_index("word")["close"]
        assert (near.loc[own].to_numpy() == (m > 0.2).sum(1)).all()
        top = rows[rows["neighbour"].notna()].groupby("word")["neighbour"].agg(set)
        want = {w: set(other.to_numpy()[np.argsort(-r)[:5]]) for w, r in zip(own, m)}
        assert top.to_dict() == want
