"""Distances of pairs in blocks against all pairs at once, and the dip's p-values against direct simulation."""

import numpy as np
import pytest

from lexdrift.operators import analytics, kernels, pairs


def usages(spark, sets):
    return spark.createDataFrame([(w, 2000 + k % 2, k, v) for w, x in sets.items() for k, v in enumerate(x)], "word string, year int, usage_id long, emb array<float>")


@pytest.mark.parametrize("block", [1024, 17])
def test_summaries_equal_all_pairs(spark, block):
    rng = np.random.default_rng(2)
    sets = {"two": np.concatenate([rng.normal(0, 0.2, (60, 5)) + [3, 0, 0, 0, 0], rng.normal(0, 0.2, (50, 5)) + [0, 3, 0, 0, 0]]), "one": rng.normal(size=(40, 5)), "copies": np.ones((30, 5)), "pair": rng.normal(size=(2, 5)), "single": rng.normal(size=(1, 5))}
    sets = {w: x.astype("f4").tolist() for w, x in sets.items()}
    rows = usages(spark, sets | {"null": [None, None]})
    got = {r.word: r for r in pairs.distance_summaries(rows, ["word"], draws=60, block=block).collect()}
    assert set(got) == {"two", "one", "copies", "pair"}
    for word, r in got.items():
        d = kernels.pairwise_distances(np.array(sets[word], "f4"))
        assert r.n_values == len(d)
        assert (r["mean"], r["std"]) == (pytest.approx(d.mean(), abs=1e-12), pytest.approx(d.std(), abs=1e-7))
        assert abs(r["median"] - np.median(d)) < 2 / pairs.BINS
        # Values of one bin fall together: the dip moves by half their share at most.
        share = np.bincount((d * pairs.BINS / 2).astype(int).clip(0)).max() / len(d)
        assert abs(r.dip - kernels.dip(d)) <= share / 2 + 1e-12
    assert got["two"].dip_pvalue < 0.05


def test_dip_by_word_and_year(spark):
    rng = np.random.default_rng(3)
    rows = usages(spark, {"w": rng.normal(size=(30, 4)).tolist(), "few": rng.normal(size=(5, 4)).tolist()})
    got = {(r.word, r.year): r for r in analytics.dip_by_word_year(rows, 10, 40).collect()}
    assert [got[k].n_usages for k in (("w", 2000), ("w", 2001), ("few", 2000), ("few", 2001))] == [15, 15, 3, 2]
    assert got["w", 2000].tested and 0 <= got["w", 2000].p_value <= 1 and not got["few", 2000].tested and got["few", 2000].dip is None


def test_p_values_between_and_beyond_tabulated_sizes(spark, tmp_path):
    """Against samples drawn at the size itself; the sampling error of either side is allowed three times."""
    draws = 2000
    nulls = pairs.null_dips(spark, 1500, draws, 7, str(tmp_path / "nulls"))
    assert sorted(nulls)[-2] < 1500 <= max(nulls)
    again = pairs.null_dips(spark, 1500, draws, 7, str(tmp_path / "nulls"))
    assert sorted(again) == sorted(nulls) and all(np.array_equal(again[s], nulls[s]) for s in nulls)
    rng = np.random.default_rng(1)
    for n in (50, 401, 1200):
        direct = np.sort([kernels.dip(rng.random(n)) for _ in range(draws)])
        for share in (0.5, 0.1, 0.05):
            value = np.quantile(direct, 1 - share)
            assert abs(kernels.dip_p_value(value, n, nulls=nulls) - share) < 3 * (2 * share * (1 - share) / draws) ** 0.5
    assert kernels.dip_p_value(0.3, 3, nulls=nulls) == 1.0 and kernels.dip_p_value(0.0, 10**9, nulls=nulls) == 1.0


def test_dip_of_counts_is_that_of_the_values():
    rng = np.random.default_rng(0)
    for _ in range(50):
        x = rng.integers(0, 9, int(rng.integers(2, 60)))
        values, n = np.unique(x, return_counts=True)
        assert kernels.dip(x) == kernels.dip_of_counts(values.astype(float), n)
    assert kernels.dip([]) == 0.0 and kernels.dip([2.0, 2.0]) == 0.25
