import numpy as np
import pytest
from pyspark.sql import functions as F

from lexdrift.functions import ranks
from lexdrift.operators import align, analytics, communities, drift, kernels, knn, train


def table(spark, data):
    return spark.createDataFrame([(s, w, [float(x) for x in v]) for (s, w), v in data.items()], "slice string, word string, vec array<float>")


@pytest.fixture(scope="module")
def rotated(spark):
    rng = np.random.default_rng(1)
    a = rng.standard_normal((30, 4))
    data, turn = {}, np.eye(4)
    for k in range(3):
        for w, v in enumerate(a @ turn):
            data[f"s{k}", f"w{w:02d}"] = v
        turn = turn @ np.linalg.qr(rng.standard_normal((4, 4)))[0]
    return table(spark, data)


def test_alignment_undoes_rotations(rotated):
    words = rotated.select("word").distinct()
    turns = align.rotations(rotated, words)
    for r in turns.values():
        assert np.allclose(r @ r.T, np.eye(4), atol=1e-6)
    turned = {(r.slice, r.word): np.array(r.vec) for r in align.align(rotated, words).collect()}
    assert all(np.allclose(turned["s0", w], turned["s2", w], atol=1e-4) for _, w in turned)
    with pytest.raises(ValueError):
        align.rotations(rotated, words.limit(5))


def test_shift_of_a_missing_word_is_null(spark, rotated):
    words = spark.createDataFrame([("w00",), ("none",)], "word string")
    rows = {(r.word, r.t1): r for r in drift.shifts(rotated, words, 5).collect()}
    assert len(rows) == 4 and rows["none", "s0"].combined_shift is None
    assert rows["w00", "s0"].jaccard_shift == 0.0  # rotations keep neighbours


def test_neighbours_in_blocks_agree(rotated):
    a = sorted(map(tuple, knn.neighbours(rotated, 4).select("slice", "word", "neighbour", "rank").collect()))
    b = sorted(map(tuple, knn.neighbours(rotated, 4, block=7).select("slice", "word", "neighbour", "rank").collect()))
    assert a == b
    assert knn.close_counts(rotated, 0.5, block=7).count() == 90


def test_directional_shift(rotated):
    row = drift.directional_shift(rotated, "w01", "s0", "s1", 5)
    assert row.first().gained == [] and abs(row.first().magnitude) < 1e-6
    assert drift.along_direction(rotated, row, "s1").count() == 5


def test_dip_and_densities():
    assert kernels.dip([1, 2, 3, 4, 5]) == pytest.approx(0.1)
    assert kernels.dip([0, 0, 0, 1, 1, 1]) == pytest.approx(0.25)
    rng = np.random.default_rng(0)
    two = np.r_[rng.normal(0, 1, 150), rng.normal(8, 1, 150)]
    assert kernels.dip_p_value(kernels.dip(two), 300, 50) < 0.05 < kernels.dip_p_value(kernels.dip(rng.random(300)), 300, 50)
    grid = np.linspace(-5, 5, 400)
    assert kernels.kde(rng.standard_normal(500), grid).sum() * (grid[1] - grid[0]) == pytest.approx(1, abs=0.02)
    assert kernels.kde([1.0] * 20, grid) is None and kernels.kde([1.0, 2.0], grid) is None


def test_clusters():
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(0, 1, (40, 3)) + [9, 0, 0], rng.normal(0, 1, (40, 3)) + [0, 9, 0]]
    labels = kernels.kmeans(x, 2)
    assert len(set(labels[:40])) == 1 and labels[0] != labels[-1]
    assert kernels.cosine_silhouette(x, labels) > 0.7
    assert kernels.bootstrap_components(x, 6, 5)[0] == 2
    parts = kernels.louvain([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("d", "e", 1.0), ("c", "d", 0.1)], ["z"])
    assert parts["a"] == parts["b"] == parts["c"] == 0 and parts["d"] == parts["e"] == 1 and parts["z"] == 2


def test_ranks(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([1.0, 1.0, 1.0, 5.0, 7.0, None])], "k int, v double")
    rows = {r.k: r for r in ranks.quantile_bins(ranks.average_rank(df, "v", "r"), "r", "bin", 4).collect()}
    assert [rows[k].r for k in range(6)] == [2, 2, 2, 4, 5, None]
    assert rows[0].bin == rows[2].bin == 1 and rows[4].bin == 2 and rows[5].bin is None


def test_all_null_drift_is_nought(spark):
    df = spark.createDataFrame([("a", None), ("b", float("nan")), ("b", 2.0)], "word string, combined_shift double")
    assert {r.word: r.total_drift for r in drift.total_drift(df).collect()} == {"a": 0.0, "b": 2.0}


def test_community_events(spark):
    rows = [("s1", w, 0) for w in "abcd"] + [("s2", w, 5) for w in "abefgh"] + [("s2", w, 6) for w in "xyz"]
    found = {r.community_id: r for r in communities.community_events(spark.createDataFrame(rows, "slice string, word string, community_id int")).collect()}
    assert found[5].type == "major_change" and found[5].overlap == pytest.approx(2 / 8) and found[5].lost == ["c", "d"]
    assert found[6].type == "birth" and found[6].size == 3


def test_trajectory_of_a_fixed_word(rotated):
    background, path = communities.trajectory(rotated, "w02", 5)
    assert path.count() == 3 and background.count() >= 3


def test_planted_drift_ranks_first(spark):
    rows = []
    rng = np.random.default_rng(3)
    for year in range(12):
        for w in range(5):
            base = np.eye(6)[w]
            if w == 0 and year >= 7:
                base = np.eye(6)[5]
            rows += [(f"w{w}", 2000 + year, k, [float(x) for x in base + rng.normal(0, 0.05, 6)]) for k in range(12)]
    cells = drift.centroids(spark.createDataFrame(rows, "word string, year int, usage_id long, emb array<float>"))
    top = drift.drift_ranking(drift.centroid_drift(cells, 5), cells).orderBy(F.desc("total_drift")).first()
    assert top.word == "w0" and top.max_step_year == 2007


def test_bootstrap(spark):
    a = spark.createDataFrame([([f"w{(k + j) % 14}" for j in range(6)],) for k in range(200)], "tokens array<string>")
    settings = train.W2VSettings(vector_size=4, min_count=2, epochs=1)

    def metric(x, y):
        return x.join(y.withColumnRenamed("vec", "b"), "word").select("word", F.get("vec", F.lit(0)).cast("double").alias("value"))

    rows = train.bootstrap_metric(a, a, metric, settings=settings, replicates=2)
    assert rows.first().n_valid == 2


def test_spearman(spark):
    df = spark.createDataFrame([(float(k), float(k * k)) for k in range(10)], "x double, y double")
    assert analytics.spearman(df, "x", "y").first().rho == pytest.approx(1)
