"""Sampled token PCA with its table, training that goes on, and word settings."""

import numpy as np
import pytest

from lexdrift.operators import align, train
from lexdrift.operators.train import W2VSettings
from lexdrift.operators.usages import HashEncoder
from lexdrift.sources import stores


def test_token_pca_equals_numpy_and_is_kept(spark, tmp_path):
    texts = [f"word{k} and other words number {k * 7 % 5} here" for k in range(40)] + [None, "", "same text", "same text"]
    paras = spark.createDataFrame([(t,) for t in texts], "text string")
    path = str(tmp_path / "calls")

    def encoder(batch):
        with open(path, "a") as f:
            f.write("x")
        return HashEncoder(6)(batch)

    rows = align.sampled_tokens(paras, HashEncoder(6), 1000, 100).select("vec").collect()
    assert len(rows) == 100  # bounded within a paragraph
    x = np.array([r.vec for r in rows], "f8")
    mean, parts, values = align.token_pca(paras, encoder, 3, str(tmp_path / "m"), 1000, 100)
    v, q = np.linalg.eigh(np.cov(x.T))
    np.testing.assert_allclose(mean, x.mean(0), atol=1e-6)
    np.testing.assert_allclose(values, v[::-1][:3], rtol=1e-6)
    np.testing.assert_allclose(np.abs((parts * q[:, ::-1][:, :3].T).sum(1)), 1, atol=1e-6)
    calls = (tmp_path / "calls").read_text()
    again = align.token_pca(paras, encoder, 3, str(tmp_path / "m"), 1000, 100)
    assert (tmp_path / "calls").read_text() == calls and all(np.array_equal(a, b) for a, b in zip(again, (mean, parts, values)))
    align.token_pca(paras.limit(30), encoder, 3, str(tmp_path / "m"), 1000, 100)
    assert (tmp_path / "calls").read_text() != calls
    few = align.sampled_tokens(paras, HashEncoder(6), 3, 10_000)
    assert 0 < few.count() < 40
    with pytest.raises(ValueError):
        align.token_pca(paras.limit(0), encoder, 3, str(tmp_path / "m"))


def test_training_goes_on_where_it_stopped(spark, tmp_path):
    rows = spark.createDataFrame([(s, ["a", "b", "c", "a"]) for s in ("y1", "y2") for _ in range(9)], "slice string, tokens array<string>")
    settings = W2VSettings(vector_size=3, min_count=1, epochs=1)
    first = {(r.slice, r.word): r.vec for r in train.train_missing(rows.where("slice = 'y1'"), settings, str(tmp_path / "v")).collect()}
    both = {(r.slice, r.word): r.vec for r in train.train_missing(rows.withColumn("tokens", rows.tokens), settings, str(tmp_path / "v")).collect()}
    assert len(first) == 3 and len(both) == 6 and all(both[k] == v for k, v in first.items())
    assert train.train_missing(rows.limit(0), settings, str(tmp_path / "v")).count() == 6


def test_word_settings(spark, tmp_path):
    path = str(tmp_path / "words.yaml")
    with open(path, "w") as f:
        f.write("year: 2020\nseed: 42\npolysemous:\n- case\n- état\nextras: []\n")
    settings, words = stores.read_word_settings(path)
    assert settings == {"year": 2020, "seed": 42} and words == {"polysemous": ["case", "état"], "extras": []}
    assert sorted(map(tuple, stores.categories(spark, words).collect())) == [("polysemous", "case"), ("polysemous", "état")]
    words["frequency_sampled"] = ["court"]
    stores.write_word_settings(path, settings, words)
    assert stores.read_word_settings(path) == (settings, words)
