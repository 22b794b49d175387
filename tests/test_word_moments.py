"""Moments of a word's distances come from sums, not from pairs."""

from lexdrift.operators import pairs
from test_larger import embeddings, same


def test_pair_moments_form_no_pairs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pairs, "pair_bins", lambda *a, **k: 1 / 0)
    same(spark, "pair_moments", embeddings(tmp_path, [*range(2000), 5000], 3))
