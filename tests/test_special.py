"""Distribution functions against known values, and words cut into pieces."""

import math

import pytest
from pyspark.sql import functions as F

from lexdrift.functions.special import correlation_p, incomplete_beta, log_gamma
from lexdrift.operators import vocabulary


def test_log_gamma(spark):
    xs = [0.5, 1.0, 1.5, 2.0, 7.3, 100.0, 12345.5, 1e6]
    for x, got in spark.createDataFrame([(x,) for x in xs], "x double").select("x", log_gamma(F.col("x"))).collect():
        assert got == pytest.approx(math.lgamma(x), rel=1e-13, abs=1e-12)


def t_tail(t, d):
    """Closed forms (Abramowitz and Stegun 26.7.3 and 26.7.4)."""
    angle = math.atan(t / math.sqrt(d))
    c, s = math.cos(angle), math.sin(angle)
    if d % 2 == 0:
        term = total = 1.0
        for k in range(2, d, 2):
            term *= c * c * (k - 1) / k
            total += term
        return 1 - s * total
    term = total = c
    for k in range(3, d, 2):
        term *= c * c * (k - 1) / k
        total += term
    return 1 - 2 / math.pi * (angle + (s * total if d > 1 else 0))


def test_p_of_a_correlation(spark):
    cases = [(r, n) for n in (3, 4, 5, 12, 51, 400, 5001) for r in (0.0, 0.01, -0.2, 0.5, -0.93, 0.9999)]
    rows = spark.createDataFrame([(float(r), n) for r, n in cases], "r double, n long").select("r", "n", correlation_p(F.col("r"), F.col("n")).alias("p")).collect()
    for r, n, p in rows:
        want = t_tail(abs(r) * math.sqrt((n - 2) / (1 - r * r)), n - 2)
        assert abs(p - want) < 1e-9, (r, n)
    edge = spark.createDataFrame([(1.0, 9), (-1.0, 9), (0.5, 2)], "r double, n long").select(correlation_p(F.col("r"), F.col("n"))).collect()
    assert [r[0] for r in edge] == [0.0, 0.0, None]


def test_incomplete_beta_ends(spark):
    row = spark.range(1).select(*(incomplete_beta(F.lit(x), F.lit(2.0), F.lit(3.0)) for x in (0.0, 0.25, 0.5, 1.0))).first()
    assert list(row) == pytest.approx([0.0, 1 - (0.75**4 + 4 * 0.25 * 0.75**3), 11 / 16, 1.0], abs=1e-12)


def plain_pieces(word, pieces):
    out, rest = 0, word
    while rest:
        fit = [k for k in range(1, len(rest) + 1) if ("##" if out else "") + rest[:k] in pieces]
        if not fit:
            return 1
        rest, out = rest[max(fit) :], out + 1
    return out


def test_subwords_are_the_longest_from_the_left(spark):
    pieces = {"un", "una", "a", "b", "court", "co", "##urt", "##u", "##r", "##t", "##able", "##ab", "##le", "##a", "##l", "é", "##é"}
    words = ["unable", "una", "court", "courtable", "cot", "b", "xyz", "éé", "uné", "", "aaab"]
    rows = vocabulary.subword_counts(spark.createDataFrame([(w,) for w in [*words, None]], "word string"), spark.createDataFrame([(p,) for p in [*pieces, "", None]], "piece string")).collect()
    got = {r.word: r.n_subwords for r in rows}
    assert got.pop(None) is None
    assert got.pop("") in (0, 1)
    assert got == {w: plain_pieces(w, pieces) for w in words if w}


def test_too_many_pieces_are_refused(spark, monkeypatch):
    monkeypatch.setattr(vocabulary, "MOST_PIECES", 2)
    with pytest.raises(ValueError):
        vocabulary.subword_counts(spark.createDataFrame([("a",)], "word string"), spark.createDataFrame([("a",), ("b",), ("c",)], "piece string"))
