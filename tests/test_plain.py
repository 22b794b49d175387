"""Texts and sentences taken many at once: the same as one by one, and none through patterns or walks that cannot change it."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexdrift.functions.wordlists import LATIN_PHRASES
from lexdrift.operators import phrases, text, vocabulary
from lexdrift.plans import queries_text as q

TEXTS = ["The Court held_x, court's é ad", "", None, "x1 ab", "Article ٣٤ TFEU", "½ ab Ⅻ cd", "Inter alia", "inter  alia", "in rem", "in remit", "in rem.", "ex poſt", "de faİt", "non bıs in ıdem", "Kin inK", "İstanbul ÀB", "_ab __c a_b-ZZ _", "a\x01per se", "ab\x00cd", " \n\tab", "ÉCOLE über Straße", "in situé ab", "of the"]


def test_plain_texts_have_the_tokens_of_the_chain(spark, monkeypatch):
    rng = random.Random(5)
    made = ["".join(rng.choice([*"aBz _.,1İſé", " se", " REM", " the ", *LATIN_PHRASES]) for _ in range(rng.randrange(12))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(TEXTS + made)), "k int, text string").repartition(3)
    got = rows.select("text", text.tokens_of_plain("text").alias("plain"), text.preprocess(F.col("text")).alias("chain")).collect()
    assert all(r.plain is None or r.plain == r.chain for r in got), [r for r in got if r.plain not in (None, r.chain)]
    plain = {r.text for r in got if r.plain is not None}
    assert {"The Court held_x, court's é ad", "", "in remit", "ab\x00cd"} <= plain and not plain & {None, "x1 ab", "in rem", "İstanbul ÀB", "Inter alia"}
    want = {(r.text, tuple(r.chain)) for r in got if r.chain}
    assert {(r.text, tuple(r.tokens)) for r in text.with_tokens(rows.withColumn("k", F.col("text")).withColumnRenamed("k", "t").select("t", "text")).withColumnRenamed("t", "text").collect()} == want


@pytest.mark.parametrize("texts", [[], [None], ["", ""], ["ab", None, "", "cd ef"]])
def test_batches_of_any_shape(texts):
    for lead in (0, 1):
        got = text.plain_tokens(pa.array(["zz yy"] * lead + texts, pa.string())[lead:]).to_pylist()
        assert got == [None if t is None else t.split() for t in texts]


def test_slices_of_a_word(spark):
    counts = spark.createDataFrame([("y1", "a", 1), ("y2", "a", 2), ("y1", "b", 1)], "slice string, word string, cnt long")
    assert {(r.word, r.n_slices) for r in vocabulary.slice_spread(counts.union(counts)).collect()} == {("a", 2), ("b", 1)}
    assert {(r.word, r.n_slices) for r in vocabulary.slice_spread(counts, once=True).collect()} == {("a", 2), ("b", 1)}
    plan = vocabulary.anchors_of_counts(counts, 2, 1, 1, once=True)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("HashAggregate") == 2


def test_pieces_are_counted_where_they_are_cut(spark):
    words = spark.createDataFrame([(w,) for w in ("aaaa", "aab", "caa", "a", "")], "word string")
    rows = q._pieces(words)
    # No pair of piece and word is shuffled: counts of pieces are.
    assert "distinct" not in rows._jdf.queryExecution().optimizedPlan().toString().replace("array_distinct", "")
    assert sorted(r.piece for r in rows.collect()) == ["##a", "a"]


def test_anchors_are_summed_before_they_are_joined(spark):
    counts = spark.createDataFrame([(f"y{k}", w, k + 1) for k in range(3) for w in "abc"], "slice string, word string, cnt long")
    rows = vocabulary.harmonic_means(counts, spark.createDataFrame([("a",), ("a",), ("z",)], "word string"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") < plan.index("Aggregate")
    assert [(r.word, round(r.hmean, 6)) for r in rows.collect()] == [("a", round(3 / (1 + 1 / 2 + 1 / 3), 6))]


def test_merging_a_batch_is_merging_each_sentence():
    rng = random.Random(3)
    stop = ["of", "the"]
    for _ in range(500):
        sentences = [None if rng.random() < 0.1 else [rng.choice(["a", "b", "c", "of", "the", "\0", "b\0c", None]) for _ in range(rng.randrange(9))] for _ in range(rng.randrange(5))]
        pairs = {(rng.choice(["a", "b", "\0"]), rng.choice(["", "of", "of the"]), rng.choice(["a", "c", "b\0c"])) for _ in range(rng.randrange(6))}
        a, link, b = (pa.array([p[k] for p in pairs], pa.string()) for k in range(3))
        got = phrases.merge_all(pa.array([["a"], *sentences], phrases.LISTS)[1:], (a.unique(), phrases.keys(a, link, b)), pa.array(stop))
        assert got.to_pylist() == [t and phrases.merge_tokens(t, pairs, set(stop)) for t in sentences]


def test_phrases_are_scored_once(spark, monkeypatch):
    """Their size and their rows were both computed from the pair counts, joins and all."""
    kept = []
    monkeypatch.setattr(phrases, "cut", lambda df, what, real=phrases.cut: (kept.append(what), real(df, what))[1])
    phrases.detect_phrases(spark.createDataFrame([(["a", "b"],)] * 9, "tokens array<string>"), 2, 0.1)
    assert kept.count("phrases") == 2
