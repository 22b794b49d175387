import pytest
from pyspark.sql import functions as F

from lexdrift.functions import slices
from lexdrift.operators import phrases, text, usages


def values(spark, f, texts):
    return [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(f(F.col("t"))).collect()]


def test_citations(spark):
    cases = {
        "Joined Cases C-456/78 and C-789/01 apply": "__CASEREF__ apply",
        "see [1998] ECR I-1234.": "see __ECRREF__.",
        "OJ 1998 L 123, p. 45": "__OJREF__",
        "Article 101(1) TFEU": "article_101_TFEU",
        "Articles 34 and 36 TFEU": "article_34_TFEU",
        "paragraphs 10 to 15": "__PARAREF__",
        "20% or 300 EUR": "__NUM__ or __NUM__",
        "(12.5 euros)": "(__NUM__)",
        "Article 5 ECHR": "article_5_ECHR",
        "Article 5 EC": "article_5_EC",
        "Article 5 EC": "article_5_EC",
    }
    got = values(spark, text.normalize_citations, list(cases))
    assert [g.lower() for g in got] == [w.lower() for w in cases.values()]


def test_tokens(spark):
    got = values(spark, text.preprocess, ["subparagraph 3 of Article 34 TFEU", "Inter alia, the sine qua non liquet", "Case C-1/90 paragraph 4", "", None, "éad hoc x"])
    assert got[0] == ["sub__pararef__", "article_34_tfeu"]
    assert got[1] == ["inter_alia", "sine_qua_non", "liquet"]
    assert got[2] == [] and got[3] == [] and got[4] is None
    assert got[5] == ["ad", "hoc"]


@pytest.mark.parametrize("listed", [2000, 0])
def test_usages_and_offsets(spark, monkeypatch, listed):
    monkeypatch.setattr(usages, "LISTED", listed)
    paras = spark.createDataFrame([(1, 0, "The Court held; the court's COURT ruled on courts. " + "x" * 30), (2, 0, "court")], "celex int, para_idx int, text string")
    words = spark.createDataFrame([("court",)], "word string")
    rows = usages.find_usages(paras, words, ["celex", "para_idx"]).orderBy("char_start").collect()
    assert [(r.celex, r.char_start, r.char_end) for r in rows] == [(1, 4, 9), (1, 20, 25), (1, 28, 33)]


def test_embedding_by_containment(spark):
    paras = spark.createDataFrame([(1, 0, "alpha beta alpha" + " filler" * 600 + " beta")], "celex int, para_idx int, text string")
    words = spark.createDataFrame([("alpha",), ("beta",)], "word string")
    found = usages.find_usages(paras, words, ["celex", "para_idx"])
    rows = usages.embed_usages(paras, found, ["celex", "para_idx"], usages.HashEncoder(8)).collect()
    assert len(rows) == 4 and sum(r.emb is None for r in rows) == 1
    assert usages.extraction_failures(spark.createDataFrame(rows)).first().n_failed == 1


def test_phrases(spark):
    rows = spark.createDataFrame([(["free", "movement", "of", "goods"],)] * 20 + [(["goods", "free", "other"],)] * 5, "tokens array<string>")
    merged, found = phrases.detect_phrases(rows, 2, 0.1)
    assert {(r.a, r.link, r.b) for r in found.where("pass = 1").collect()} >= {("free", "", "movement"), ("movement", "of", "goods")}
    assert merged.first().tokens == ["free_movement_of_goods"]
    assert phrases.merge_tokens(["a", "b", "b"], {("a", "", "b"), ("b", "", "b")}, set()) == ["a_b", "b"]


def test_large_phrase_tables_are_joined(spark, monkeypatch):
    rows = spark.createDataFrame([(1, ["x", "y", "z"]), (2, []), (3, None)], "k int, tokens array<string>")
    table = spark.createDataFrame([("x", "", "y")], "a string, link string, b string")
    monkeypatch.setattr(phrases, "BROADCAST_BYTES", -1)
    got = {r.k: r.tokens for r in phrases.apply_phrases(rows, table).collect()}
    assert got == {1: ["x_y", "z"], 2: [], 3: None}


def test_slices(spark):
    labels = values(spark, slices.midpoint, ["w1990_1994", "y2005", "12.5", "other"])
    assert labels == [1992.0, 2005.0, 12.5, 0.0]
    assert [r.label for r in slices.sliding_windows(spark, 2000, 2005).orderBy("ord").collect()] == ["w2000_2004", "w2001_2005"]
    years = spark.createDataFrame([(y,) for y in (1999, 2000, 2004, 2005, 2006)], "year int")
    got = sorted((r.year, r.slice) for r in slices.in_windows(years, 2000, 2005).collect())
    assert got == [(2000, "w2000_2004"), (2004, "w2000_2004"), (2004, "w2001_2005"), (2005, "w2001_2005")]


def test_samples_are_repeatable(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    a, b = (sorted(r.id for r in usages.sample_per_key(df, ["k"], ["id"], 5).collect()) for _ in range(2))
    assert a == b and len(a) == 15
    assert usages.weighted_sample(df.withColumn("w", F.col("id")), "w", ["id"], 10).count() == 10


def test_encoder_of_trained_vectors(spark):
    from lexdrift.operators.usages import VectorEncoder, embed_usages, find_usages

    vecs = spark.createDataFrame([("bank", [1.0, 0.0]), ("river", [0.0, 1.0]), ("money", [0.0, -1.0]), ("null", None)], "word string, vec array<float>")
    encoder = VectorEncoder(vecs, reach=2)
    (spans, states), (none, empty) = encoder(["The Bank near river", "nothing known"])
    assert spans.tolist() == [[4, 8], [14, 19]] and states.tolist() == [[0.5, 0.5], [0.5, 0.5]] and len(none) == len(empty) == 0
    texts = spark.createDataFrame([(1, "the bank of the river, far away from any town or city"), (2, "the bank has money, far away from any town or city now"), (3, "a bank alone, far away from any town or any other city now")], "id int, text string")
    found = find_usages(texts, spark.createDataFrame([("bank",)], "word string"), ["id"])
    got = {r.id: r.emb for r in embed_usages(texts, found, ["id"], VectorEncoder(vecs, reach=3)).collect()}
    assert got[1][1] > 0 > got[2][1] and got[3] == [1.0, 0.0]
