"""Text steps: patterns run once a text, only on texts that can match, and documents are dealt out whatever file they come in."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexdrift.functions.wordlists import CITATIONS, LATIN_PHRASES
from lexdrift.operators import phrases, text
from lexdrift.plans import fixtures as fx

TEXTS = ["Article ٣٤ TFEU", "paragraph ５, see OJ L 1", "no numeral", "", None, "Inter Alia", "inter  alia", "ex poſt and Locus ſtandi", "de faİt", "bis in idem non bıs ın ıdem", "per se1 per se_ per se", "sine qua non liquet", "a\x01per se", "stare décisis ultra vires"]


def documents(folder, n: int) -> str:
    pq.write_table(pa.table({"doc_id": pa.array(range(n)), "text": [f"line {k} of text\nnext" for k in range(n)], "source": [f"src{k % 3}" for k in range(n)]}), folder / "documents.parquet")
    return str(folder)


def test_rows_of_one_row_group_are_dealt_to_many_tasks(spark, tmp_path, monkeypatch):
    """One row group in a file of more splits than cores: all rows but one task's are empty."""
    monkeypatch.setattr(fx, "DEALT", 100)
    folder = documents(tmp_path, 3000)
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 500)
    try:
        assert fx.table(spark, folder, "documents").rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
        rows = fx.paragraphs(spark, folder).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert sum(r["count"] for r in rows) == 6000 and max(r["count"] for r in rows) <= 300


def test_patterns_run_once_a_text(spark, tmp_path):
    rows = fx.sentences(spark, documents(tmp_path, 10))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("__ECRREF__") == 1


def test_texts_passed_over_are_those_that_patterns_leave_alone(spark):
    """Against all patterns on every text."""
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string")
    cited = F.col("t")
    for pattern, into in CITATIONS:
        cited = F.regexp_replace(cited, "(?iu)(?U)" + pattern, into)
    many = "|".join(sorted(LATIN_PHRASES, key=len, reverse=True))
    marked = F.regexp_replace(cited, rf"(?iu)(?U)\b({many})\b", "\x01$1\x01")
    parts = F.transform(F.split(marked, "\x01"), lambda p, k: F.when(k % 2 == 1, F.replace(F.lower(p), F.lit(" "), F.lit("_"))).otherwise(p))
    want = F.when(F.contains(cited, F.lit("\x01")), cited).otherwise(F.array_join(parts, ""))
    got = rows.select("t", cited.alias("a"), text.normalize_citations(F.col("t")).alias("b"), want.alias("c"), text.protect_latin(text.normalize_citations(F.col("t"))).alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in got), got
    assert sum(r.t != r.d for r in got) > 5


@pytest.mark.parametrize("tokens", [[], ["of", "the"], ["a1"], ["free", "of", "goods"]])
def test_pairs_of_sentences_without_content(spark, tokens):
    got = phrases.score_pairs(spark.createDataFrame([(tokens,)], "tokens array<string>"), 0, 0.0).collect()
    assert [(r.a, r.link, r.b) for r in got] == ([("free", "of", "goods")] if len(tokens) == 3 else [])


def test_a_word_is_a_row_once(spark, tmp_path, monkeypatch):
    """What is shuffled for pair counts: a row for each content word of a sentence, not one for it and one for its pair."""
    kept = {}
    monkeypatch.setattr(phrases, "cut", lambda df, what: kept.setdefault(what, df))
    rows = spark.createDataFrame([(["x", "of", "y", "z"],), (["z"],)], "tokens array<string>")
    got = phrases.score_pairs(rows, 0, 0.0).collect()
    # Counts: x 1, y 1, z 2; pairs x of y, y z; five entries in all.
    assert sorted((r.a, r.link, r.b, r.n_ab, r.score) for r in got) == [("x", "of", "y", 1, 5.0), ("y", "", "z", 1, 2.5)]
    assert kept["pairs"].agg(F.sum("n_ab")).first()[0] == 4
