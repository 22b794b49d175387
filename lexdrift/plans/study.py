"""The whole study, stage by stage: texts to aligned vectors to drift tables, and usages to polysemy and drift.

A stage whose table is there already is not run again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexdrift.functions import slices
from lexdrift.functions.wordlists import DOMAIN_ROWS
from lexdrift.operators import align, analytics, drift, knn, phrases, text, train, usages, vocabulary


@dataclass(frozen=True)
class Study:
    """Defaults of all stages. The cap on usages is not below the floor of the dip test, else no year could be tested."""

    start: int = 1990
    end: int = 2025
    window_size: int = 5
    step: int = 1
    single_year: bool = False
    skip_phrases: bool = False
    phrase_min_count: int = 30
    phrase_threshold: float = 10.0
    max_phrase_len: int = 3
    w2v: train.W2VSettings = field(default_factory=train.W2VSettings)
    anchor_top_n: int = 500
    min_slices_global: int = 3
    min_slices_analysis: int = 10
    k: int = 25
    min_percentile: int = 6
    n_usages: int = 150
    min_usages: int = 10
    min_years: int = 20
    anchor_years: tuple[int, int] = (1990, 1994)
    max_per_year: int = 50
    min_steps: int = 10
    dip_usages: int = 150
    dip_p: float = 0.10
    k_pass: int = 5
    max_fails: int = 0
    seed: int = 42


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def stage(spark: SparkSession, out_dir: str, name: str, make: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
    path = f"{out_dir}/{name}"
    if not exists(spark, path):
        writer = make().write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.parquet(path)


def domains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DOMAIN_ROWS, "domain string, word string")


def texts_to_vectors(spark: SparkSession, texts: DataFrame, out_dir: str, study: Study = Study()) -> dict[str, DataFrame]:
    """``texts``: celex, year, status, paragraphs. Gives sentences, counts, vocabulary tiers, raw and aligned vectors."""
    out = {"sentences": stage(spark, out_dir, "sentences", lambda: text.build_sentences(texts), "year")}
    if not study.skip_phrases:
        out["merged"] = stage(spark, out_dir, "merged", lambda: phrases.detect_phrases(out["sentences"], study.phrase_min_count, study.phrase_threshold, max_phrase_len=study.max_phrase_len)[0], "year")
    rows = out.get("merged", out["sentences"])
    sliced = slices.single_years(rows.where(F.col("year").between(study.start, study.end))) if study.single_year else slices.in_windows(rows, study.start, study.end, study.window_size, study.step)
    out["counts"] = stage(spark, out_dir, "counts", lambda: vocabulary.word_counts(sliced, ["slice"], study.w2v.min_count))
    out["v_global"] = stage(spark, out_dir, "v_global", lambda: vocabulary.v_global(out["counts"], study.min_slices_global))
    out["v_analysis"] = stage(spark, out_dir, "v_analysis", lambda: vocabulary.v_analysis(out["counts"], study.min_slices_global, study.min_slices_analysis))
    out["v_anchor"] = stage(spark, out_dir, "v_anchor", lambda: vocabulary.v_anchor(out["counts"], out["v_analysis"], study.anchor_top_n, study.min_slices_global))
    out["vectors"] = stage(spark, out_dir, "vectors", lambda: train.train_slices(sliced, study.w2v), "slice")
    out["aligned"] = stage(spark, out_dir, "aligned", lambda: align.align(out["vectors"].select("slice", "word", "vec"), out["v_anchor"]), "slice")
    return out


def vectors_to_drift(spark: SparkSession, tables: dict[str, DataFrame], out_dir: str, study: Study = Study()) -> dict[str, DataFrame]:
    """Neighbours once, then shifts, dispersion, coherence and frequency-adjusted drift."""
    vecs = tables["aligned"].select("slice", "word", "vec")
    near = stage(spark, out_dir, "neighbours", lambda: knn.neighbours(vecs, study.k))
    out = {"shifts": stage(spark, out_dir, "shifts", lambda: drift.shifts(vecs, tables["v_analysis"], study.k, near))}
    out["dispersion"] = stage(spark, out_dir, "dispersion", lambda: drift.dispersion(vecs, study.k, near).join(tables["v_analysis"].select("word"), "word", "left_semi"))
    out["coherence"] = stage(spark, out_dir, "coherence", lambda: drift.coherence(vecs, domains(spark)))
    out["word_frequencies"] = stage(spark, out_dir, "word_frequencies", lambda: vocabulary.frequency_table(tables["counts"]))
    out["frequency_drift"] = stage(spark, out_dir, "frequency_drift", lambda: drift.frequency_adjusted(drift.total_drift(out["shifts"]), vocabulary.mean_counts(tables["counts"]), study.min_percentile))
    return out


def usages_to_drift(spark: SparkSession, paragraphs: DataFrame, words: DataFrame, encoder: usages.Encoder, out_dir: str, study: Study = Study()) -> dict[str, DataFrame]:
    """``paragraphs``: celex, para_idx, year, text. Usages are found, sampled a word and year, encoded once a paragraph, and measured."""
    keys = ["celex", "para_idx", "year"]
    out = {"usages": stage(spark, out_dir, "usages", lambda: usages.find_usages(paragraphs, words, keys), "year")}
    sampled = usages.sample_per_key(out["usages"], ["word", "year"], ["celex", "para_idx", "char_start"], study.n_usages, study.seed)

    def embedded() -> DataFrame:
        rows = usages.embed_usages(usages.paragraphs_to_encode(paragraphs, sampled, keys), sampled, keys, encoder)
        ident = F.xxhash64("word", "celex", "para_idx", "char_start").alias("usage_id")
        return rows.where("emb is not null").select("word", F.col("year").cast("int").alias("year"), ident, "emb")

    out["usage_embeddings"] = stage(spark, out_dir, "usage_embeddings", embedded, "year")
    emb = out["usage_embeddings"]
    out["polysemy"] = stage(spark, out_dir, "polysemy", lambda: drift.polysemy(emb, study.min_usages))
    out["polysemy_ranking"] = stage(spark, out_dir, "polysemy_ranking", lambda: drift.polysemy_ranking(out["polysemy"], study.min_years))
    out["centroids"] = stage(spark, out_dir, "centroids", lambda: drift.centroids(emb, study.min_usages))
    out["centroid_drift"] = stage(spark, out_dir, "centroid_drift", lambda: drift.centroid_drift(out["centroids"], study.min_years, study.anchor_years))
    out["centroid_drift_ranking"] = stage(spark, out_dir, "centroid_drift_ranking", lambda: drift.drift_ranking(out["centroid_drift"], out["centroids"]))
    few = usages.sample_per_key(emb, ["word", "year"], ["usage_id"], study.max_per_year, study.seed)
    out["cross_period"] = stage(spark, out_dir, "cross_period", lambda: drift.cross_period(few, study.min_usages, study.min_years))
    out["cross_period_ranking"] = stage(spark, out_dir, "cross_period_ranking", lambda: drift.cross_period_ranking(out["cross_period"]))
    out["shift_quantiles"] = stage(spark, out_dir, "shift_quantiles", lambda: analytics.shift_quantiles(out["centroid_drift"], study.min_steps))
    out["dips"] = stage(spark, out_dir, "dips", lambda: analytics.dip_by_word_year(emb, study.dip_usages))
    out["monosemy"] = stage(spark, out_dir, "monosemy", lambda: analytics.monosemy_summary(out["dips"], study.dip_p, study.k_pass, study.max_fails))
    return out
