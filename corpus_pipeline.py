"""From raw documents to token ids: toxicity, line dedup, near duplicates, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexdrift.llm import byte_bpe, decontaminate, jaccard_join, line_dedup, toxicity
from lexdrift.llm.common import materialize, sweep, table, written_paths


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels not held out, predicts to be toxic go."""
    model = toxicity.train_on_split(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has go; documents stay, if only as empty texts, so that every row can be traced."""
    kept = line_dedup.dedup_lines(docs, counts=False)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-duplicate links connect, the one with the smallest id stays."""
    gone = jaccard_join.jaccard_join(docs).where("doc_id <> class_id").select(F.col("doc_id").alias("__gone_id"))
    return docs.join(gone, F.col("doc_id") == F.col("__gone_id"), "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or edited, go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded bytes."""
    return byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", drop_leaks),
    ("byte_bpe", encode),
]

#: Training, alignment and token merging are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, others = table(spark, sf_dir, "documents"), set(written_paths(spark))
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        # What the stage read, its predecessor's table included, is done with.
        sweep(spark, keep=docs, of=set(written_paths(spark)) - others)
    return STAGES[-1][1](spark, docs, sf_dir)
