"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams (operator 5).

Features of a text are its distinct words, pairs of neighbours and pairs with
one or two words between them, hashed into ``2 ** BITS`` places. The learner
keeps two sums a place (McMahan et al., 2013), which give every coordinate a
rate of its own and leave a weight at nought until the evidence for it passes
the L1 bound. What remains is small enough to ship with the scoring tasks: by
construction no more than ``2 ** BITS`` pairs of place and weight.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from lexdrift.llm.common import drop_tables, each_text, handed_back, materialize, text_of, tune

BITS = 22
SKIPS = (1, 2, 3)
#: ASCII letters, digits and all bytes of longer characters are kept; the rest separates words.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


@dataclass(frozen=True)
class Settings:
    """``most_rows`` bounds the labelled rows that the learner sees: those with the smallest hash of their id."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 0.1
    epochs: int = 6
    most_rows: int = 16_384


def features(text: str) -> np.ndarray:
    """Hashed places of a text's words and word pairs; places may repeat."""
    words = text.lower().encode("utf-8", "replace").translate(WORD_BYTES).split()
    h = np.fromiter(map(zlib.crc32, words), "u4", len(words)).astype("u8")
    parts = [mixed(h * np.uint64(0x9E3779B97F4A7C15))]
    parts += [mixed(h[:-k] * np.uint64(0xC2B2AE3D27D4EB4F) + h[k:] * np.uint64(0x165667B19E3779F9) + np.uint64(min(k, 2))) for k in SKIPS if len(h) > k]
    return np.concatenate(parts).astype("u4")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x >> np.uint64(64 - BITS)


class Ftrl:
    def __init__(self, settings: Settings):
        self.s = settings
        self.z = np.zeros(1 << BITS, "f4")
        self.n = np.zeros(1 << BITS, "f4")
        self.bias = [0.0, 0.0]

    def weights(self, z, n):
        s = self.s
        return np.where(np.abs(z) <= s.l1, 0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    def bias_weight(self) -> float:
        z, n = self.bias
        return -z / ((self.s.beta + n**0.5) / self.s.alpha)

    def learn(self, places: np.ndarray, label: int) -> None:
        z, n = self.z[places], self.n[places]
        w, b = self.weights(z, n), self.bias_weight()
        g = squashed(w.sum() + b) - label
        self.z[places] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha * w
        self.n[places] = n + g * g
        old = self.bias[1]
        self.bias[0] += g - ((old + g * g) ** 0.5 - old**0.5) / self.s.alpha * b
        self.bias[1] = old + g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights(self.z, self.n)
        at = np.flatnonzero(w)
        return at.astype("i4"), w[at].astype("f4")


def squashed(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


@dataclass(frozen=True)
class Model:
    places: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, "f4")
        out[self.places] = self.weights
        return out

    def score(self, text: str, table: np.ndarray) -> float:
        at = features(text)
        at = np.unique(at[table[at] != 0])
        return squashed(float(table[at].astype("f8").sum()) + self.bias)


def smallest_by_hash(known: DataFrame, most_rows: int) -> DataFrame:
    """The ``most_rows`` rows whose id has the smallest hash. Of many rows only those below a bound, twice as many as needed, are sorted."""
    order, n = F.xxhash64("doc_id"), known.count()
    if n > 4 * most_rows:
        below = known.where(order <= int(-(1 << 63) + (1 << 64) * (2 * most_rows / n)))
        if below.count() >= most_rows:
            known = below
    return known.orderBy(order, "doc_id").limit(most_rows)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from labelled texts: ``docs`` (doc_id, text), ``labels`` (doc_id, toxic).

    Rows with a null id or label teach nothing; an id with several labels counts
    once, as its highest; one of several texts of an id is taken, that with the
    smallest hash. Features are made on all executors; one task then reads at
    most ``most_rows`` of them, once an epoch, in the order of a hash, and holds
    a batch at a time. With no usable row the model has no weights and scores
    one half.
    """
    spark = docs.sparkSession
    tune(spark)
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    taken = smallest_by_hash(known, settings.most_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(taken), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "toxic", "t.text")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in each_text(batches):
            made = [np.unique(features(t)).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(made, pa.binary())], names=["doc_id", "toxic", "places"])

    featured_rows = rows.mapInArrow(handed_back(featured), "doc_id long, toxic int, places binary")
    sample = materialize(featured_rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("toxic", "places"), "toxic-sample")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, n = Ftrl(settings), 0
        for batch in batches:
            for places, label in zip(batch.column("places"), batch.column("toxic").to_pylist(), strict=True):
                learner.learn(np.frombuffer(places.as_buffer(), "u4"), label)
                n += 1
        if n:
            at, w = learner.sparse()
            yield pa.RecordBatch.from_pydict({"places": [at.tobytes()], "weights": [w.tobytes()], "bias": [learner.bias_weight()]})

    # One task reads the sorted file again for each epoch: nothing is shuffled or sorted, and parts of one file come in their order.
    found = reduce(DataFrame.unionAll, [sample] * settings.epochs).coalesce(1).mapInArrow(handed_back(fit), "places binary, weights binary, bias double").collect()
    drop_tables(sample)
    if not found:
        return Model(np.zeros(0, "i4"), np.zeros(0, "f4"), 0.0)
    row = found[0]
    return Model(np.frombuffer(bytes(row.places), "i4"), np.frombuffer(bytes(row.weights), "f4"), row.bias)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``docs`` with its columns, then score (double, 0 to 1) and predicted (int).

    A null or empty text gets the score of the bias alone. Rows pass through
    one by one: no shuffle, repeated rows keep their rows. Columns of ``docs``
    named score or predicted are replaced.
    """
    tune(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted")
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        table = model.table()
        for batch, texts in each_text(batches):
            scores = [model.score(t, table) for t in texts]
            columns = [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(handed_back(run), schema)


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``docs``, with all its columns as they are, without the rows that ``score`` predicts to be toxic."""
    tune(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        table = model.table()
        for batch, texts in each_text(batches):
            yield batch.filter(pa.array([model.score(t, table) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(handed_back(run), docs.schema)


def remainder(column: str = "doc_id"):
    """crc32 of the id as text, modulo 3; ids with remainder 1 are held out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3


def train_on_split(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    return train(docs, labels.where(remainder() != 1), settings)


def score_documents(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, learned from the labels that are not held out."""
    model = train_on_split(docs, labels, settings)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"))
    return score(rows, model).select("doc_id", "held_out", "score", "predicted")
