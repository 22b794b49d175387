"""Orthogonal alignment of slice vectors, PCA and projections."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexdrift.lineage import cut
from lexdrift.operators.usages import Encoder, hashed_order


def cross_products(vecs: DataFrame, anchors: DataFrame) -> dict[tuple[str, str], tuple[np.ndarray, int]]:
    """(earlier, later) -> (A'B over their shared anchors, how many): one d x d matrix a neighbouring pair comes to the driver.

    Each anchor's outer products are summed within its task, and the tasks' sums
    by pair on the executors, so what is gathered depends neither on the number
    of words nor on that of tasks.
    """
    labels = [r[0] for r in vecs.select("slice").distinct().orderBy("slice").collect()]
    known = vecs.join(anchors.select("word").distinct(), "word", "left_semi").select("word", "slice", "vec")
    schema = "t1 string, t2 string, m binary, n long"

    def products(frames):
        sums: dict[tuple[str, str], list] = {}
        for frame in frames:
            for slices, rows in zip(frame["slices"], frame["vecs"]):
                own = dict(zip(slices, rows))
                for a, b in zip(labels, labels[1:]):
                    if a in own and b in own:
                        s = sums.setdefault((a, b), [0, 0])
                        s[0] = s[0] + np.outer(np.asarray(own[a], "f8"), np.asarray(own[b], "f8"))
                        s[1] += 1
        yield pd.DataFrame([(a, b, s[0].tobytes(), s[1]) for (a, b), s in sums.items()], columns=["t1", "t2", "m", "n"])

    by_word = known.groupBy("word").agg(F.collect_list("slice").alias("slices"), F.collect_list("vec").alias("vecs"))

    def summed(key, parts: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(bytes(m)) for m in parts["m"])
        return pd.DataFrame([(key[0], key[1], total.tobytes(), int(parts["n"].sum()))], columns=["t1", "t2", "m", "n"])

    found = by_word.mapInPandas(products, schema).groupBy("t1", "t2").applyInPandas(summed, schema).collect()
    out: dict[tuple[str, str], tuple[np.ndarray, int]] = {}
    for r in found:
        m = np.frombuffer(bytes(r.m))
        out[r.t1, r.t2] = (m.reshape(int(round(len(m) ** 0.5)), -1), r.n)
    return out


def procrustes(m: np.ndarray) -> np.ndarray:
    """The rotation R that brings A closest to B in A R, given A'B."""
    u, _, v = np.linalg.svd(m)
    return u @ v


def rotations(vecs: DataFrame, anchors: DataFrame, reference: str | None = None, least: int = 10) -> dict[str, np.ndarray]:
    """Each slice's rotation into the space of ``reference`` (the last slice by default), by products along the chain of neighbours."""
    labels = [r[0] for r in vecs.select("slice").distinct().orderBy("slice").collect()]
    reference = reference or labels[-1]
    if reference not in labels:
        raise ValueError(f"no slice {reference!r}")
    found = cross_products(vecs, anchors)
    for pair in zip(labels, labels[1:]):
        if found.get(pair, (0, 0))[1] < least:
            raise ValueError(f"{pair[0]} and {pair[1]} share {found.get(pair, (0, 0))[1]} anchors; {least} are needed")
    d = len(next(iter(found.values()))[0]) if found else 0
    at = labels.index(reference)
    out = {reference: np.eye(d)} if d else {}
    for k in range(at - 1, -1, -1):
        out[labels[k]] = procrustes(found[labels[k], labels[k + 1]][0]) @ out[labels[k + 1]]
    for k in range(at + 1, len(labels)):
        out[labels[k]] = procrustes(found[labels[k - 1], labels[k]][0].T) @ out[labels[k - 1]]
    return out


def apply_rotations(vecs: DataFrame, turns: dict[str, np.ndarray]) -> DataFrame:
    """``vecs`` rotated by the matrix of their slice; one d x d matrix a slice travels with the tasks."""
    shipped = vecs.sparkSession.sparkContext.broadcast(turns)

    def run(frames):
        for frame in frames:
            turn = shipped.value
            frame = frame.copy()
            frame["vec"] = [None if v is None else (np.asarray(v, "f8") @ turn[s]).astype("f4") for s, v in zip(frame["slice"], frame["vec"])] if turn else frame["vec"]
            yield frame

    return vecs.mapInPandas(run, vecs.schema)


def align(vecs: DataFrame, anchors: DataFrame, reference: str | None = None, least: int = 10) -> DataFrame:
    return apply_rotations(vecs, rotations(vecs, anchors, reference, least))


def fit_pca(df: DataFrame, k: int, vector: str = "vec") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components [k, d], explained variance) of centred vectors. Each component's largest entry is positive."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector

    rows = df.where(F.col(vector).isNotNull()).select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("x"))
    centre = StandardScaler(inputCol="x", outputCol="c", withMean=True, withStd=False).fit(rows)
    model = PCA(k=k, inputCol="c", outputCol="p").fit(centre.transform(rows))
    parts = model.pc.toArray().T
    signs = np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(1)])
    return centre.mean.toArray(), parts * signs[:, None], model.explainedVariance.toArray()


def project(df: DataFrame, mean: np.ndarray, components: np.ndarray, vector: str = "vec", skip: int = 0, dims: int | None = None) -> DataFrame:
    """``vector`` replaced by its coordinates on components ``skip`` to ``skip + dims``; skipping the first ones is "all but the top"."""
    chosen = components[skip : None if dims is None else skip + dims]
    if dims is not None and len(chosen) < dims:
        raise ValueError(f"{len(components)} components; {skip} + {dims} are asked for")
    shipped = df.sparkSession.sparkContext.broadcast((mean, chosen))

    def run(frames):
        m, c = shipped.value
        for frame in frames:
            frame = frame.copy()
            frame[vector] = [None if v is None else (c @ (np.asarray(v, "f8") - m)).astype("f4") for v in frame[vector]]
            yield frame

    return df.mapInPandas(run, df.schema)


def fit_pca_by(vecs: DataFrame, k: int, vector: str = "vec") -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """slice -> (mean, components [k, d], variances along them, divisor n - 1) of each slice's vectors, all in one pass.

    Tasks sum vectors and their outer products a slice, executors add the sums
    up; a d x d matrix a slice comes to the driver. Each component's largest
    entry is positive.
    """
    schema = "slice string, n long, s binary, m binary"

    def sums(frames):
        parts: dict[str, list] = {}
        for frame in frames:
            for name, rows in frame.groupby("slice"):
                x = np.stack(rows[vector].to_numpy()).astype("f8")
                own = parts.setdefault(name, [0, 0.0, 0.0])
                own[0], own[1], own[2] = own[0] + len(x), own[1] + x.sum(0), own[2] + x.T @ x
        yield pd.DataFrame([(name, n, s.tobytes(), m.tobytes()) for name, (n, s, m) in parts.items()], columns=["slice", "n", "s", "m"])

    def added(key, parts: pd.DataFrame) -> pd.DataFrame:
        total = [sum(np.frombuffer(bytes(b)) for b in parts[c]) for c in "sm"]
        return pd.DataFrame([(key[0], int(parts["n"].sum()), total[0].tobytes(), total[1].tobytes())], columns=["slice", "n", "s", "m"])

    found = vecs.where(F.col(vector).isNotNull()).select("slice", vector).mapInPandas(sums, schema).groupBy("slice").applyInPandas(added, schema).collect()
    out = {}
    for r in found:
        mean = np.frombuffer(bytes(r.s)) / r.n
        v = np.frombuffer(bytes(r.m)).reshape(len(mean), -1) / r.n - np.outer(mean, mean)
        values, parts = np.linalg.eigh(v)
        parts = parts[:, ::-1][:, :k].T
        out[r.slice] = (mean, parts * np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(1)])[:, None], np.maximum(values[::-1][:k], 0) * r.n / max(r.n - 1, 1))
    return out


def project_by(vecs: DataFrame, models: dict[str, tuple[np.ndarray, ...]], dims: int, vector: str = "vec") -> DataFrame:
    """slice, word, ``vector`` as coordinates on its slice's components; 0 where there are fewer than ``dims``."""
    shipped = vecs.sparkSession.sparkContext.broadcast(models)

    def run(frames):
        for frame in frames:
            out = []
            for name, v in zip(frame["slice"], frame[vector]):
                mean, parts = shipped.value[name][:2]
                at = parts @ (np.asarray(v, "f8") - mean)
                out.append(np.concatenate([at, np.zeros(dims - len(at))]))
            yield pd.DataFrame({"slice": frame["slice"], "word": frame["word"], vector: out})

    return vecs.where(F.col(vector).isNotNull()).select("slice", "word", vector).mapInPandas(run, f"slice string, word string, {vector} array<double>")


def sampled_tokens(paragraphs: DataFrame, encoder: Encoder, most_paragraphs: int = 2_000, most_tokens: int = 200_000, seed: int = 42) -> DataFrame:
    """slice (empty), vec of the subwords of a seeded sample of paragraphs (text), up to ``most_tokens`` of them.

    Both bounds are the sample's. Paragraphs come in the order of a seeded hash;
    the last one is cut where the bound is met, by the running sum of what those
    before it have.
    """
    chosen = paragraphs.where("text is not null and text <> ''").select(hashed_order(seed, "text").alias("o"), "text").orderBy("o", "text").limit(most_paragraphs)

    def encode(frames):
        for frame in frames:
            yield pd.DataFrame({"o": frame["o"], "key": frame["text"].map(lambda t: hashlib.sha256(t.encode()).hexdigest()), "vecs": [[v.astype("f4") for v in states] for _, states in encoder(frame["text"].tolist())]})

    told = cut(chosen.mapInPandas(encode, "o long, key string, vecs array<array<float>>").withColumn("row", F.monotonically_increasing_id()), "tokens")
    # A row of two numbers for each of the sampled paragraphs.
    before = Window.orderBy("o", "key", "row").rowsBetween(Window.unboundedPreceding, -1)
    room = told.select("row", (F.lit(most_tokens) - F.coalesce(F.sum(F.size("vecs")).over(before), F.lit(0))).cast("int").alias("room")).where("room > 0")
    return told.join(room, "row").select(F.lit("").alias("slice"), F.explode(F.slice("vecs", F.lit(1), F.col("room"))).alias("vec"))


def token_pca(paragraphs: DataFrame, encoder: Encoder, k: int, folder: str, most_paragraphs: int = 2_000, most_tokens: int = 200_000, seed: int = 42, encoder_key: str = "", refit: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components, variances) of sampled tokens; kept below ``folder`` by a hash of all that it depends on, and read from there the next time.

    What it depends on are the settings, ``encoder_key`` and the paragraphs
    themselves, of which number and sum of hashes are taken.
    """
    spark = paragraphs.sparkSession
    mark = paragraphs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("text").cast("decimal(38,0)"))).first()
    key = hashlib.sha256(repr((k, most_paragraphs, most_tokens, seed, encoder_key, *map(str, mark))).encode()).hexdigest()
    path = f"{folder}/pca-{key}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if refit or not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        found = fit_pca_by(sampled_tokens(paragraphs, encoder, most_paragraphs, most_tokens, seed), k)
        if not found:
            raise ValueError("no paragraph has a token")
        mean, parts, values = found[""]
        spark.createDataFrame([(mean.tolist(), parts.tolist(), values.tolist())], "mean array<double>, components array<array<double>>, variances array<double>").coalesce(1).write.mode("overwrite").parquet(path)
    row = spark.read.parquet(path).first()
    return np.array(row["mean"]), np.array(row["components"]), np.array(row["variances"])
