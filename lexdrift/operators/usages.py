"""Usages of words in paragraphs: search, sampling, encoding and pooling."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_CHARS = 50
LISTED = 2000


def find_usages(paragraphs: DataFrame, words: DataFrame, keys: list[str], min_chars: int = MIN_CHARS) -> DataFrame:
    """word, keys, char_start, char_end: whole-word occurrences, in any case, in paragraphs of ``min_chars`` or more.

    A word of word characters matches exactly where a whole run of them equals
    it, so runs are compared with the words; no pattern over the vocabulary is
    built. Up to ``LISTED`` words are looked up while runs are walked through,
    which keeps only their places; a larger vocabulary is joined.
    """
    listed = [r[0] for r in words.where("word is not null").select(F.lower("word")).distinct().limit(LISTED + 1).collect()]
    few = len(listed) <= LISTED
    rows = paragraphs.where(F.length("text") >= min_chars)
    runs = F.regexp_extract_all("text", F.lit(r"(?U)\w+"), F.lit(0))
    gaps = F.split("text", r"(?U)\w+")
    # A run starts after all gaps and runs before it: fold lengths from the left.
    step = F.transform(F.sequence(F.lit(0), F.size("__runs") - 1), lambda k: F.struct(F.get("__runs", k).alias("r"), F.length(F.get("__gaps", k)).alias("g")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<word:string,a:int>>").alias("out"))

    def fold(s: Column, x: Column) -> Column:
        start = s.at + x.g
        more = F.concat(s.out, F.array(F.struct(F.lower(x.r).alias("word"), start.alias("a"))))
        return F.struct((start + F.length(x.r)).alias("at"), (F.when(F.lower(x.r).isin(listed), more).otherwise(s.out) if few else more).alias("out"))

    placed = rows.select(*keys, runs.alias("__runs"), gaps.alias("__gaps")).where(F.size("__runs") > 0)
    found = placed.select(*keys, F.explode(F.aggregate(step, zero, fold, lambda s: s.out)).alias("u")).select(*keys, F.col("u.word").alias("word"), F.col("u.a").alias("char_start"), (F.col("u.a") + F.length("u.word")).alias("char_end"))
    if not few:
        found = found.join(words.select(F.lower("word").alias("word")).distinct(), "word", "left_semi")
    return found.select("word", *keys, "char_start", "char_end")


def hashed_order(seed: int, *keys: str) -> Column:
    return F.xxhash64(F.lit(seed), *keys)


def sample_per_key(df: DataFrame, by: list[str], ids: list[str], n: int | Column, seed: int = 42) -> DataFrame:
    """At most ``n`` rows a key without replacement, by the order of a seeded hash. The cap is what the operator samples."""
    order = Window.partitionBy(*by).orderBy(hashed_order(seed, *by, *ids), *ids)
    return df.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r")


def weighted_sample(df: DataFrame, weight: str, ids: list[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement with chances as their weights (Efraimidis and Spirakis, 2006)."""
    u = (F.pmod(hashed_order(seed, *ids), F.lit(1 << 53)) + 1) / F.lit(float((1 << 53) + 1))
    return df.where(F.col(weight) > 0).withColumn("__k", F.log(u) / F.col(weight)).orderBy(F.desc("__k"), *ids).limit(n).drop("__k")


def stratified_sample(df: DataFrame, value: str, ids: list[str], n: int = 100, strata: int = 10, seed: int = 42) -> DataFrame:
    """``n`` / ``strata`` rows of each quantile bin of ``value``, with the bin (from 0) as ``decile``."""
    from lexdrift.functions import ranks

    ranked = ranks.average_rank(df, value, "__rank")
    binned = ranks.quantile_bins(ranked, "__rank", "decile", strata, first=0).drop("__rank")
    return sample_per_key(binned, ["decile"], ids, n // strata, seed)


def proportional_sample(df: DataFrame, by: str, ids: list[str], n: int, seed: int = 42) -> DataFrame:
    """From each group max(1, round(n * its share)) rows."""
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("__c"))
    total = sizes.agg(F.sum("__c").alias("__t"))
    share = sizes.crossJoin(F.broadcast(total)).select(by, F.greatest(F.lit(1), F.bround(n * F.col("__c") / F.col("__t"), 0).cast("int")).alias("__take"))
    return sample_per_key(df.join(share, by), [by], ids, F.col("__take"), seed).drop("__take")


def paragraphs_to_encode(paragraphs: DataFrame, usages: DataFrame, keys: list[str]) -> DataFrame:
    """Each paragraph that a usage needs, once."""
    return paragraphs.join(usages.select(*keys).distinct(), keys, "left_semi")


#: text -> (offsets [n, 2] of subwords in characters, vectors [n, d])
Encoder = Callable[[list[str]], list[tuple[np.ndarray, np.ndarray]]]


class HashEncoder:
    """A deterministic stand-in for a contextual encoder: a subword's vector mixes hashes of itself and its neighbours.

    Words are cut into subwords of at most ``piece`` characters and texts into
    ``most`` subwords, as encoders truncate.
    """

    def __init__(self, dim: int = 16, piece: int = 4, most: int = 512):
        self.dim, self.piece, self.most = dim, piece, most

    def vector(self, word: str) -> np.ndarray:
        import zlib

        return np.random.default_rng(zlib.crc32(word.lower().encode())).standard_normal(self.dim)

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        import re

        out = []
        for text in texts:
            spans = [(a, min(a + self.piece, m.end())) for m in re.finditer(r"\w+", text) for a in range(m.start(), m.end(), self.piece)][: self.most]
            own = np.array([self.vector(text[a:b]) for a, b in spans]).reshape(len(spans), self.dim)
            near = own.copy()
            near[1:] += 0.5 * own[:-1]
            near[:-1] += 0.5 * own[1:]
            out.append((np.array(spans, int).reshape(-1, 2), near.astype("f2").astype("f4")))
        return out


#: Words of trained vectors that an encoder carries to the tasks.
MOST_VECTORS = 1_000_000


class VectorEncoder:
    """A contextual encoder from trained word vectors: a word's state is its own vector and those of the words around it, the nearer the heavier.

    ``vectors`` (word, vec) are one slice's, as the trainer gives them; more than
    ``MOST_VECTORS`` are refused. Words without a vector have no state of their
    own and lend none. Texts are cut at ``most`` words, as encoders truncate.
    """

    def __init__(self, vectors: DataFrame, reach: int = 5, own: float = 0.5, most: int = 512):
        rows = vectors.where("vec is not null").select(F.lower("word").alias("word"), "vec").limit(MOST_VECTORS + 1).collect()
        if len(rows) > MOST_VECTORS:
            raise ValueError(f"more than {MOST_VECTORS} vectors; give those of a tier")
        self.number = {r.word: k for k, r in enumerate(rows)}
        self.vectors = np.array([r.vec for r in rows], "f4")
        self.reach, self.own, self.most = reach, own, most

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        import re

        out = []
        for text in texts:
            found = [(m.start(), m.end(), self.number.get(m[0].lower(), -1)) for m in re.finditer(r"\w+", text)][: self.most]
            known = [k for k, (_, _, n) in enumerate(found) if n >= 0]
            if not known:
                out.append((np.zeros((0, 2), int), np.zeros((0, self.vectors.shape[1] if len(self.vectors) else 0), "f4")))
                continue
            x = self.vectors[[found[k][2] for k in known]]
            apart = np.abs(np.subtract.outer(known, known))
            weight = np.where((apart > 0) & (apart <= self.reach), 1 / np.maximum(apart, 1), 0)
            total = weight.sum(1, keepdims=True)
            around = weight @ x / np.where(total > 0, total, 1)
            out.append((np.array([found[k][:2] for k in known]), np.where(total > 0, self.own * x + (1 - self.own) * around, x).astype("f4")))
        return out


def pool_span(offsets: np.ndarray, vectors: np.ndarray, start: int, end: int) -> np.ndarray | None:
    """Mean over the subwords that lie within the span; None if none does."""
    inside = (offsets[:, 0] >= start) & (offsets[:, 1] <= end) & (offsets[:, 1] > offsets[:, 0])
    return vectors[inside].mean(0) if inside.any() else None


def embed_usages(paragraphs: DataFrame, usages: DataFrame, keys: list[str], encoder: Encoder, batch: int = 16) -> DataFrame:
    """keys, word, char_start, char_end, emb of each usage; emb is null where truncation cut its subwords off.

    A paragraph meets all its usages in one row and is encoded once; states
    stay within the task.
    """
    spans = usages.groupBy(*keys).agg(F.collect_list(F.struct("word", "char_start", "char_end")).alias("spans"))
    rows = paragraphs.select(*keys, "text").join(spans, keys)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", word string, char_start int, char_end int, emb array<float>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k in range(0, len(frame), batch):
                part = frame.iloc[k : k + batch]
                for (_, row), (offsets, states) in zip(part.iterrows(), encoder(part["text"].tolist()), strict=True):
                    for s in row["spans"]:
                        emb = pool_span(offsets, states, s["char_start"], s["char_end"])
                        out.append([*(row[x] for x in keys), s["word"], s["char_start"], s["char_end"], emb])
            yield pd.DataFrame(out, columns=[*keys, "word", "char_start", "char_end", "emb"])

    return rows.mapInPandas(run, schema)


def extraction_failures(embedded: DataFrame) -> DataFrame:
    return embedded.agg(F.count(F.lit(1)).alias("n_usages"), F.count_if(F.col("emb").isNull()).alias("n_failed"))
