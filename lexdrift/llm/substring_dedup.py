"""Substring dedup with FM-indexes (operator 10).

Every run of ``window`` words that also starts in a document with a smaller id
is removed. Windows are dealt out by content: a window's anchor is the
smallest hash among its groups of ``GROUP`` words, so equal windows share
their anchor, and neighbouring windows with one anchor travel as one stretch
of words. Stretches whose anchor lies in one document only cannot match and
stay where they are; a filter of fixed size tells, erring on the safe side.
A task sends each content once. Each shard then builds
a compressed index over its stretches and streams them through it by backward
search; a match's range of suffixes yields the smallest document that has it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexdrift.llm.common import drop_tables, each_text, handed_back, materialize, reclaim, text_of, tune
from lexdrift.llm.fm_index import SEPARATOR, FmIndex

GROUP = 5
FILTER_PARTS = 64
SHARD_STRETCHES = 50_000
#: An anchor with more stretches than this is dealt out window by window.
HOT_ANCHOR = 100_000
HOT_PART_BITS = 1 << 16
SENT_KEYS = 300_000
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def words_of(text: str) -> list[bytes]:
    """Runs of characters other than space and the five ASCII controls from tab to carriage return."""
    return text.encode("utf-8", "replace").split()


def anchors(words: list[bytes], window: int) -> np.ndarray:
    """The anchor of each window of a document."""
    n = len(words)
    if n < window:
        return np.zeros(0, "i8")
    h = np.fromiter(map(zlib.crc32, words), "u4", n).astype("u8")
    group = min(GROUP, window)
    x = np.zeros(n - group + 1, "u8")
    for k in range(group):
        x = (x ^ h[k : n - group + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    x = x.view("i8")
    width = window - group + 1
    least, span = x, 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    return least


def stretches(anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of windows with one anchor."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1]) if len(anchor) else np.zeros(0, "i8")
    return starts, np.concatenate([starts[1:], [len(anchor)]]) if len(anchor) else starts


class AnchorFilter:
    """Bits of anchors, in parts by remainder so that each part is made by one task. Its size does not depend on the data."""

    def __init__(self, parts: dict[int, bytes], part_bits: int):
        self.part_bits = part_bits
        empty = bytes(part_bits // 8)
        self.bits = np.frombuffer(b"".join(parts.get(k, empty) for k in range(FILTER_PARTS)), "u1")

    @staticmethod
    def places(anchor: np.ndarray, part_bits: int) -> list[np.ndarray]:
        x = anchor.view("u8")
        return [(x >> np.uint64(s)) % np.uint64(part_bits) for s in (7, 31)]

    def has(self, anchor: np.ndarray) -> np.ndarray:
        part = (anchor.view("u8") % np.uint64(FILTER_PARTS)) * np.uint64(self.part_bits)
        found = np.ones(len(anchor), bool)
        for place in self.places(anchor, self.part_bits):
            at = part + place
            found &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype("u1") & 1).astype(bool)
        return found


def shared_anchors(rows: DataFrame, window: int) -> DataFrame:
    """anchor, n: anchors that lie in two documents or more, with their documents counted."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in each_text(batches):
            made = [np.unique(anchors(words_of(t), window)) for t in texts]
            ids = np.repeat(np.array(batch.column("doc_id").to_pylist(), "i8"), [len(m) for m in made])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(made) if made else np.zeros(0, "i8")), pa.array(ids)], names=["anchor", "doc_id"])

    found = rows.mapInArrow(emit, "anchor long, doc_id long")
    return found.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b").select("anchor", "n")


def filter_of(shared: DataFrame, part_bits: int) -> dict[int, bytes]:
    """The parts of the filter: at most ``FILTER_PARTS`` rows of ``part_bits`` / 8 bytes come to the driver, whatever the data."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            anchor = batch.column("anchor").to_numpy()
            part = anchor.view("u8") % np.uint64(FILTER_PARTS)
            for k in np.unique(part).tolist():
                bits = parts.setdefault(k, np.zeros(part_bits // 8, "u1"))
                for place in AnchorFilter.places(anchor[part == k], part_bits):
                    np.bitwise_or.at(bits, place >> np.uint64(3), np.left_shift(1, (place & np.uint64(7)).astype("u1")).astype("u1"))
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(parts), pa.int32()), "bits": pa.array([zlib.compress(b.tobytes(), 1) for b in parts.values()], pa.binary())})

    # 64 parts are those of the unsigned anchor: pmod by a power of two agrees with it.
    by_part = shared.select("anchor").repartition(FILTER_PARTS, F.pmod("anchor", F.lit(FILTER_PARTS)))
    found: dict[int, bytes] = {}
    for row in by_part.mapInArrow(build, "part int, bits binary").collect():
        found[row.part] = zlib.decompress(bytes(row.bits))
    return found


def covered_windows(text: list[bytes], first: np.ndarray, window: int) -> list[np.ndarray]:
    """For each stretch (words joined by spaces): per window, whether a stretch with a smaller first document has it."""
    split = [t.split(b" ") for t in text]
    sizes = np.array([len(s) for s in split], "i8")
    flat = pa.array([w for s in split for w in s], pa.binary()).dictionary_encode().indices.to_numpy() + 1
    owner = np.repeat(np.arange(len(split)), sizes + 1)
    stream = np.full(len(flat) + len(split), SEPARATOR, "i8")
    ends = np.cumsum(sizes + 1) - 1
    inside = np.ones(len(stream), bool)
    inside[ends] = False
    stream[inside] = flat
    index = FmIndex(stream, window)
    starts = ends - sizes
    counts = sizes - window + 1
    at = np.repeat(starts + window, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    length, low, high = index.matching(stream, at, window, alone=1)
    flags = np.zeros(len(at), bool)
    full = np.flatnonzero(length == window)
    if len(full):
        ranges, which = np.unique(low[full], return_inverse=True)
        tops = np.zeros(len(ranges), "i8")
        tops[which] = high[full]
        docs = np.append(first[owner[index.suffixes]], np.iinfo("i8").max)
        least = np.minimum.reduceat(docs, np.stack([ranges, tops], 1).ravel())[::2]
        flags[full] = least[which] < first[owner[at[full] - 1]]
    return np.split(flags, np.cumsum(counts)[:-1])


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype("i1"), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def matched_windows(docs: DataFrame, window: int = 13, part_bits: int = 1 << 22) -> DataFrame:
    """doc_id, sig, runs (array of [from, to) window places) of windows that start in a smaller document too.

    ``docs``: doc_id, sig (a hash of the text), text; no null ids. Rows of one
    id that differ in text are told apart by ``sig``.
    """
    spark = docs.sparkSession
    shared = materialize(shared_anchors(docs, window), "anchors")
    reclaim(spark)
    # Both filters are of fixed size; an anchor taken for hot by mistake is dealt out by windows everywhere, which finds the same.
    shipped = spark.sparkContext.broadcast(filter_of(shared, part_bits))
    hot = spark.sparkContext.broadcast(filter_of(shared.where(F.col("n") > HOT_ANCHOR), HOT_PART_BITS))
    n_stretches = shared.agg(F.sum("n")).first()[0] or 0
    drop_tables(shared)
    n_shards = max(1, -(-n_stretches // SHARD_STRETCHES))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hot_ones, sent = AnchorFilter(shipped.value, part_bits), AnchorFilter(hot.value, HOT_PART_BITS), set()
        for batch, texts in each_text(batches):
            shards, ids, sigs, places, contents = [], [], [], [], []
            for doc_id, sig, text in zip(batch.column("doc_id").to_pylist(), batch.column("sig").to_pylist(), texts, strict=True):
                words = words_of(text)
                anchor = anchors(words, window)
                a, b = stretches(anchor)
                keep = known.has(anchor[a])
                a, b = a[keep], b[keep]
                by_window = hot_ones.has(anchor[a])
                for x, y, m, alone in zip(a.tolist(), b.tolist(), anchor[a].tolist(), by_window.tolist()):
                    for p, q in ([(k, k + 1) for k in range(x, y)] if alone else [(x, y)]):
                        content = b" ".join(words[p : q + window - 1])
                        shards.append((zlib.crc32(content) if alone else m) % n_shards)
                        ids.append(doc_id)
                        sigs.append(sig)
                        places.append(p)
                        contents.append(content)
            keys = [hashlib.blake2b(c, digest_size=12).digest() for c in contents]
            at = [p << 32 | c.count(b" ") + 2 - window for p, c in zip(places, contents)]
            if len(sent) > SENT_KEYS:
                sent.clear()
            for k, key in enumerate(keys):  # a task need not send a content twice
                if key in sent:
                    contents[k] = None
                sent.add(key)
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(sigs, pa.int64()), pa.array(at, pa.int64()), pa.array(contents, pa.binary())], names=["shard", "key", "doc_id", "sig", "at", "content"])

    found = materialize(docs.mapInArrow(handed_back(emit), "shard int, key binary, doc_id long, sig long, at long, content binary"), "stretches")
    reclaim(spark)
    owners = found.groupBy("shard", "key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    contents = found.where("content is not null").select("shard", "key", "content")

    def search(owners: pa.Table, contents: pa.Table) -> pa.Table:
        place = {key: k for k, key in enumerate(contents.column("key").to_pylist())}
        keys = owners.column("key")
        first, last = owners.column("first").to_numpy(), owners.column("last").to_numpy()
        texts = contents.column("content").take(pa.array([place[key] for key in keys.to_pylist()])).to_pylist()
        own = [runs(f) for f in covered_windows(texts, first, window)]
        keep = np.flatnonzero((first < last) | np.array([bool(o) for o in own], bool))
        flat = pa.array([[{"a": a, "b": b} for a, b in own[k]] for k in keep], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
        return pa.table({"key": keys.take(pa.array(keep)), "first": first[keep], "own": flat})

    results = owners.groupBy("shard").cogroup(contents.groupBy("shard")).applyInArrow(search, "key binary, first long, own array<struct<a:int,b:int>>")
    # ``at`` is the place, and in its lower half the number of windows.
    place, n_windows = F.shiftright("at", 32).cast("int"), F.col("at").bitwiseAND(0xFFFFFFFF).cast("int")
    occurring = found.select("key", "doc_id", "sig", "at").join(results, "key")
    whole = F.array(F.struct(place.alias("a"), (place + n_windows).alias("b")))
    shifted = F.transform("own", lambda r: F.struct((r.a + place).alias("a"), (r.b + place).alias("b")))
    spans = occurring.select("doc_id", "sig", F.when(F.col("doc_id") > F.col("first"), whole).otherwise(shifted).alias("runs")).where(F.size("runs") > 0)
    return spans.groupBy("doc_id", "sig").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def remove_repeats(docs: DataFrame, window: int = 13, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256[, kept] of each row.

    A word goes if a window that covers it also starts in a row with a smaller
    id; windows are those of the input. A null text has no words. A null id is
    neither smaller nor larger than another: its row keeps all words. Rows
    with equal ids are each judged against smaller ids alone, whatever their
    texts. Other columns are ignored.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text")).select("doc_id", F.xxhash64("text").alias("sig"), "text")
    found = matched_windows(rows.where("doc_id is not null"), window)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch, texts in each_text(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sig"), pa.array([squeeze(t.encode("utf-8", "replace")) for t in texts], pa.binary())], names=["doc_id", "sig", "packed"])

    # Texts cross the shuffle packed: half of what Spark's own codec leaves.
    joined = rows.mapInArrow(handed_back(pack), "doc_id long, sig long, packed binary").join(found, ["doc_id", "sig"], "left")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            n_words, n_removed, digests, kept = [], [], [], []
            for packed, spans in zip(batch.column("packed").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                words = unpack(packed).split()
                gone = np.zeros(len(words) + 1, "i4")
                for s in spans or ():
                    gone[s["a"]] += 1
                    gone[s["b"] + window - 1] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                rest = b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if spans else words)
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    out = joined.mapInArrow(handed_back(keep), RESULT)
    return out if with_text else out.drop("kept")
