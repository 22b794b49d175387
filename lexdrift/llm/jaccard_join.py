"""N-gram Jaccard join by MinHash bands (operator 8).

Documents with equal shingle sets are one class from the start: only its
representative goes on. Band and row counts follow from the recall asked for.
A bucket of equal band hashes links its members to its least one, a row a
member, and what hangs together by such links is a cluster. Each clustered
representative's full shingle set is sent to its cluster's task, where pairs
with a bucket in common are verified. A large cluster is cut into blocks of
members that share their least leader, and a task verifies two blocks that have
a bucket in common; every pair with one meets there, so what is linked does not
depend on how a cluster is cut. Tasks put out counts and spanning edges, never
pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexdrift.llm.common import drop_tables, each_text, handed_back, materialize, text_of, tune
from lexdrift.llm.components import components

#: Representatives of one block: bounds the memory of a verifying task.
BLOCK = 384


def bands_for(threshold: float, recall: float, most_values: int = 256) -> tuple[int, int]:
    """(bands, rows): the most rows a band, thus the fewest false candidates, that reach ``recall`` at ``threshold``."""
    for rows in range(16, 0, -1):
        bands = 1
        while bands * rows <= most_values:
            if 1 - (1 - threshold**rows) ** bands >= recall:
                return bands, rows
            bands += 1
    raise ValueError("no band count within the values allowed reaches this recall")


def shingles(text: str, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of runs of ``n`` words (split at white space, unchanged); of all words where there are fewer."""
    words = text.encode("utf-8", "replace").split()
    if not words:
        return np.zeros(0, "i8")
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words))
    size = min(n, len(h))
    x = np.full(len(h) - size + 1, size if size < n else 0, "u8")
    for k in range(size):
        x = (x ^ h[k : len(h) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
    return np.unique(x.view("i8"))


def digest(items: np.ndarray) -> bytes | None:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of ``count`` hash functions, the same at every run."""
    draw = np.random.Generator(np.random.PCG64(20240229))
    return draw.integers(0, 1 << 31, count, dtype="u4") * np.uint32(2) + np.uint32(1), draw.integers(0, 1 << 32, count, dtype="u4")


def band_hashes(items: np.ndarray, factors: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    if not len(items):
        return np.zeros(0, "i8")
    x = items.view("u8")
    x = ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype("u4")
    least = np.full(bands * rows, 0xFFFFFFFF, "u4")
    for k in range(0, len(x), 512):
        least = np.minimum(least, (x[k : k + 512, None] * factors + offsets).min(0))
    values = least.reshape(bands, rows).astype("u8")
    out = np.arange(1, bands + 1, dtype="u8")
    for k in range(rows):
        out = (out ^ values[:, k]) * np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(30)
    return out.view("i8")


def signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, sig (digest of the shingle set; null for none), n_shingles, bands."""
    factors, offsets = permutations(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in each_text(batches):
            sets = [shingles(t, n) for t in texts]
            sigs = [digest(s) for s in sets]
            made = [band_hashes(s, factors, offsets, bands, rows) for s in sets]
            starts = pa.array(np.concatenate([[0], np.cumsum([len(m) for m in made])]).astype("i4"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sigs, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.ListArray.from_arrays(starts, pa.array(np.concatenate(made)))], names=["doc_id", "sig", "n_shingles", "bands"])

    return docs.mapInArrow(handed_back(run), "doc_id long, sig binary, n_shingles int, bands array<long>")


def overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every set of one list with every set of the other."""
    a, b = np.concatenate(left), np.concatenate(right)
    common, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = np.repeat(np.arange(len(left)), [len(s) for s in left]), np.repeat(np.arange(len(right)), [len(s) for s in right])
    ca, cb = codes[: len(a)], codes[len(a) :]
    oa, ob = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
    ca, ia, cb, ib = ca[oa], ia[oa], cb[ob], ib[ob]
    out = np.zeros((len(left), len(right)), "f4")
    for k in range(0, len(common), width):
        (a0, a1), (b0, b1) = np.searchsorted(ca, [k, k + width]), np.searchsorted(cb, [k, k + width])
        if a0 == a1 or b0 == b1:
            continue
        m, w = np.zeros((len(left), width), "f4"), np.zeros((len(right), width), "f4")
        m[ia[a0:a1], ca[a0:a1] - k] = 1
        w[ib[b0:b1], cb[b0:b1] - k] = 1
        out += m @ w.T
    return out


def share_a_band(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which rows of band hashes have one in common with which."""
    out = np.zeros((len(left), len(right)), bool)
    for a, b in zip(left.T, right.T):
        out |= a[:, None] == b[None, :]
    return out


def verify(ids: np.ndarray, copies: np.ndarray, block: np.ndarray, bands: np.ndarray, sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each representative within a pair of blocks, copies counted, and its root among those linked with it.

    Sets of one block meet each other; sets of two blocks meet those of the
    other block alone. A link needs a band in common, as in any other cluster.
    """
    two = block.min() != block.max()
    left = np.flatnonzero(block == block.min()) if two else np.arange(len(ids))
    right = np.flatnonzero(block == block.max()) if two else left
    sizes = np.array([len(s) for s in sets], "f8")
    inter = overlaps([sets[k] for k in left], [sets[k] for k in right]).astype("f8")
    union = sizes[left][:, None] + sizes[right][None, :] - inter
    near = (inter >= threshold * union - 1e-9) & share_a_band(bands[left], bands[right])
    if not two:
        np.fill_diagonal(near, False)
    links = np.zeros(len(ids), "i8")
    links[left] += near @ copies[right]
    if two:
        links[right] += near.T @ copies[left]
    root = np.arange(len(ids))
    while True:  # least label over links until nothing changes
        new = root.copy()
        seen = np.where(near, root[right][None, :], len(ids)).min(1, initial=len(ids))
        new[left] = np.minimum(new[left], seen)
        seen = np.where(near, new[left][:, None], len(ids)).min(0, initial=len(ids))
        new[right] = np.minimum(new[right], seen)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return links, ids[root]
        root = new


def placement(clusters: DataFrame, edges: DataFrame, buckets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rep, cluster, block, whole) of every clustered representative, and (block, tasks: array of (i, j)) of blocks that meet others.

    A cluster of up to ``BLOCK`` members is one block, ``whole``. In larger ones
    members go by the least leader of their buckets: a leader with many is cut
    by hash, others share a block by hash. Blocks that have a bucket in common
    meet in a task, and each block meets itself.
    """
    count = F.count(F.lit(1))
    # Tables, so that the joins have shuffles of their own on both sides, which Spark can split where a cluster or leader is hot.
    large = materialize(clusters.groupBy("cluster").agg(count.alias("size")).where(F.col("size") > BLOCK), "large-clusters")
    small = clusters.join(large, "cluster", "left_anti").select("rep", "cluster", F.xxhash64("cluster").alias("block"), F.lit(True).alias("whole"))
    homes = edges.groupBy(F.col("u").alias("rep")).agg(F.min("v").alias("home"))
    members = materialize(clusters.join(large, "cluster").join(homes, "rep", "left").withColumn("home", F.coalesce("home", "rep")), "large-members")
    groups = materialize(members.groupBy("cluster", "home").agg(count.alias("n")), "leaders")
    own = F.xxhash64("cluster", "home", F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / BLOCK)))
    mixed = F.xxhash64("cluster", F.pmod(F.xxhash64("home", F.lit(5)), F.ceil(F.col("size") / BLOCK)))
    cut = members.join(groups, ["cluster", "home"]).select("rep", "cluster", F.when(F.col("n") >= BLOCK, own).otherwise(mixed).alias("block"), F.lit(False).alias("whole"))
    placed = materialize(small.unionByName(cut), "placed")
    drop_tables(large, members, groups)
    cut = placed.where("not whole").select("rep", "block")
    held = materialize(buckets.join(cut, "rep").select("band", "block").distinct(), "blocks-of-buckets")
    met = held.join(held.select("band", F.col("block").alias("other")), "band").where("block < other").select(F.col("block").alias("i"), F.col("other").alias("j"))
    met = met.unionByName(cut.select(F.col("block").alias("i"), F.col("block").alias("j"))).distinct()
    tasks = met.select("*", F.explode(F.array_distinct(F.array("i", "j"))).alias("block")).groupBy("block").agg(F.collect_list(F.struct("i", "j")).alias("tasks"))
    return placed, materialize(tasks, "block-pairs")


def jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.997, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, class_id, n_links, n_shingles, one row a document.

    Two documents are linked if the Jaccard similarity of their sets of ``n``
    words running is at least ``threshold``; ``class_id`` is the smallest id
    among all that links connect, ``n_links`` the number of other documents
    linked, copies included. A candidate is missed with a chance of at most
    1 - ``recall`` a pair; a link that is reported is exact. A text of fewer
    than ``n`` words has one shingle of them all; a null or empty one has none
    and no link. Rows with a null id come back with a null class and no links.
    An id that repeats is one document, of that of its texts whose shingle set
    has the least digest. Other columns are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    bands, rows = bands_for(threshold, recall)
    keyed = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    signs = materialize(signed(keyed.where("doc_id is not null"), n, bands, rows), "signatures")
    member = signs.groupBy("doc_id").agg(F.min(F.struct("sig", "n_shingles")).alias("s")).select("doc_id", "s.*")
    classes = materialize(member.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    reps = signs.select("doc_id", "sig", "bands").join(classes, "sig").where("doc_id = rep")
    buckets = reps.select("rep", F.explode("bands").alias("band"))
    leaders = buckets.groupBy("band").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    buckets = materialize(buckets.join(leaders, "band").select("rep", "band", "leader"), "buckets")
    edges = buckets.where("rep <> leader").select(F.col("rep").alias("u"), F.col("leader").alias("v"))
    clusters = components(edges).select(F.col("node").alias("rep"), F.col("label").alias("cluster"))
    placed, pairs = placement(clusters, edges, buckets)
    drop_tables(buckets)
    placed = placed.join(classes.select("rep", "copies", "sig"), "rep").select(F.col("rep").alias("doc_id"), "sig", "cluster", "block", "whole", "copies")
    factors, offsets = permutations(bands * rows)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in each_text(batches):
            sets = [shingles(t, n) for t in texts]
            own = pa.array([digest(s) == sig for s, sig in zip(sets, batch.column("sig").to_pylist())], pa.bool_())  # another text of the id
            names = ["doc_id", "cluster", "whole", "block", "copies"]
            marks = pa.array([band_hashes(s, factors, offsets, bands, rows).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), marks, pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", *names[1:], "bands", "items"]).filter(own)

    sets = keyed.join(placed, "doc_id").select("doc_id", "text", "sig", "cluster", "whole", "block", "copies")
    sets = sets.mapInArrow(handed_back(packed), "rep long, cluster long, whole boolean, block long, copies long, bands binary, items binary")
    # Packed sets, not texts, meet their blocks' tasks.
    here = F.array(F.struct(F.col("block").alias("i"), F.col("block").alias("j")))
    tasks = sets.join(pairs, "block", "left").select("rep", "cluster", "whole", "block", "copies", "bands", "items", F.explode(F.coalesce("tasks", here)).alias("task")).select("*", "task.*")

    def check(group: pa.Table) -> pa.Table:
        ids = group.column("rep").to_numpy()
        ids, at = np.unique(ids, return_index=True)
        items, marks = (group.column(c).take(pa.array(at)).to_pylist() for c in ("items", "bands"))
        links, roots = verify(ids, group.column("copies").to_numpy()[at], group.column("block").to_numpy()[at], np.stack([np.frombuffer(x, "i8") for x in marks]), [np.frombuffer(x, "i8") for x in items], threshold)
        return pa.table({"rep": ids, "root": roots, "links": links, "whole": group.column("whole").take(pa.array(at))})

    found = materialize(tasks.select("rep", "cluster", "i", "j", "block", "whole", "copies", "bands", "items").groupBy("cluster", "i", "j").applyInArrow(check, "rep long, root long, links long, whole boolean"), "links")
    parts = found.where("not whole and rep <> root").select(F.col("rep").alias("u"), F.col("root").alias("v"))
    labels = found.where("whole and rep <> root").select(F.col("rep").alias("node"), F.col("root").alias("label")).unionByName(components(parts))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    by_class = classes.join(labels, classes.rep == labels.node, "left").drop("node").join(counts, "rep", "left")
    by_class = by_class.select("sig", F.coalesce("label", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = member.join(by_class, "sig", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_shingles")
    none = keyed.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("int").alias("n_shingles"))
    return out.unionByName(none)
