"""Line dedup by pairwise alignment (operator 9).

Documents overlap where they share blocks: runs of neighbouring lines that hold
``least_chars`` characters together. Every such run is covered by its shortest
ones, of which a document has at most two a line: one begins and one ends at
each. The hashes of these windows find the pairs: each names the first document
that has it and its place there, by an aggregate, however many documents share
it. A pair is aligned over the stretches that its windows span, by patience
diff; where blocks stand in another order, so that one diff cannot hold them
all, the windows left over are aligned at the places that they name and grown
as far as both documents agree. Aligned blocks go from the later document.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexdrift.llm.common import drop_tables, handed_back, materialize, text_of, tune


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of two sequences: common ends, then the longest rising chain of items unique in both, then the gaps between alike."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        at_b = {x: k for k, x in enumerate(b[b0:b1], b0) if nb[x] == 1}
        pairs = [(k, at_b[x]) for k, x in enumerate(a[a0:a1], a0) if na[x] == 1 and x in at_b]
        if not pairs:
            continue
        x, y = a0, b0
        for p, q in [*rising(pairs), (a1, b1)]:
            work.append((x, p, y, q))
            if p < a1 or q < b1:
                out.append((p, q))
            x, y = p + 1, q + 1
    return sorted(out)


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs that rises in both places; pairs are sorted by the first."""
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, q) in enumerate(pairs):
        pile = bisect_left(tops, q)
        back[k] = last[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(q)
            last.append(k)
        else:
            tops[pile], last[pile] = q, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def blocks(aligned: list[tuple[int, int]]) -> Iterator[list[int]]:
    """Places in the second sequence of each maximal run of neighbours in both."""
    run: list[int] = []
    before = None
    for p, q in aligned:
        if before is not None and (p, q) != (before[0] + 1, before[1] + 1):
            yield run
            run = []
        run.append(q)
        before = (p, q)
    if run:
        yield run


#: Multiplier of the windows' rolling hashes, odd so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C13


def windows(lengths: np.ndarray, hashes: np.ndarray, chars: np.ndarray, least_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The shortest runs of ``least_chars`` characters from each line on and up to each line.

    Documents of ``lengths`` lines stand one after the other in ``hashes`` and
    ``chars``. Gives document number, hash, first and last place of each run.
    A run of as many characters is the union of those within it.
    """
    n = len(hashes)
    at = np.arange(n)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.cumsum(lengths)
    begin, end = (ends - lengths)[doc], ends[doc]
    total = np.concatenate([[0], np.cumsum(chars, dtype="i8")])
    to = np.maximum(np.searchsorted(total, total[:-1] + least_chars, "left"), at + 1)
    since = np.minimum(np.searchsorted(total, total[1:] - least_chars, "right") - 1, at)
    on, back = to <= end, since >= begin
    back &= to[np.maximum(since, 0)] != at + 1  # else it is that of its first line too
    doc, first, stop = np.concatenate([doc[on], doc[back]]), np.concatenate([at[on], since[back]]), np.concatenate([to[on], at[back] + 1])
    power, inverse = (np.cumprod(np.full(n, x, "u8")) for x in (BASE, pow(BASE, -1, 1 << 64)))
    sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(hashes * power, dtype="u8")])
    x = (sums[stop] - sums[first]) * inverse[first] + (stop - first).astype("u8")
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return doc, x, first - begin[first], stop - 1 - begin[first]


def aligned_blocks(a: list, b: list, chars: list[int], seeds: list[tuple[int, int, int]], least_chars: int) -> list[tuple[int, int]]:
    """First and last place in ``b`` of blocks of ``least_chars`` characters that ``a`` has too.

    Patience diff first; then each seed (place in a, place in b, lines) that is
    not covered yet, grown on both sides.
    """
    out = [(0, len(b) - 1)] if a == b else [(run[0], run[-1]) for run in blocks(patience(a, b))]
    out = [(x, y) for x, y in out if sum(chars[x : y + 1]) >= least_chars]
    covered = bytearray(len(b))
    for x, y in out:
        covered[x : y + 1] = b"\1" * (y + 1 - x)
    for p, q, n in seeds:
        if 0 not in covered[q : q + n] or a[p : p + n] != b[q : q + n]:
            continue
        stop = q + n
        while stop < len(b) and p + stop - q < len(a) and a[p + stop - q] == b[stop]:
            stop += 1
        while p and q and a[p - 1] == b[q - 1]:
            p, q = p - 1, q - 1
        out.append((q, stop - 1))
        covered[q:stop] = b"\1" * (stop - q)
    return out


def kept_runs(first: list[int], last: list[int]) -> tuple[list[tuple[int, int]], int]:
    """(place from 1, lines) of each run between the spans, the last one open; and how many lines the spans cover."""
    out, at, gone = [], 0, 0
    for a, b in sorted(zip(first, last)):
        if a > at:
            out.append((at + 1, a - at))
        gone += max(0, b + 1 - max(a, at))
        at = max(at, b + 1)
    return [*out, (at + 1, OPEN)], gone


#: Length of a run that goes on to the last line.
OPEN = 1 << 30
WINDOWS = "doc_id long, sig long, h long, first int, last int"
KEPT = "doc_id long, sig long, kept array<struct<a:int,n:int>>, n_removed long"


def repeated_lines(docs: DataFrame, least_chars: int = 20) -> DataFrame:
    """doc_id, sig, kept (array of (place from 1, lines)), n_removed: documents that lose blocks which an earlier one has.

    ``docs``: doc_id, sig (a hash of the text), text; ids not null. Rows of one
    id are not compared with each other; those that differ in text are told
    apart by ``sig``. Two hashes a line, 96 bits together, stand for its text.
    """
    lines = docs.select("doc_id", "sig", F.split("text", "\n").alias("lines"))
    lines = lines.select("doc_id", "sig", F.transform("lines", lambda x: F.xxhash64(x, F.lit(7))).alias("seq"), F.transform("lines", lambda x: F.hash(x)).alias("check"), F.transform("lines", lambda x: F.length(x)).alias("chars"))
    sequences = materialize(lines.dropDuplicates(["doc_id", "sig"]), "line-hashes")

    def window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column("seq")).to_numpy(zero_copy_only=False)
            seq, chars = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("seq", "chars"))
            doc, h, first, last = windows(lengths, seq.view("u8"), chars, least_chars)
            ids, sigs = (batch.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("doc_id", "sig"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sigs, pa.int64()), pa.array(h.view("i8")), pa.array(first.astype("i4")), pa.array(last.astype("i4"))], names=["doc_id", "sig", "h", "first", "last"])

    found = materialize(sequences.select("doc_id", "sig", "seq", "chars").mapInArrow(handed_back(window), WINDOWS), "line-windows")
    # Tables, so that the joins below have shuffles of their own on both sides, which Spark can split where a window or a first document is hot.
    owned = found.groupBy("h").agg(F.min(F.struct("doc_id", "sig", "first")).alias("o"), F.max("doc_id").alias("latest")).where("latest > o.doc_id")
    owned = materialize(owned.select("h", F.col("o.doc_id").alias("owner"), F.col("o.sig").alias("owner_sig"), F.col("o.first").alias("at")), "window-owners")
    shared = found.join(owned, "h").where("doc_id > owner")
    pairs = shared.groupBy("doc_id", "sig", "owner", "owner_sig").agg(F.collect_list(F.struct("at", "first", (F.col("last") - F.col("first") + 1).alias("n"))).alias("seeds"), F.min("at").alias("a0"), F.max(F.col("at") + F.col("last") - F.col("first")).alias("a1"), F.min("first").alias("b0"), F.max("last").alias("b1"))
    pairs = materialize(pairs, "line-pairs")
    drop_tables(found, owned)

    def stretch(column: str, a: str, b: str):
        return F.slice(column, F.col(a) + 1, F.col(b) - F.col(a) + 1)

    early = sequences.select(F.col("doc_id").alias("owner"), F.col("sig").alias("owner_sig"), F.col("seq").alias("owner_seq"), F.col("check").alias("owner_check"))
    both = pairs.join(early, ["owner", "owner_sig"]).withColumns({"owner_seq": stretch("owner_seq", "a0", "a1"), "owner_check": stretch("owner_check", "a0", "a1")}).drop("a1", "owner", "owner_sig")
    both = both.join(sequences, ["doc_id", "sig"]).withColumns({c: stretch(c, "b0", "b1") for c in ("seq", "check", "chars")}).drop("b1")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for i, sig, a0, b0, seeds, *sides, chars in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "sig", "a0", "b0", "seeds", "owner_seq", "owner_check", "seq", "check", "chars")), strict=True):
                a, b = list(zip(*sides[:2])), list(zip(*sides[2:]))
                at = [(s["at"] - a0, s["first"] - b0, s["n"]) for s in seeds]
                made += [(i, sig, b0 + x, b0 + y) for x, y in aligned_blocks(a, b, chars, at, least_chars)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made) if made else [[]] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "sig", "first", "last"])

    aligned = both.select("doc_id", "sig", "a0", "b0", "seeds", "owner_seq", "owner_check", "seq", "check", "chars").mapInArrow(handed_back(align), "doc_id long, sig long, first int, last int")
    spans = aligned.groupBy("doc_id", "sig").agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [kept_runs(a, b) for a, b in zip(batch.column("first").to_pylist(), batch.column("last").to_pylist(), strict=True)]
            kept = pa.array([[{"a": a, "n": n} for a, n in runs] for runs, _ in made], pa.list_(pa.struct([("a", pa.int32()), ("n", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sig"), kept, pa.array([n for _, n in made], pa.int64())], names=["doc_id", "sig", "kept", "n_removed"])

    return spans.mapInArrow(handed_back(merge), KEPT)


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_chars: int = 20, counts: bool = True) -> DataFrame:
    """``docs`` with its columns, its text without repeated lines, and with ``counts`` n_lines and n_removed.

    Lines are split at newlines only. The first document (smallest id) that has
    a block keeps it. A document all of whose lines go stays, with an empty
    text. A null text is the empty one, of one empty line. A row with a null id
    is compared with none and keeps its lines. Rows that repeat an id are each
    compared with smaller ids, not with each other. With ``counts``, columns
    named n_lines and n_removed are replaced; all other columns stay as they are.
    """
    tune(docs.sparkSession)
    ident, text = F.col(id_column).cast("long"), text_of(text_column)
    keyed = docs.select(ident.alias("doc_id"), text.alias("text")).where("doc_id is not null").withColumn("sig", F.xxhash64("text"))
    found = repeated_lines(keyed, least_chars).select(*(F.col(c).alias(f"__line_{c}") for c in ("doc_id", "sig", "kept", "n_removed")))
    joined = docs.withColumns({text_column: text}).join(found, (ident == F.col("__line_doc_id")) & (F.xxhash64(text_column) == F.col("__line_sig")), "left")
    lines = F.split(text_column, "\n")
    kept = F.when(F.col("__line_kept").isNull(), F.col(text_column)).otherwise(F.array_join(F.flatten(F.transform("__line_kept", lambda r: F.slice(lines, r["a"], r["n"]))), "\n"))
    made = {"n_lines": F.size(lines).cast("long"), "n_removed": F.coalesce("__line_n_removed", F.lit(0)).cast("long")} if counts else {}
    return joined.select(*(F.col(c) for c in docs.columns if c != text_column and c not in made), *(v.alias(k) for k, v in made.items()), kept.alias(text_column)).select(*(c for c in docs.columns if c not in made), *made)
