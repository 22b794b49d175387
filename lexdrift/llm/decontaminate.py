"""Benchmark decontamination: n-gram seeds, then local alignment (operator 3).

The benchmark is taken in blocks of bounded size, however large it is. Seeds are
pairs of neighbouring words of an item, whatever their frequency, and so many
of them are asked for as every alignment that reaches the threshold must have:
of n words m match and at most 2 m - 2 t n are edited (t: threshold), and an edit
parts two matched words at most, so 2 t n - m - 1 or more neighbours stay
neighbours, at least (2 t - 1) n - 1 of them. No edit, not even a word put in after
every second one, can hide an item. One scan joins seeds to texts, counts them
in windows by sorting, and aligns the words around them with the item by
Smith-Waterman, unless too few of the item's words stand there. Documents are
not shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexdrift.llm.common import each_text, handed_back, text_of, tune

GRAM = 2
MATCH, MISMATCH, GAP = 2, -1, -1
#: Letters of any script and digits are kept; other ASCII separates words.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
TABLE_BITS = 20
FOUND = "doc_id long, item_id long, score double, start_word int, end_word int"


def words_of(text: str) -> np.ndarray:
    words = text.lower().encode("utf-8", "replace").translate(WORD_BYTES).split()
    return np.fromiter(map(zlib.crc32, words), "u4", len(words))


def grams_of(words: np.ndarray, size: int = GRAM) -> np.ndarray:
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, "u8")
    x = np.zeros(n, "u8")
    for k in range(size):
        x = (x ^ words[k : k + n].astype("u8")) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
    return x


class Lookup:
    """The grams of a block of items, in flat arrays, found in texts by a table of words and a search.

    ``grams`` are distinct and sorted; ``begin`` gives where each one's entries
    stand in ``item``, ``low`` and ``high``: an item that has the gram, and its
    first and last place there.
    """

    def __init__(self, items: list[np.ndarray]):
        self.vocabulary = np.unique(np.concatenate(items)) if items else np.zeros(0, "u4")
        parts = [grams_of(w) for w in items]
        gram, sizes = np.concatenate(parts) if parts else np.zeros(0, "u8"), np.array([len(p) for p in parts], "i8")
        item = np.repeat(np.arange(len(parts), dtype="i4"), sizes)
        place = np.concatenate([np.arange(n, dtype="i4") for n in sizes.tolist()]) if parts else np.zeros(0, "i4")
        order = np.lexsort((place, item, gram))
        gram, item, place = gram[order], item[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (item[1:] != item[:-1])])[: len(gram)])
        self.item, self.low, self.high = item[first], place[first], place[np.append(first[1:], len(gram))[: len(first)] - 1]
        self.grams, begin = np.unique(gram[first], return_index=True)
        self.begin = np.append(begin, len(first))

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``words`` and numbers of the grams that begin there."""
        none = np.zeros(0, "i8")
        if len(words) < GRAM or not len(self.grams):
            return none, none
        if not hasattr(self, "known"):
            self.known = np.zeros(1 << TABLE_BITS, bool)
            self.known[self.vocabulary & np.uint32((1 << TABLE_BITS) - 1)] = True
        k = self.known[words & np.uint32((1 << TABLE_BITS) - 1)]
        at = np.flatnonzero(k[:-1] & k[1:])
        if not len(at):
            return none, none
        x = np.zeros(len(at), "u8")
        for j in range(GRAM):
            x = (x ^ words[at + j].astype("u8")) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(31)
        number = np.minimum(np.searchsorted(self.grams, x), len(self.grams) - 1)
        hit = self.grams[number] == x
        return at[hit], number[hit]

    def spans(self, words: np.ndarray, sizes: np.ndarray, threshold: float) -> dict[int, list[list[int]]]:
        """For each item with seeds enough in ``words``: stretches of words where it may stand, apart and in order.

        A gram's first and last place in the item bound where the item begins,
        so a text or an item that repeats itself gives one stretch a place.
        """
        at, number = self.find(words)
        if not len(at):
            return {}
        many = self.begin[number + 1] - self.begin[number]
        entry = np.repeat(self.begin[number] - np.cumsum(many) + many, many) + np.arange(many.sum())
        item, place = self.item[entry], np.repeat(at, many)
        order = np.lexsort((place, item))
        item, place, entry = item[order], place[order], entry[order]
        # So many seeds lie in some window as long as an alignment can be.
        size = sizes[item]
        slack = np.ceil((2 - 2 * threshold) * size).astype("i8") + 1
        needed = np.maximum(1, np.ceil((2 * threshold - 1) * size - 1 - 1e-9)).astype("i8")
        here = np.arange(len(item))
        last = np.minimum(here + needed - 1, len(item) - 1)
        enough = (here + needed - 1 < len(item)) & (item[last] == item) & (place[last] - place <= size + slack)
        marks = np.zeros(len(item) + 1, "i8")
        np.add.at(marks, here[enough], 1)
        np.add.at(marks, last[enough] + 1, -1)
        kept = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
        low = np.maximum(0, place - self.high[entry] - slack)
        high = np.minimum(len(words), place - self.low[entry] + size + slack)
        out: dict[int, list[list[int]]] = {}
        for k, x, y in zip(item[kept].tolist(), low[kept].tolist(), high[kept].tolist()):
            spans = out.setdefault(k, [])
            if spans and x <= spans[-1][1] and y >= spans[-1][0]:
                spans[-1] = [min(x, spans[-1][0]), max(y, spans[-1][1])]
            else:
                spans.append([x, y])
        return {k: joined(spans) for k, spans in out.items()}


def joined(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(high, out[-1][1])
        else:
            out.append([low, high])
    return out


class Runs:
    """Items too short to align: found where all their words run."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in sorted({len(w) for _, w in items}):
            numbers = np.array([k for k, w in items if len(w) == size], "i8")
            hashes = np.array([grams_of(w, size)[0] for _, w in items if len(w) == size], "u8")
            order = np.argsort(hashes, kind="stable")
            self.by_size[size] = hashes[order], numbers[order]

    def find(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first word, end) of the first run of each item."""
        for size, (hashes, numbers) in self.by_size.items():
            x, places = np.unique(grams_of(words, size), return_index=True)
            lows, highs = np.searchsorted(hashes, x, "left"), np.searchsorted(hashes, x, "right")
            for k in np.flatnonzero(highs > lows).tolist():
                yield from ((number, int(places[k]), int(places[k]) + size) for number in numbers[lows[k] : highs[k]].tolist())


def smith_waterman(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local score, and the end (exclusive) in the item and in the text of an alignment that has it."""
    steps = np.arange(len(text) + 1) * -GAP
    above = np.zeros(len(text) + 1, "i4")
    best = (0, 0, 0)
    for k, word in enumerate(item, 1):
        row = np.zeros_like(above)
        row[1:] = np.maximum(above[:-1] + np.where(text == word, MATCH, MISMATCH), above[1:] + GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + steps) - steps
        if (top := int(row.max())) > best[0]:
            best = (top, k, int(row.argmax()))
        above = row
    return best


def blocks_of(benchmark: DataFrame, most_bytes: int) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """Items of each block: about ``most_bytes`` of text at a time come to the driver."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // most_bytes))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        items = [(r.item_id, words_of(r.text)) for r in part.toLocalIterator()]
        if items := sorted(((i, w) for i, w in items if len(w)), key=lambda x: (x[0] is not None, x[0] or 0)):
            yield items


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, least_words: int = 8, most_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, item_id, score, start_word, end_word: documents that hold an item, whole or edited, once for each item.

    ``score`` is the best local alignment (match 2, mismatch and gap -1) over
    the highest possible; ``threshold`` 0.6 is passed by a copy with about a
    quarter of its words replaced. Above half, and with ``least_words`` over
    2 / (2 threshold - 1), every alignment that reaches it is found. Places count words of the text, from 0, end
    exclusive. Words are compared in lower case without ASCII punctuation. Null
    texts are empty; null ids are kept as such; repeated rows are reported each
    time. Edited copies of items under ``least_words`` words could stand
    anywhere by chance: those are found where all their words run, and score 1.
    Items without words, no items or no documents: no rows. Other columns are
    ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    parts = [_of_block(rows, items, threshold, least_words) for items in blocks_of(benchmark, most_bytes)]
    if not parts:
        return spark.createDataFrame([], FOUND)
    return reduce(DataFrame.unionByName, parts)


def _of_block(rows: DataFrame, items: list[tuple[int | None, np.ndarray]], threshold: float, least_words: int) -> DataFrame:
    aligned = [(i, w) for i, w in items if len(w) >= max(least_words, GRAM)]
    runs = Runs([(k, w) for k, (_, w) in enumerate(items) if len(w) < max(least_words, GRAM)])
    names = [i for i, _ in items]
    plan = rows.sparkSession.sparkContext.broadcast((aligned, Lookup([w for _, w in aligned]), names, runs))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligned, lookup, names, runs = plan.value
        sizes = np.array([len(w) for _, w in aligned], "i8")
        for batch, texts in each_text(batches):
            made: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                words = words_of(text)
                for k, spans in lookup.spans(words, sizes, threshold).items():
                    if (hit := best_in(aligned[k][1], words, spans, threshold)) is not None:
                        made.append((doc_id, aligned[k][0], *hit))
                made += [(doc_id, names[k], 1.0, a, b) for k, a, b in runs.find(words)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made) if made else [[]] * 5, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "score", "start_word", "end_word"])

    return rows.mapInArrow(handed_back(align), FOUND)


def best_in(item: np.ndarray, words: np.ndarray, spans: list[list[int]], threshold: float) -> tuple[float, int, int] | None:
    """The best alignment of the item within the stretches, if it reaches the threshold."""
    values, copies = np.unique(item, return_counts=True)
    needed, best = threshold * len(item), None
    for low, high in spans:
        text = words[low:high]
        found, n = np.unique(text[np.isin(text, values)], return_counts=True)
        # No alignment matches more words than both have.
        if np.minimum(n, copies[np.searchsorted(values, found)]).sum() < needed:
            continue
        top, i, j = smith_waterman(item, text)
        score = top / (MATCH * len(item))
        if score >= threshold and (best is None or score > best[0]):
            _, _, back = smith_waterman(item[:i][::-1], text[:j][::-1])
            best = (score, low + j - back, low + j)
    return best


def without_leaks(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``docs`` without the rows whose id ``find_leaks`` reports; rows with a null id stay."""
    found = find_leaks(docs, benchmark, **settings).select(F.col("doc_id").alias("__leaked")).where("__leaked is not null").distinct()
    return docs.join(found, F.col("doc_id").cast("long") == F.col("__leaked"), "left_anti")
