"""Token counts by a library's tokenizer, with overlap resynchronisation for huge documents (operator 13).

A document of up to ``chunk`` characters is counted as a whole: by the library,
or as the sum over its pieces between spaces, which are stable places (below),
with a bounded memo of the pieces met lately. A longer one is cut into windows
of that length, each with an overlap into the next, and windows are dealt to
tasks of their own. Each is encoded with offsets. Where a window's overlap and
the next window's beginning both start a token at a place that is proven
stable, the two are spliced there: tokens before it come from the first, those
from it on from the second. If an overlap has no such place it is widened over
the whole next window, and on for as long as needed; those windows become one
and are encoded again.

A place is proven stable if the tokenizer splits there whatever stands farther
to the left or right. For tokenizers that normalise character by character and
merge within the matches of their pattern that is so after a space, tab or line
break, and between two ASCII characters of which one is a digit, or one a
letter and the other not; the four characters that contractions and special
strings hold are left out (' < | >). Other tokenizers get whole texts.

Defined results: a null text is empty and has no tokens. Each row is counted by
itself, repeated ids and rows included. Other columns are not read.
"""

from __future__ import annotations

import os
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexdrift.llm.common import Memo, each_text, handed_back, is_short, materialize, partitions_for, rows_to_batch, text_of, tune

#: Characters in a window, and in its overlap into the next.
CHUNK, OVERLAP = 65_536, 512
#: Characters that one call of the library gets at most, unless a single text is longer.
CALL = 1 << 20
#: Pieces in the memo of a worker, of up to 64 characters each.
PIECES = 1_000_000
#: The normaliser and pattern for which the rule of stable places is proven.
PROVEN_STEPS = ["NFC", "Replace", "Lowercase"]
PROVEN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CUT = pa.schema([("row", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("window", pa.int64()), ("last", pa.int64()), ("overlap", pa.int64()), ("text", pa.string())])
CUT_SQL = "row long, n_bytes long, n_tokens long, window long, last long, overlap long, text string"
ENDS = "array<struct<place:long,before:long>>"

_tokenizers: dict[str, "Counter"] = {}


class Counter:
    """A tokenizer of the tokenizers or the sentencepiece library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.proven = False
        if path.endswith(".model"):
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=path)
            self.counts = lambda texts: [len(ids) for ids in library.encode(texts, num_threads=1)]
            return
        import json

        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        self.library = library
        self.counts = self.of_texts
        told = json.loads(library.to_str())
        steps, splits = told["normalizer"] or {}, (told["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        added = [t for t in told["added_tokens"] if t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or not (t["content"].startswith("<|") and t["content"].endswith("|>") and t["content"][2:-2].isalpha() and t["content"].isascii())]
        self.pieces = Memo(lambda piece: len(self.of_batch([piece])[0]), PIECES, is_short)
        self.proven = not added and [s["type"] for s in steps.get("normalizers", [])] == PROVEN_STEPS and splits[0].get("pattern") == {"Regex": PROVEN_SPLIT}

    def of_batch(self, texts: list[str]) -> list:
        return self.library.encode_batch_fast(texts, add_special_tokens=False)

    def of_texts(self, texts: list[str]) -> list[int]:
        if not self.proven:
            return [len(e) for e in self.of_batch(texts)]
        look = self.pieces.__getitem__
        return [sum(map(look, t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))) for t in texts]

    def encode(self, text: str) -> np.ndarray:
        """First character of each token."""
        return np.fromiter((a for a, _ in self.library.encode(text, add_special_tokens=False).offsets), "i8")


def counter(path: str) -> Counter:
    if path not in _tokenizers:
        _tokenizers[path] = Counter(path)
    return _tokenizers[path]


SPACES = frozenset(" \t\n\r")
UNSURE = frozenset("'<|>")
KINDS = dict.fromkeys(string.ascii_letters, "letter") | dict.fromkeys(string.digits, "digit") | {c: "sign" for c in string.punctuation if c not in UNSURE}


def is_stable(before: str, after: str) -> bool:
    """Whether the tokenizer splits between two neighbouring characters whatever stands around them."""
    if before in SPACES:
        return True
    a, b = KINDS.get(before), KINDS.get(after)
    return a is not None and b is not None and (a != b or a == "digit")


def stable_places(starts: np.ndarray, text: str, low: int, high: int) -> list[tuple[int, int]]:
    """Places in [low, high) where a token starts and the tokenizer must split, each with the number of tokens before it."""
    out = []
    for k in range(*np.searchsorted(starts, [max(low, 1), high]).tolist()):
        place = int(starts[k])
        if (k == 0 or starts[k - 1] < place) and is_stable(text[place - 1], text[place]):
            out.append((place, k))
    return out


def count_or_cut(path: str, chunk: int, overlap: int):
    """For mapInArrow over (row, text): counts of short texts, windows of long ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = counter(path)
        for batch, texts in each_text(batches):
            rows, call, size = batch.column("row").to_pylist(), [], 0
            for k, text in enumerate(texts):
                if len(text) > chunk and use.proven:
                    n_bytes, last = len(text.encode()), (len(text) - 1) // chunk
                    for w in range(last + 1):
                        yield rows_to_batch(CUT, [[rows[k]], [n_bytes if w == 0 else 0], [None], [w], [last], [overlap], [text[w * chunk : (w + 1) * chunk + overlap]]])
                    continue
                call.append(k)
                size += len(text)
                if size >= CALL:
                    yield counted(use, rows, texts, call)
                    call, size = [], 0
            if call:
                yield counted(use, rows, texts, call)

    return handed_back(run)


def counted(use: Counter, rows: list[int], texts: list[str], call: list[int]) -> pa.RecordBatch:
    none = [None] * len(call)
    return rows_to_batch(CUT, [[rows[k] for k in call], [len(texts[k].encode()) for k in call], use.counts([texts[k] for k in call]), none, none, none, none])


def encode_windows(path: str, chunk: int):
    """For mapInArrow over (row, window, upto, last, overlap, text): tokens, and the stable places of the first overlap and the own one, counted from the document's first character."""
    schema = pa.schema([("row", pa.int64()), ("window", pa.int64()), ("upto", pa.int64()), ("last", pa.int64()), ("n_tokens", pa.int64())] + [(c, pa.list_(pa.struct([("place", pa.int64()), ("before", pa.int64())]))) for c in ("head", "tail")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = counter(path)
        for batch in batches:
            for r in batch.to_pylist():
                begin, text = r["window"] * chunk, r["text"]
                starts = use.encode(text)
                head = stable_places(starts, text, 0, r["overlap"]) if r["window"] else []
                tail = stable_places(starts, text, (r["upto"] + 1) * chunk - begin, len(text)) if r["upto"] < r["last"] else []
                told = [[{"place": begin + p, "before": n} for p, n in found] for found in (head, tail)]
                yield rows_to_batch(schema, [[r["row"]], [r["window"]], [r["upto"]], [r["last"]], [len(starts)], [told[0]], [told[1]]])

    return handed_back(run)


ENCODED = f"row long, window long, upto long, last long, n_tokens long, head {ENDS}, tail {ENDS}"


def splices(encoded: DataFrame) -> DataFrame:
    """row, seam (the window before it), left, right: tokens that either window has before the first stable place common to both; null where there is none."""
    left = encoded.where("upto < last").select("row", F.col("upto").alias("seam"), F.col("tail").alias("a"), F.lit(None).cast(ENDS).alias("b"))
    right = encoded.where("window > 0").select("row", (F.col("window") - 1).alias("seam"), F.lit(None).cast(ENDS).alias("a"), F.col("head").alias("b"))
    both = left.unionByName(right).groupBy("row", "seam").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    both = both.withColumn("place", F.array_min(F.array_intersect(F.col("a.place"), F.col("b.place"))))
    at = lambda c: F.get(F.filter(c, lambda x: x["place"] == F.col("place")), F.lit(0))["before"]
    return both.select("row", "seam", at("a").alias("left"), at("b").alias("right"))


def count_windows(windows: DataFrame, path: str, chunk: int) -> DataFrame:
    """row, n_tokens of the documents whose windows (row, window, last, overlap, text) are given."""
    n = partitions_for(windows)
    dealt = lambda df: df.repartition(n, "row", "window").mapInArrow(encode_windows(path, chunk), ENCODED)
    encoded = materialize(dealt(windows.withColumn("upto", F.col("window"))), "encoded")
    seams = materialize(splices(encoded), "seams")
    good = seams.where("left is not null")
    if not (failed := seams.where("left is null")).isEmpty():
        # The overlap is widened over the next window: windows between two good seams become one.
        by_row = Window.partitionBy("row").orderBy("window")
        bad = failed.select("row", F.col("seam").alias("window"), F.lit(1).alias("bad"))
        marked = encoded.select("row", "window").join(bad, ["row", "window"], "left").withColumn("first", F.coalesce(F.sum(F.when(F.col("bad").isNull(), 1).otherwise(0)).over(by_row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        marked = marked.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("row", "first"))).where("many > 1")
        parts = windows.join(marked.select("row", "window", "first"), ["row", "window"]).groupBy("row", "first", "last", "overlap").agg(F.min("window").alias("window"), F.max("window").alias("upto"), F.array_sort(F.collect_list(F.struct("window", "text"))).alias("parts"))
        whole = F.concat(F.array_join(F.transform(F.slice("parts", F.lit(1), F.size("parts") - 1), lambda p: F.substring(p["text"], 1, chunk)), ""), F.element_at("parts", -1)["text"])
        again = materialize(dealt(parts.select("row", "window", "upto", "last", "overlap", whole.alias("text"))), "widened")
        encoded = encoded.join(marked.select("row", "window"), ["row", "window"], "left_anti").unionByName(again)
        # A widened window is counted anew up to its own seam; what the next one has before that seam stays.
        renewed = splices(encoded)
        good = materialize(renewed.join(failed.select("row", "seam"), ["row", "seam"], "left_anti"), "seams")
    ends = encoded.where("upto = last").select("row", "n_tokens")
    return ends.unionByName(good.select("row", (F.col("left") - F.col("right")).alias("n_tokens"))).groupBy("row").agg(F.sum("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), n_windows of each row of ``docs`` (doc_id, text).

    ``overlap`` lies between 2 and ``chunk``. Windows are dealt by document and
    number, so that one huge document is many tasks' work; per seam a few
    places travel, never text.
    """
    if not 2 <= overlap <= chunk:
        raise ValueError("the overlap must lie between 2 and the chunk's length")
    spark = docs.sparkSession
    tune(spark)
    # Row numbers hold once written: the rows that carry them come from this table alone.
    rows = docs.select("doc_id", text_of().alias("text"), F.monotonically_increasing_id().alias("row"))
    cut = materialize(rows.mapInArrow(with_ids(count_or_cut(path, chunk, overlap)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {CUT_SQL}"), "windows")
    long = cut.where("window is not null")
    counts = count_windows(long.select("row", "window", "last", "overlap", "text"), path, chunk)
    ids = long.where("window = 0").select("doc_id", "row", "n_bytes", (F.col("last") + 1).alias("n_windows"))
    short = cut.where("window is null").select("doc_id", "n_bytes", "n_tokens", F.lit(1).cast("long").alias("n_windows"))
    out = short.unionByName(ids.join(counts, "row").select("doc_id", "n_bytes", "n_tokens", "n_windows"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_windows")


def with_ids(run):
    """Give what ``run`` makes of (row, text) the doc_id of its row."""

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = dict(zip(batch.column("row").to_pylist(), range(batch.num_rows)))
            for out in run(iter([batch])):
                at = pa.array([known[r] for r in out.column("row").to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), *out.columns], ["doc_id", *out.schema.names])

    return then
