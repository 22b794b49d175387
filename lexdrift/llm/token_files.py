"""Token ids as flat binary files (operator 4).

Layout of a shard (all integers little-endian):

* ``<name>.bin`` holds token ids back to back, unsigned 16-bit where the
  vocabulary fits and unsigned 32-bit otherwise, nothing else.
* ``<name>.idx`` holds a 40-byte header (magic, version, id width, documents,
  tokens), then documents + 1 offsets (int64, in tokens, the first 0), then
  the document ids (int64), then one byte a document: 1 where the id is known.

Documents stand in ascending order of id across shards (unknown ids first;
equal ids ordered by a hash of their text, then by text). A shard knows only its own counts: its base within
the whole corpus is the prefix sum of the counts before it, taken over one
manifest row a shard. Every task attempt writes files of its own name and only
those named in the manifest count, so that a lost executor or a repeated task
leaves no half-written shard behind.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexdrift.llm.common import Memo, each_text, file_system, handed_back, is_short, materialize, partitions_for, text_of, tune

MAGIC, VERSION = b"LXTOKEN\0", 1
HEADER = "<8sIIQQQ"
HEADER_BYTES = struct.calcsize(HEADER)
MANIFEST = "shard int, path string, width int, n_docs long, n_tokens long"
DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

_encoders: dict[str, "LibraryEncoder"] = {}

LETTERS = re.compile(r"[^\W\d_]+")


class LibraryEncoder:
    """The tokenizers library's ``encode`` over whole texts, with a memo of what it gave for pieces of them.

    Where the tokenizer splits as byte-level ones do, a single space between two
    visible characters always starts a pre-token: the library encodes the pieces
    between such spaces as it does within the text, and letters that a piece
    begins with apart from what follows them. New ones are handed to it strung
    together, and its offsets tell them apart. Texts that hold one of
    the tokenizer's added tokens, and all texts where the tokenizer works in
    another way, go through it as wholes.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.width = self.kind.itemsize
        split = self.library.pre_tokenizer
        self.by_piece = self.library.normalizer is None and self.library.post_processor is None and type(split).__name__ == "ByteLevel" and split.use_regex and not split.add_prefix_space
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # Pieces, without the space before them: those met lately, and those met before.
        self.lately: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.most_pieces = 1_400_000
        self.tails = Memo(self.of_text, 100_000, is_short)

    def of_text(self, text: str) -> bytes:
        """The library's ids of a text, packed."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def of_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, each with the space before it; they begin with visible characters."""
        if not pieces:
            return []
        got = self.library.encode(" " + " ".join(pieces), add_special_tokens=False)
        begins = np.fromiter((a for a, _ in got.offsets), "i8", len(got))
        starts = np.cumsum([0, *(len(p) + 1 for p in pieces)])
        cuts = (np.searchsorted(begins, starts) * self.width).tolist()
        packed = np.array(got.ids, self.kind).tobytes()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:])]

    def look_up(self, pieces: list[str], ids: list[bytes | None]) -> None:
        """Fill the gaps in ``ids``."""
        lately, before, parts, new = self.lately, self.before, [], {}
        for k, known in enumerate(ids):
            if known is not None:
                continue
            piece = pieces[k]
            if (known := before.get(piece)) is not None:
                ids[k] = lately[piece] = known
                continue
            if piece.isalpha():
                core, stop = piece, len(piece)
            else:
                m = LETTERS.match(piece)
                stop = m.end() if m and m[0].isalpha() else len(piece)
                core = piece[:stop]
            if core not in new and core not in lately:
                new[core] = before.get(core)
            parts.append((k, core, piece[stop:]))
        missing = [core for core, known in new.items() if known is None]
        new.update(zip(missing, self.of_pieces(missing), strict=True))
        for k, core, tail in parts:
            found = new[core] if core in new else lately[core]
            ids[k] = found + self.tails[tail] if tail else found
            if len(pieces[k]) <= 64:
                lately[core], lately[pieces[k]] = found, ids[k]
        if len(lately) > self.most_pieces // 2:
            self.lately, self.before = {}, lately

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as packed unsigned integers."""
        out: list[bytes] = []
        for text in texts:
            if not self.by_piece or any(a in text for a in self.added):
                out.append(self.of_text(text))
                continue
            head, *rest = safe_split(text)
            ids = list(map(self.lately.get, rest))
            if None in ids:
                self.look_up(rest, ids)
            out.append(self.tails[head] + b"".join(ids))
        return out


def safe_split(text: str) -> list[str]:
    """Split at each single space that stands between two visible characters."""
    parts = text.split(" ")
    if not _odd(text):
        return parts
    out = [parts[0]]
    for before, part in zip(parts, parts[1:]):
        if part and before and not part[0].isspace() and not before[-1].isspace():
            out.append(part)
        else:
            out[-1] += " " + part
    return out


def _odd(text: str) -> bool:
    return text[:1] == " " or text[-1:] == " " or SPACE_FIRST.search(text) is not None or SPACE_SECOND.search(text) is not None


SPACE_FIRST, SPACE_SECOND = re.compile(r" \s"), re.compile(r"[^\S ] ")


def _encoder(path: str) -> LibraryEncoder:
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


def write_token_files(docs: DataFrame, tokenizer: str, out_dir: str, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode every text and write shards below ``out_dir``; return the manifest, one row a shard.

    A null text is the empty one (its document holds the end id alone); a null
    id is kept as unknown. Repeated rows each get a document of their own. An
    empty table gives an empty manifest. Other columns are ignored. The one
    shuffle deals out rows by ranges of id, so no task depends on how many
    rows share a source or a text.
    """
    spark = docs.sparkSession
    tune(spark)
    fs, root = file_system(out_dir)
    fs.create_dir(root, recursive=True)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    # Rows that share an id, or have none, are told apart by a hash of their text, so that a hot id is cut too.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    ordered = rows.repartitionByRange(partitions_for(docs), *order[:2]).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        end = end_id.to_bytes(encoder.width, "little")
        shard, name = TaskContext.get().partitionId(), None
        lengths, doc_ids = [], []
        out = None
        for batch, texts in each_text(batches):
            if out is None:
                fs, root = file_system(out_dir)
                fs.create_dir(root, recursive=True)
                name = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex}"
                out = fs.open_output_stream(f"{name}.bin")
            packed = [ids + end for ids in encoder.encode_batch(texts)]
            lengths += [len(p) // encoder.width for p in packed]
            doc_ids += batch.column("doc_id").to_pylist()
            out.write(b"".join(packed))
        if out is None:
            return
        out.close()
        n_tokens = sum(lengths)
        with fs.open_output_stream(f"{name}.idx") as index:
            index.write(struct.pack(HEADER, MAGIC, VERSION, encoder.width, len(doc_ids), n_tokens, 0))
            index.write(np.concatenate([[0], np.cumsum(lengths)]).astype("<i8").tobytes())
            index.write(np.array([0 if i is None else i for i in doc_ids], "<i8").tobytes())
            index.write(np.array([i is not None for i in doc_ids], "u1").tobytes())
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{out_dir}/{name.rpartition('/')[2]}"], "width": pa.array([encoder.width], pa.int32()), "n_docs": pa.array([len(doc_ids)], pa.int64()), "n_tokens": pa.array([n_tokens], pa.int64())})

    return materialize(ordered.mapInArrow(handed_back(write), MANIFEST), "manifest")


def with_bases(manifest: DataFrame) -> DataFrame:
    """Give each shard its first document's and first token's place in the corpus.

    Exclusive prefix sums over the manifest, which holds one small row a shard.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumns({"base": F.coalesce(F.sum("n_tokens").over(before), F.lit(0)), "doc_base": F.coalesce(F.sum("n_docs").over(before), F.lit(0))})


class Shard:
    """One shard, memory-mapped where its file system is local."""

    def __init__(self, path: str):
        index, data = _bytes_of(f"{path}.idx"), _bytes_of(f"{path}.bin")
        magic, version, self.width, n, self.n_tokens, _ = struct.unpack(HEADER, bytes(index[:HEADER_BYTES]))
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{path}: not a token shard of version {VERSION}")
        at = HEADER_BYTES
        self.offsets = np.frombuffer(index, "<i8", n + 1, at)
        self.doc_ids = np.frombuffer(index, "<i8", n, at + 8 * (n + 1))
        self.known = np.frombuffer(index, "u1", n, at + 8 * (2 * n + 1)).astype(bool)
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_tokens) if self.n_tokens else np.zeros(0, "<u4")

    def document(self, k: int) -> np.ndarray:
        return self.ids[self.offsets[k] : self.offsets[k + 1]]

    def __len__(self) -> int:
        return len(self.doc_ids)


def _bytes_of(uri: str):
    import pyarrow.fs as pafs

    fs, path = file_system(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, mode="r") if os.path.getsize(path) else b""
    with fs.open_input_file(path) as f:
        return f.read()


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Read shards back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (over unsigned 32-bit ids).

    One manifest row is one task's work; shards are mapped, never gathered.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                shard = Shard(path)
                for k in range(0, len(shard), 8192):
                    upto = min(k + 8192, len(shard))
                    sums = [zlib.crc32(shard.document(d).astype("<u4").tobytes()) for d in range(k, upto)]
                    yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids[k:upto], mask=~shard.known[k:upto]), pa.array(shard.offsets[k:upto] + base), pa.array(np.diff(shard.offsets[k : upto + 1])), pa.array(sums, pa.int64())], schema=DOCUMENTS)

    n = partitions_for(manifest)
    return with_bases(manifest).select("path", "base").repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
