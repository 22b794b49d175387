"""A Python data source over numpy archives of usage vectors: a file a year, a member a word."""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

#: What a member's name begins with, where its writer marks words so.
MARK = "w::"
FILE = re.compile(r"(\d+)\.npz$")
#: Bytes of members that one partition reads, unless a single one is larger; rows of one batch.
CHUNK, BATCH = 32 << 20, 4096
SCHEMA = pa.schema([("word", pa.string()), ("year", pa.int32()), ("usage_id", pa.int64()), ("emb", pa.list_(pa.float32()))])


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class Members(InputPartition):
    def __init__(self, path: str, year: int, names: list[str]):
        super().__init__((path, names[:1]))
        self.path, self.year, self.names = path, year, names


def word_of(member: str) -> str:
    return member.removesuffix(".npy").removeprefix(MARK)


class ArchiveReader(DataSourceReader):
    """Filters on word and year choose members by the archives' listings, before any vector is read; year filters pass over whole files."""

    def __init__(self, options: dict):
        self.path, self.tests = options["path"], []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            column = getattr(f, "attribute", (None,))
            if column not in (("word",), ("year",)) or not isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual | IsNotNull):
                yield f
            elif not isinstance(f, IsNotNull):
                self.tests.append((column[0], type(f).__name__, tuple(f.value) if isinstance(f, In) else f.value))

    def fits(self, column: str, value) -> bool:
        how = {"EqualTo": lambda a, b: a == b, "In": lambda a, b: a in b, "GreaterThan": lambda a, b: a > b, "GreaterThanOrEqual": lambda a, b: a >= b, "LessThan": lambda a, b: a < b, "LessThanOrEqual": lambda a, b: a <= b}
        return all(how[kind](value, b) for name, kind, b in self.tests if name == column)

    def partitions(self):
        fs, root = file_system(self.path)
        info = fs.get_file_info(root)
        files = fs.get_file_info(pafs.FileSelector(root)) if info.type == pafs.FileType.Directory else [info]
        out = []
        for f in sorted(files, key=lambda f: f.path):
            if not (m := FILE.search(f.path)) or not self.fits("year", int(m[1])):
                continue
            with fs.open_input_file(f.path) as raw, zipfile.ZipFile(raw) as z:
                names, size = [], 0
                for member in z.infolist():
                    if member.filename.endswith(".npy") and self.fits("word", word_of(member.filename)):
                        if names and size + member.file_size > CHUNK:
                            out.append(Members(f.path, int(m[1]), names))
                            names, size = [], 0
                        names.append(member.filename)
                        size += member.file_size
                if names:
                    out.append(Members(f.path, int(m[1]), names))
        return out

    def read(self, part: Members):
        fs, _ = file_system(self.path)
        if not isinstance(part, Members):  # no file fits
            return
        with fs.open_input_file(part.path) as raw, zipfile.ZipFile(raw) as z:
            for name in part.names:
                with z.open(name) as member:
                    x = np.lib.format.read_array(member, allow_pickle=False).astype("f4")
                for at in range(0, len(x), BATCH):
                    piece = np.ascontiguousarray(x[at : at + BATCH])
                    n = len(piece)
                    vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype="i4") * x.shape[1]), pa.array(piece.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([word_of(name)] * n), pa.array(np.full(n, part.year, "i4")), pa.array(np.arange(at, at + n)), vectors], schema=SCHEMA)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return "word string, year int, usage_id long, emb array<float>"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def register(spark: SparkSession) -> None:
    """``spark.read.format("npz").load(folder)``: word, year, usage_id (place within the member), emb."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)


def write_archives(usages: DataFrame, folder: str, kind: str = "f2") -> int:
    """Write usages (word, year, usage_id, emb) as one archive a year, words in order; how many members there are.

    A task streams a year's rows in order and holds one word's vectors at a
    time. An archive gets its name once it is whole, so a task that is lost
    leaves none behind that could be read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        open_now, held, key, n = None, [], (None, None), 0

        def member_done():
            nonlocal held, n
            if held:
                with open_now[1].open(f"{MARK}{key[1]}.npy", "w", force_zip64=True) as out:
                    np.lib.format.write_array(out, np.array(held, kind), allow_pickle=False)
                held, n = [], n + 1

        def year_done():
            if open_now:
                open_now[1].close()
                open_now[0].close()
                fs.move(open_now[2], f"{root}/{key[0]}.npz")

        for batch in batches:
            for year, word, emb in zip(*(batch.column(c).to_pylist() for c in ("year", "word", "emb"))):
                if (year, word) != key:
                    member_done()
                    if year != key[0]:
                        year_done()
                        at = f"{root}/.{year}-{uuid.uuid4().hex}"
                        raw = fs.open_output_stream(at)
                        open_now = (raw, zipfile.ZipFile(raw, "w"), at)
                    key = (year, word)
                held.append(emb)
        member_done()
        year_done()
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    rows = usages.where("emb is not null and word is not null and year is not null").select("year", "word", "usage_id", "emb")
    done = rows.repartition("year").sortWithinPartitions("year", "word", "usage_id").mapInArrow(run, "n long")
    return done.agg(F.sum("n")).first()[0] or 0
