"""What the training-data operators share: session settings, shared storage and bounded memos."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexdrift.session import ship

#: Used where the session names no spark.checkpoint.dir, as in tests.
LOCAL_CHECKPOINTS = "file:///tmp/lexdrift-checkpoints"


def tune(spark: SparkSession, batch_bytes: int = 4 << 20, batch_rows: int = 20_000) -> None:
    """Bound each Arrow batch by bytes, so that very long texts cannot fill a Python worker; let workers import this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Only a local session may do without."""
    found, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not found:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = LOCAL_CHECKPOINTS
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    path = f"{shared_dir(spark)}/lexdrift-{what}-{uuid.uuid4().hex}"
    written_paths(spark).append(path)
    return path


def written_paths(spark: SparkSession) -> list[str]:
    """Paths that this application has taken below the shared folder and not dropped."""
    sc = spark.sparkContext
    if not hasattr(sc, "_lexdrift_paths"):
        sc._lexdrift_paths = []
    return sc._lexdrift_paths


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexdrift_path = path
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once what reads them has been written itself."""
    for t in tables:
        drop_path(t.sparkSession, t._lexdrift_path)


def sweep(spark: SparkSession, keep: DataFrame | None = None, of: Iterable[str] | None = None) -> None:
    """Delete what operators wrote below the shared folder, or of that the paths ``of``, but for the table ``keep``.

    For a caller that has written its results: tables that lazy results still read must stay until then.
    """
    kept = getattr(keep, "_lexdrift_path", None)
    for path in list(written_paths(spark) if of is None else of):
        if path != kept:
            drop_path(spark, path)


def reclaim(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more; it does so when their handles are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a path below the shared folder through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in (paths := written_paths(spark)):
        paths.remove(path)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The pyarrow file system of a URI or plain path, and the path within it."""
    if "://" not in uri:
        uri = f"file://{os.path.abspath(uri)}" if not uri.startswith("file:") else "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


class Memo(dict):
    """A dict that computes what it lacks and holds at most ``limit`` entries.

    Half of them are those met lately; when these are full they become the
    older half, whose entries come back as they are asked for again. Keys for
    which ``worth`` is given and false are computed each time.
    """

    def __init__(self, make: Callable, limit: int = 200_000, worth: Callable | None = None):
        super().__init__()
        self.make, self.limit, self.worth, self.old = make, limit, worth, {}

    def __missing__(self, key):
        if (value := self.old.get(key)) is None:
            value = self.make(key)
        if self.worth is None or self.worth(key):
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= max(1, self.limit // 2):
            self.old = dict(self)
            self.clear()
        self[key] = value


def is_short(text: str) -> bool:
    """Whether a text is worth a place in a memo; bounds a memo's bytes."""
    return len(text) <= 64


def handed_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` after which the worker gives memory that it no longer uses back to the system."""

    def then_trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return then_trim


def trim() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A null text counts as the empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def rows_to_batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def partitions_for(df: DataFrame, at_least: int = 1) -> int:
    """How many partitions a shuffle of whole rows gets: the session's setting."""
    return max(at_least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def each_text(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        yield batch, [t or "" for t in batch.column(column).to_pylist()]
