"""Trie of the prefixes that conversations share (operator 11), built one depth at a time.

Texts are read once: a turn is known afterwards by the SHA-256 of its role and
text. A node is named by its depth and the smallest conversation that passes
through it. For each depth the live conversations (those in a node with others)
are joined with their next turn and grouped by (parent node, turn); a
conversation that is alone in its node leaves, as what follows is a chain that
its own turns tell. Leaves and savings are then rolled up from the deepest
level to the root, one join a level. There are as many rounds as the depth to
which two conversations agree, however long single ones are.

Everything between levels is a table in the shared folder, so that lost
executors cost one level's work at most. Conversations of any length are
numbered by range partitions and offsets, nodes of any size are combined
before they are shuffled, and joins with them can be split.

Defined results: a null role or text is empty. Turns whose number is the same
are ordered by the SHA-256 of role and text; repeated rows are turns of their
own. Rows without conv_id take no part. Without conversations there is no row.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexdrift.llm.common import materialize, partitions_for, rows_to_batch, scratch, text_of, tune

#: Of each fifth conversation at most this many turns are handed on, one less than the modulus of the checksum.
MOST_HEAD = 8
#: Ids in one row of those that are hashed together.
PACK = 8192
PACKED = pa.schema([("depth", pa.int64()), ("m", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
HASHED = pa.schema([("depth", pa.int64()), ("m", pa.int64()), ("ends_sha256", pa.string())])
RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, place from 0, key, bytes) and conversations (conv_id, own: their number).

    Rows are dealt by ranges of (conv_id, turn), so that the turns of a long
    conversation lie in several partitions; a place is the place within the
    partition and the sum of what earlier partitions hold of the conversation.
    """
    role, text, n = text_of("role"), text_of("text"), partitions_for(conversations)
    read = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("key"), F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "key", "row"]
    at = materialize(materialize(read, "turns").repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "key", "bytes", F.monotonically_increasing_id().alias("at")), "numbered")
    at = at.withColumn("part", F.shiftright("at", 33))
    runs = materialize(at.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")), "runs")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select("conv_id", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("offset"))
    return at.join(offsets, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("offset")).alias("place"), "key", "bytes"), runs.groupBy("conv_id").agg(F.sum("n").alias("own"))


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, place, key, bytes), ordered by place within ranges of it, and conversations (conv_id, len).

    The first h turns come from the conversation numbered conv_id - conv_id % 5,
    the rest are the conversation's own beyond its first h; h is crc32(conv_id) % 9.
    """
    turns, known = numbered_turns(conversations)
    turns = materialize(turns, "placed")
    known = known.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_HEAD + 1), "base": F.expr("conv_id - conv_id % 5")})
    bases = known.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    known = materialize(known.join(bases, "base", "left").select("conv_id", "base", "own", "h", F.least("h", F.coalesce("base_own", F.lit(0))).alias("head")), "conversations")
    heads = turns.where(F.col("place") < MOST_HEAD).withColumnRenamed("conv_id", "base").join(known.where("h > 0").select("conv_id", "base", "h"), "base").where("place < h").select("conv_id", "place", "key", "bytes")
    rest = turns.join(known.select("conv_id", "h", "head"), "conv_id").where("place >= h").select("conv_id", F.expr("place - h + head").alias("place"), "key", "bytes")
    levels = materialize(heads.unionByName(rest), "rebuilt").repartitionByRange(partitions_for(conversations), "place", "conv_id").sortWithinPartitions("place", "conv_id")
    return materialize(levels, "levels"), known.select("conv_id", F.expr("head + greatest(own - h, 0)").alias("len"))


class Levels:
    """A table written and read one depth at a time, or as a whole with its depth."""

    def __init__(self, spark: SparkSession, what: str, schema: str):
        self.spark, self.path, self.schema = spark, scratch(spark, what), schema

    def write(self, depth: int, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.path}/depth={depth}")
        return self.read(depth)

    def read(self, depth: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/depth={depth}")

    def whole(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, depth long").parquet(self.path)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    tune(spark)
    turns, known = rebuilt_turns(conversations)
    root, n_all = known.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    if not n_all:
        return spark.createDataFrame([], RESULT)
    steps, nodes, depth = Levels(spark, "steps", "parent long, key binary, bytes long, conv_id long, len long"), Levels(spark, "nodes", "parent long, key binary, m long, n long, bytes long, len long"), 0
    live = known.select("conv_id", F.lit(root).cast("long").alias("m"), "len")
    while True:
        step = steps.write(depth + 1, turns.where(F.col("place") == depth).join(live, "conv_id").select(F.col("m").alias("parent"), "key", "bytes", "conv_id", "len"))
        depth += 1
        level = nodes.write(depth, step.groupBy("parent", "key").agg(F.min("conv_id").alias("m"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes"), F.max("len").alias("len")))
        if level.where("n > 1").isEmpty():
            break
        live = step.join(level.where("n > 1").select("parent", "key", "m"), ["parent", "key"]).select("conv_id", "m", "len")
    rolled = roll_up(spark, nodes, depth)
    top = rolled.where("depth = 1").agg(F.count(F.lit(1)).alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"))
    top = top.select(F.lit(root).cast("long").alias("m"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), F.lit(n_all).cast("long").alias("n"), "n_children", "n_leaves", "saved")
    many = rolled.where("n > 1").select(*top.columns).unionByName(top)
    ends = steps.whole().where("len = depth").join(nodes.whole().where("n > 1").select("depth", "parent", "key", "m"), ["depth", "parent", "key"]).select("depth", "m", "conv_id")
    ends = ends.unionByName(known.where("len = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(root).cast("long").alias("m"), "conv_id"))
    many = many.join(hashed_ends(ends), ["depth", "m"], "left").select(F.col("m").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
    # A conversation alone in its node: from there on each of its turns is a node of its own.
    alone = rolled.where("n = 1").select(F.col("m").alias("conv_id"), F.col("depth").alias("since"), "parent", "len")
    at, own = F.col("place") + 1, F.col("conv_id")
    chains = turns.join(alone, "conv_id").where("place + 1 >= since").select(own, at.alias("depth"), F.when(at == F.col("since"), F.col("parent")).otherwise(own).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), (at < F.col("len")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.sha2(F.when(at == F.col("len"), own.cast("string")).otherwise("").cast("binary"), 256).alias("ends_sha256"))
    return many.unionByName(chains)


def roll_up(spark: SparkSession, nodes: Levels, deepest: int) -> DataFrame:
    """The nodes with their children, leaves and savings, from the deepest level up; children are summed before they meet their parents."""
    rolled = Levels(spark, "rolled", "parent long, m long, n long, len long, n_children long, n_leaves long, saved long")
    below = None
    for depth in range(deepest, 0, -1):
        level = nodes.read(depth)
        if below is None:
            level = level.withColumns({"kids": F.lit(None).cast("long"), "leaves": F.lit(None).cast("long"), "under": F.lit(None).cast("long")})
        else:
            level = level.join(below.groupBy(F.col("parent").alias("m")).agg(F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("under")), "m", "left")
        chain = F.when(F.col("n") == 1, (F.col("len") > depth).cast("long"))
        below = rolled.write(depth, level.select("parent", "m", "n", "len", F.coalesce(chain, "kids", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"), ((F.col("n") - 1) * F.col("bytes") + F.coalesce("under", F.lit(0))).alias("saved")))
    return rolled.whole()


def hashed_ends(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined ids of each node (depth, m).

    Ids are dealt by ranges and joined into rows of at most ``PACK``; a node's
    rows then run through one hash in order, as such a digest asks for, without
    being held.
    """
    order, n = ["depth", "m", "conv_id"], partitions_for(ends)
    packed = materialize(ends, "ends").repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(pack_ids, "depth long, m long, first long, ids string")
    return packed.repartition(n, "depth", "m").sortWithinPartitions("depth", "m", "first").mapInArrow(hash_packs, "depth long, m long, ends_sha256 string")


def pack_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, ids, out = None, [], []
    for batch in batches:
        for *now, conv_id in zip(*(batch.column(c).to_pylist() for c in ("depth", "m", "conv_id"))):
            if ids and (now != node or len(ids) == PACK):
                out.append((*node, ids[0], ",".join(map(str, ids))))
                ids = []
            node = now
            ids.append(conv_id)
        if out:
            yield rows_to_batch(PACKED, zip(*out))
            out = []
    if ids:
        yield rows_to_batch(PACKED, zip((*node, ids[0], ",".join(map(str, ids)))))


def hash_packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, sha, out = None, None, []
    for batch in batches:
        for *now, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "m", "ids"))):
            if now != node:
                if sha:
                    out.append((*node, sha.hexdigest()))
                node, sha = now, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if out:
            yield rows_to_batch(HASHED, zip(*out))
            out = []
    if sha:
        yield rows_to_batch(HASHED, zip((*node, sha.hexdigest())))
