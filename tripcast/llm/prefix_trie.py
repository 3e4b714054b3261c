"""Prefix trie of rebuilt conversations, summed up by time-forward processing.

A node is a distinct sequence of the first d turns (role, text) of a rebuilt
conversation; its key is a 128-bit hash of position-keyed turn hashes, summed
along the conversation by a running window, so texts are read once and never
shuffled. Of all members the smallest conv_id names a node: (conv_id, depth).

Subtree totals go upwards by time-forward processing. Nodes are cut into
shards of whole subtrees (none has more than ``1 / SHARDS`` of all turns),
sorted by Spark in reverse level order (deepest first, then by key). One pass
over a sorted shard takes the messages of a node's children from a priority
queue addressed by the parent's place in that order, and sends the node's own
totals on to its parent. The queue keeps ``HELD`` messages in memory and spills
sorted runs beyond that into the folder Spark gives its tasks for spilling
(unlinked at once, read by this task alone). The totals of the shard roots are
summed by parent, and the same pass runs over the few nodes above all shards:
at most ``SHARDS`` a level, so they fit one task however large the input.

Defined cases: rows without conv_id belong to no conversation; a null role or
text is empty; turns that tie (a null turn comes first) follow the hash of
their role and text, so repeated rows are repeated turns; rebuilt
conversations without turns are members of the root and end there; an empty
table has no node. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import os
import pickle
import tempfile

import pandas as pd
import pyarrow as arrow
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripcast.session import written

SHARDS = 2048        # no shard holds more than this part of all turns ...
LEAST_SHARD = 512    # ... or this many, if that is more
HELD = 100_000       # messages of a queue in memory
RUN_BLOCK = 1024     # messages read back from a run at a time
LANES = 5            # of 30 bits each: exact sums up to 2^33 turns of one conversation
CHUNK_IDS = 4096     # conversation ids in one piece of a node's list
BASE_EVERY, MOST_SHARED = 5, 8

EMPTY_SHA = hashlib.sha256(b"").hexdigest()
NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string")
TOTALS = ["n_children", "n_leaves", "saved_tokens"]


def _shared(conv):
    """How many turns a conversation takes from its base."""
    return F.crc32(conv.cast("string").cast("binary")) % (MOST_SHARED + 1)


def rebuilt_turns(conversations: DataFrame) -> DataFrame:
    """Every rebuilt conversation's nodes (conv_id, depth, ka, kb, pa, pb,
    bytes, length), the root's row (depth 0) included; pa, pb: the parent's key."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", F.octet_length(text).cast("long").alias("bytes"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"))
    in_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    turns = turns.withColumn("pos", F.row_number().over(in_order))

    conv = F.col("conv_id")
    row = lambda c, kind, pos, digest, n: F.struct(
        c.alias("conv_id"), F.lit(kind).alias("kind"), pos.alias("pos"), digest.alias("digest"), n.alias("bytes"))
    turn = lambda c, kind: row(c, kind, F.col("pos"), F.col("digest"), F.col("bytes"))
    root = row(conv, -1, F.lit(0), F.lit(None).cast("binary"), F.lit(0).cast("long"))
    near = F.sequence(F.when(conv > 0, 0).otherwise(1 - BASE_EVERY), F.when(conv < 0, 0).otherwise(BASE_EVERY - 1))
    heirs = F.transform(near, lambda k: F.try_add(conv, k.cast("long")))  # conversations whose base this is
    heirs = F.filter(heirs, lambda c: c.isNotNull() & (F.col("pos") <= _shared(c)))
    parts = F.concat(
        F.when(F.col("pos") == 1, F.array(root)).otherwise(F.array().cast(_array_of(turns))),
        F.when((conv % BASE_EVERY == 0) & (F.col("pos") <= MOST_SHARED),
               F.transform(heirs, lambda c: turn(c, 0))).otherwise(F.array().cast(_array_of(turns))),
        F.when(F.col("pos") > _shared(conv), F.array(turn(conv, 1))).otherwise(F.array().cast(_array_of(turns))))
    rows = turns.select(F.explode(parts).alias("r")).select("r.*")

    whole = Window.partitionBy("conv_id")
    path = whole.orderBy("kind", "pos")
    rows = rows.select("conv_id", "kind", "pos", "digest", "bytes",
                       (F.row_number().over(path) - 1).cast("long").alias("depth"),
                       F.first("kind").over(path).alias("least_kind"),
                       (F.count(F.lit(1)).over(whole) - 1).alias("length")).where("least_kind = -1")
    lane = lambda j: F.sum(F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(
        F.shiftrightunsigned(F.xxhash64("digest", "depth", F.lit(j)), 34))).over(path)
    lanes = [f"s{j}" for j in range(LANES)]
    rows = rows.withColumns({s: lane(j) for j, s in enumerate(lanes)})
    rows = rows.withColumns({"ka": F.xxhash64("depth", *lanes), "kb": F.xxhash64(*lanes, "depth", F.lit(7))})
    return rows.select("conv_id", "depth", "ka", "kb", F.lag("ka").over(path).alias("pa"),
                       F.lag("kb").over(path).alias("pb"), "bytes", "length")


def _array_of(turns: DataFrame) -> str:
    return "array<struct<conv_id:bigint,kind:int,pos:int,digest:binary,bytes:bigint>>"


class SpillingQueue:
    """A least-first queue of tuples that keeps at most ``held`` of them in memory."""

    def __init__(self, held: int = HELD, folder: str | None = None):
        self.held = held
        self.folder = folder or os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        self.here: list = []
        self.runs: list = []      # (first message, number of the run, its further messages)
        self.spilled = 0

    def push(self, message: tuple) -> None:
        heapq.heappush(self.here, message)
        if len(self.here) > self.held:
            self._spill()

    def _spill(self) -> None:
        run = tempfile.TemporaryFile(dir=self.folder)
        self.here.sort()
        for lo in range(0, len(self.here), RUN_BLOCK):
            pickle.dump(self.here[lo:lo + RUN_BLOCK], run)
        self.here = []
        run.seek(0)
        messages = self._read(run)
        self.spilled += 1
        heapq.heappush(self.runs, (next(messages), self.spilled, messages))

    @staticmethod
    def _read(run):
        with run:
            while True:
                try:
                    yield from pickle.load(run)
                except EOFError:
                    return

    def __bool__(self) -> bool:
        return bool(self.here or self.runs)

    def least(self) -> tuple:
        heads = ([self.here[0]] if self.here else []) + ([self.runs[0][0]] if self.runs else [])
        return min(heads)

    def pop(self) -> tuple:
        if self.runs and (not self.here or self.runs[0][0] < self.here[0]):
            message, k, further = self.runs[0]
            if (following := next(further, None)) is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (following, k, further))
            return message
        return heapq.heappop(self.here)


def forward(batches, held: int = HELD):
    """Time-forward pass over nodes in reverse level order (depth falling, then
    ka, kb): adds the totals of a node's subtree to what came with it."""
    queue = SpillingQueue(held)
    for batch in batches:
        column = lambda c: batch.column(c).to_pylist()  # noqa: B023,E731
        children, leaves, saved = map(column, TOTALS)
        rows = zip(*map(column, ["depth", "ka", "kb", "pa", "pb", "is_root"]))
        for i, (depth, ka, kb, pa, pb, is_root) in enumerate(rows):
            place = (-depth, ka, kb)
            while queue and queue.least()[0] == place:
                _, below, spared = queue.pop()
                children[i] += 1
                leaves[i] += below
                saved[i] += spared
            if not children[i]:
                leaves[i] = 1
            if not is_root:
                queue.push(((1 - depth, pa, pb), leaves[i], saved[i]))
        for name, values in zip(TOTALS, (children, leaves, saved)):
            at = batch.schema.get_field_index(name)
            batch = batch.set_column(at, name, arrow.array(values, arrow.int64()))
        yield batch
    assert not queue, "messages to nodes outside of their shard"


def _pieces(batches):
    """Sorted (ka, kb, conv_id) rows to pieces of at most CHUNK_IDS comma-joined ids."""
    for pdf in batches:
        rows = zip(pdf["ka"].tolist(), pdf["kb"].tolist(), pdf["conv_id"].tolist())
        out = []
        for (ka, kb), group in itertools.groupby(rows, key=lambda r: r[:2]):
            while ids := [r[2] for r in itertools.islice(group, CHUNK_IDS)]:
                out.append((ka, kb, ids[0], ",".join(map(str, ids))))
        yield pd.DataFrame(out, columns=["ka", "kb", "first_id", "piece"])


def _hash_pieces(batches):
    """Sorted pieces to one SHA-256 a node, a piece at a time."""
    node, state = None, None
    for pdf in batches:
        out = []
        for ka, kb, piece in zip(pdf["ka"].tolist(), pdf["kb"].tolist(), pdf["piece"]):
            if node != (ka, kb):
                if state:
                    out.append((*node, state.hexdigest()))
                node, state = (ka, kb), hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        yield pd.DataFrame(out, columns=["ka", "kb", "ends_sha256"])
    if state:
        yield pd.DataFrame([(*node, state.hexdigest())], columns=["ka", "kb", "ends_sha256"])


def end_hashes(rows: DataFrame) -> DataFrame:
    """(ka, kb, ends_sha256) of the nodes at which conversations end. Ids are
    joined in ranges first, so a node where a third of them ends is dealt over
    many tasks and only its pieces meet."""
    ends = rows.where("depth = length").select("ka", "kb", "conv_id")
    pieces = (ends.repartitionByRange("ka", "kb", "conv_id").sortWithinPartitions("ka", "kb", "conv_id")
              .mapInPandas(_pieces, "ka long, kb long, first_id long, piece string"))
    return (pieces.repartition("ka", "kb").sortWithinPartitions("ka", "kb", "first_id")
            .mapInPandas(_hash_pieces, "ka long, kb long, ends_sha256 string"))


def _summed(nodes: DataFrame, held: int) -> DataFrame:
    """The time-forward pass over the partitions of ``nodes``."""
    ordered = nodes.sortWithinPartitions(F.desc("depth"), "ka", "kb")
    fields = f"{NODE}, ka long, kb long, pa long, pb long, is_root boolean"
    names = [f.split()[0] for f in fields.split(", ")]
    return ordered.select(*names).mapInArrow(lambda batches: forward(batches, held), fields)


def prefix_trie(conversations: DataFrame, shards: int = SHARDS, least_shard: int = LEAST_SHARD,
                held: int = HELD) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (columns: ``NODE``)."""
    rows = written(rebuilt_turns(conversations), "trie-rows")
    limit = max(least_shard, -(-rows.count() // shards))
    key = ["ka", "kb"]
    nodes = written(
        rows.groupBy("depth", *key).agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("pa").alias("pa"),
            F.max("pb").alias("pb"), F.max("bytes").alias("bytes"),
            F.sum(F.col("length") - F.col("depth") + 1).alias("weight")), "trie-nodes")
    parents = nodes.select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    zero = F.lit(0).cast("long")
    full = (nodes.join(parents, ["pa", "pb"], "left").join(end_hashes(rows), key, "left")
            .withColumns({"ends_sha256": F.coalesce("ends_sha256", F.lit(EMPTY_SHA)), "n_children": zero,
                          "n_leaves": zero, "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")}).drop("bytes"))
    full = written(full, "trie-full")

    # a conversation's nodes below the last one that is too heavy for a shard belong to one shard
    tops = nodes.where(F.col("weight") > limit).select(*key)
    cuts = rows.join(tops, key, "left_semi").groupBy("conv_id").agg((F.max("depth") + 1).alias("cut"))
    shard = (rows.select("conv_id", "depth", *key).join(cuts, "conv_id", "left")
             .where(F.col("depth") == F.coalesce("cut", zero))
             .select("conv_id", F.col("ka").alias("sa"), F.col("kb").alias("sb")))
    inner = (full.where(F.col("weight") <= limit).join(shard, "conv_id")
             .withColumn("is_root", (F.col("ka") == F.col("sa")) & (F.col("kb") == F.col("sb")))
             .repartition("sa", "sb"))
    inner = written(_summed(inner, held), "trie-shards")

    arrived = inner.where("is_root and depth > 0").groupBy(F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(
        F.count(F.lit(1)).alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
    above = (full.where(F.col("weight") > limit).join(arrived, key, "left")
             .withColumns({"n_children": F.coalesce("c", zero), "n_leaves": F.coalesce("l", zero),
                           "saved_tokens": F.col("saved_tokens") + F.coalesce("s", zero),
                           "is_root": F.col("depth") == 0}).drop("c", "l", "s")
             .repartition(1))  # at most `shards` nodes a level
    names = [f.split()[0] for f in NODE.split(", ")]
    return inner.select(*names).unionByName(_summed(above, held).select(*names))
