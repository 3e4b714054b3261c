"""Sharding by extendible hashing, in DataFrame functions only.

A row's key is a string of bits: the MD5 of its id (the first 64 bits), then 64
bits of its own. A shard is a prefix of bits; a prefix whose rows are over the
byte limit is split on its next bit, and only such prefixes are. The directory
maps every value of the first d bits to the shard it belongs to, so a row finds
its shard by one equi-join. Bits beyond d are looked at only for the entries
that are still over the limit there: first the rest of the id's bits, then the
row's own bits, so that even one id that holds a third of all rows is dealt
over as many shards as its bytes need.

Counting is a partial aggregate by prefix; the sums for shorter prefixes are
made from the longest, not from the rows.

The directory grows with the input over the limit. Up to ``SMALL_DIRECTORY``
entries it is broadcast; a larger one is shuffled to the rows, but for the few
entries that hold more than 1/``HEAVY`` of the rows, which alone are broadcast:
their rows stay where they are, so no task gets all rows of a hot id.

Defined cases: null sizes count as 0; a null id is an id like any other; a row
larger than the limit is a shard of its own, marked ``oversized``; an empty
table gives an empty result. Input columns named like the added ones are
replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripcast.session import written

SHARD_BYTES = 16 << 20
FINER = 3          # bits of the directory beyond those that even sizes would need
SMALL_DIRECTORY = 1 << 15   # entries, some 10 MB of them
HEAVY = 1 << 10    # at most so many entries hold more than this part of the rows
ID_BITS = ROW_BITS = 64
ADDED = ["shard_id", "shard_depth", "shard_rows", "shard_bytes", "oversized"]


def _bits(hex16):
    return F.lpad(F.conv(hex16, 16, 2), 64, "0")


def _directory(rows: DataFrame, low: int, high: int, limit: int) -> tuple[DataFrame, bool]:
    """Entry (the first ``high`` bits) to shard, for entries that a prefix of
    ``low`` to ``high`` bits brings within the limit; others have no shard.
    And whether the directory is small."""
    cells = written(rows.groupBy(F.substring("__bits", 1, high).alias("entry")).agg(
        F.sum("__bytes").alias("bytes"), F.count(F.lit(1)).alias("n")), "directory-cells")
    small = cells.count() <= SMALL_DIRECTORY
    paths = cells.select("entry", "bytes", "n", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")) \
        .withColumn("prefix", F.expr("substring(entry, 1, depth)"))
    nodes = paths.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    fits = nodes.where((F.col("bytes") <= limit) | (F.col("n") == 1))
    # the shortest prefix that fits: its parent does not
    shards = written(fits, "directory-nodes").select("depth", "prefix", F.col("bytes").alias("shard_bytes"),
                                                     F.col("n").alias("shard_rows"))
    # a row a depth and entry, hence shuffled whatever the directory's size
    found = paths.select("entry", "depth", "prefix").join(shards.hint("merge"), ["depth", "prefix"]).groupBy("entry").agg(
        F.min(F.struct("depth", "prefix", "shard_bytes", "shard_rows")).alias("shard"))
    entries = cells.select("entry", F.col("bytes").alias("entry_bytes"), F.col("n").alias("entry_rows"))
    return written(entries.join(found if small else found.hint("merge"), "entry", "left").select(
        "entry", "entry_bytes", "entry_rows", F.col("shard.prefix").alias("shard_id"),
        F.col("shard.depth").alias("shard_depth"), F.col("shard.shard_rows").alias("shard_rows"),
        F.col("shard.shard_bytes").alias("shard_bytes")), "directory"), small


def _looked_up(rows: DataFrame, entries: DataFrame, small: bool, high: int) -> DataFrame:
    """Every row with its entry's columns."""
    rows = rows.withColumn("entry", F.substring("__bits", 1, high))
    if small:
        return rows.join(F.broadcast(entries), "entry")
    total = entries.agg(F.sum("entry_rows")).first()[0]
    heavy = entries.where(F.col("entry_rows") * HEAVY > total)  # fewer than HEAVY
    others = rows.join(F.broadcast(heavy.select("entry")), "entry", "left_anti")
    return rows.join(F.broadcast(heavy), "entry").unionByName(others.join(entries.hint("merge"), "entry"))


def assign_shards(df: DataFrame, id_col: str = "doc_id", bytes_col: str = "n_bytes",
                  limit: int = SHARD_BYTES) -> DataFrame:
    """All rows and columns of ``df`` plus shard_id (its bits; empty for the
    one shard of a small table), shard_depth, shard_rows, shard_bytes and
    oversized. The rows are written once with their bits, so pass the columns
    that are needed."""
    df = df.drop(*ADDED)
    base = [F.col(f"`{c}`") for c in df.columns]
    id_hash = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    row_hash = F.md5(F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string")).cast("binary"))
    rows = written(df.select(
        *base, F.concat(_bits(F.substring(id_hash, 1, 16)), _bits(F.substring(row_hash, 1, 16))).alias("__bits"),
        F.coalesce(F.col(bytes_col).cast("long"), F.lit(0)).alias("__bytes")), "sharded-rows")

    out, low, largest = None, 0, rows.agg(F.sum("__bytes")).first()[0] or 0
    for ceiling in (ID_BITS, ID_BITS, ID_BITS + ROW_BITS, ID_BITS + ROW_BITS):
        # first the bits that even sizes need and a few more, then all bits of the part
        deep = max(1, -(-largest // limit) - 1).bit_length() + FINER
        high = ceiling if low % ID_BITS else min(low + deep, ceiling)
        entries, small = _directory(rows, low, high, limit)
        largest = entries.where("shard_id is null").agg(F.max("entry_bytes")).first()[0]
        found = _looked_up(rows, entries, small, high)
        if largest is not None:
            found = written(found.select(*base, "__bits", "__bytes", *ADDED[:-1]), "looked-up-rows")
        part = found.where("shard_id is not null").select(
            *base, *ADDED[:-1], (F.col("shard_bytes") > limit).alias("oversized"))
        out = part if out is None else out.unionByName(part)
        if largest is None:
            break
        rows = found.where("shard_id is null").select(*base, "__bits", "__bytes")
        low = high
    return out


def write_shards(df: DataFrame, path: str) -> None:
    """Write rows with their shard as Parquet, a folder for each shard. Rows
    are dealt by shard, and a shard's bytes are bounded, so no task holds more
    than its shards."""
    df.repartition("shard_id").write.partitionBy("shard_id").parquet(path)
