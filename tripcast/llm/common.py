"""Small helpers the corpus operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tripcast.session import written

SLOTS_PER_ROW = 16
MIN_BITS, MAX_BITS = 1 << 18, 1 << 28   # of a bit table; at most 32 MB are broadcast


#: Texts are long: small batches, by rows and by bytes, bound what a task's scan, its Arrow buffers and its Python worker hold.
SMALL_BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": "2m",
    "spark.sql.parquet.columnarReaderBatchSize": "512",
}


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df`` unchanged, after asking its session for small batches."""
    for name, value in SMALL_BATCHES.items():
        df.sparkSession.conf.set(name, value)
    return df


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def with_fields(schema: StructType, **fields) -> StructType:
    """A new schema with further fields (name=DataType)."""
    return StructType([*schema.fields, *(StructField(n, t) for n, t in fields.items())])


def set_aside(df: DataFrame, names) -> tuple[DataFrame, dict]:
    """``df`` with the columns that clash with ``names`` renamed, and the
    renaming that brings them back."""
    taken = {n.lower() for n in names}
    away = {c: f"__in_{c}" for c in df.columns if c.lower() in taken}
    return df.withColumnsRenamed(away), {v: k for k, v in away.items()}


def bit_table_size(rows: int) -> int:
    """A power of two of about SLOTS_PER_ROW slots a row, within the bounds."""
    return min(MAX_BITS, max(MIN_BITS, 1 << (SLOTS_PER_ROW * max(rows, 1) - 1).bit_length()))


def bitmaps(slots: DataFrame) -> DataFrame:
    """The bits (bucket, bits) of a column ``slot``, as 4 KB bitmaps."""
    return written(slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")), "bitmaps")


def with_bitmap(df: DataFrame, maps: DataFrame, slot: str) -> DataFrame:
    """``df`` with the bitmap of each row's slot in ``<slot>_m``. The maps are at most MAX_BITS / 8 bytes."""
    side = F.broadcast(maps.select(F.col("bucket").alias(f"{slot}_b"), F.col("bits").alias(f"{slot}_m")))
    return df.join(side, F.bitmap_bucket_number(slot) == F.col(f"{slot}_b"), "left")


def is_set(slot: str):
    """Whether the slot's bit is set in its bitmap; a missing bitmap has none."""
    place = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(F.col(f"{slot}_m"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10)
    return F.coalesce(F.getbit(byte.cast("bigint"), (place % 8).cast("int")) == 1, F.lit(False))


def _split(df: DataFrame, ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose id may be among ``ids`` (column ``__id``), and those whose id is not."""
    bits = bit_table_size(ids.count())
    slot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bits))
    maps = bitmaps(ids.select(slot("__id").alias("slot")))
    probed = with_bitmap(df.withColumn("__slot", slot(id_col)), maps, "__slot")
    return tuple(probed.where(c).drop("__slot", "__slot_b", "__slot_m") for c in (is_set("__slot"), ~is_set("__slot")))


def rows_among(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``df`` whose id is in the one column of ``ids``. A bit table
    of bounded size holds most others back, so that wide rows that the result
    does not need are not shuffled; the join after it is exact."""
    ids = written(ids.select(F.col(ids.columns[0]).cast("long").alias("__id")), "ids")
    maybe, _ = _split(df, ids, id_col)
    return maybe.join(ids.hint("shuffle_hash"), F.col(id_col) == F.col("__id"), "left_semi")


def rows_flagged(df: DataFrame, ids: DataFrame, id_col: str, flag: str) -> DataFrame:
    """All rows of ``df``, with whether their id is in the one column of
    ``ids`` (distinct); most that are not pass straight through."""
    ids = written(ids.select(F.col(ids.columns[0]).cast("long").alias("__id")), "ids")
    maybe, rest = _split(df, ids, id_col)
    found = maybe.join(ids.hint("shuffle_hash"), F.col(id_col) == F.col("__id"), "left")
    return rest.withColumn(flag, F.lit(False)).unionByName(
        found.withColumn(flag, F.col("__id").isNotNull()).drop("__id"))


def rows_not_among(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``df`` whose id (null too) is not in the one column of
    ``ids``; most of them pass straight through."""
    ids = written(ids.select(F.col(ids.columns[0]).cast("long").alias("__id")), "ids")
    maybe, rest = _split(df, ids, id_col)
    return rest.unionByName(maybe.join(ids.hint("shuffle_hash"), F.col(id_col) == F.col("__id"), "left_anti"))
