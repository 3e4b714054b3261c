"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 hashes every text to two slots of a bit table and keeps the slots that
at least two rows hit; the table is stored as 4 KB bitmaps. Pass 2 probes it: a
row with a slot that nobody else hit is unique and passes straight through.
Only the other rows - true repeats and the few false alarms - shuffle, and the
exact comparison is made among them on (SHA-256, length).

The bit table has 16 slots a row up to ``MAX_BITS`` (32 MB, the proven bound of
the broadcast). With more rows than that serves, more rows take the shuffle;
the result is the same.

Defined cases: a null text counts as empty, and all empty texts are equal; of
equal texts every row that carries the largest non-null id is marked kept (ids
repeated with the same text tie; ``drop_copies`` leaves one of them); in a
group whose ids are all null ``keep_id`` is null and every row is marked kept.
An empty table gives an empty result. Input columns named like the added ones
are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripcast.llm.common import bit_table_size, bitmaps, is_set, set_aside, with_bitmap

SALTS = 16  # parts into which one group of copies is dealt for the join
ADDED = ["keep_id", "group_size", "kept", "text_sha256"]


def _slots(text, bits: int) -> list:
    """Two slots, one in each half of the bit table."""
    half = bits // 2
    return [F.pmod(F.xxhash64(text), F.lit(half)),
            F.pmod(F.xxhash64(text, F.lit(1)), F.lit(half)) + half]


def repeated_bits(df: DataFrame, text, rows: int) -> tuple[DataFrame, int]:
    """Pass 1: bitmaps (bucket, bits) of the slots that two or more rows hit."""
    bits = bit_table_size(rows)
    hits = (df.select(F.explode(F.array(*_slots(text, bits))).alias("slot"))
            .groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where("n >= 2"))
    return bitmaps(hits), bits


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``df`` plus keep_id, group_size, kept and
    text_sha256 (lowercase hex of the UTF-8 text)."""
    df = df.drop(*ADDED)
    kept_cols = df.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    maps, bits = repeated_bits(df, text, df.count())

    s1, s2 = _slots(text, bits)
    probed = df.withColumns({"__s1": s1, "__s2": s2, "text_sha256": F.sha2(text, 256),
                             "__len": F.length(text)})
    for s in ("__s1", "__s2"):
        probed = with_bitmap(probed, maps, s)
    maybe = is_set("__s1") & is_set("__s2")
    base = [F.col(f"`{c}`") for c in kept_cols]

    unique = probed.where(~maybe).select(
        *base, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")

    rest = probed.where(maybe).select(
        *base, "text_sha256", F.unhex("text_sha256").alias("__sha"), "__len",
        F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(SALTS)).alias("__salt"))
    groups = (rest.groupBy("__sha", "__len")
              .agg(F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
              .where("group_size > 1")
              .withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"),
                                                        F.lit(SALTS - 1).cast("long")))))
    joined = rest.join(groups, ["__sha", "__len", "__salt"], "left").select(
        *base,
        F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("group_size").isNull() | F.col(id_col).eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256")
    return unique.unionByName(joined)


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay: one of each text, with all columns as they were."""
    safe, back = set_aside(df, ADDED)
    out = exact_dedup(safe, id_col, text_col).where("kept")
    once = out.where("group_size = 1")
    # repeated ids (and null ids) may tie: one row of each text, chosen by a partial aggregate
    ties = out.where("group_size > 1").dropDuplicates(["text_sha256"])
    return once.unionByName(ties).drop(*ADDED).withColumnsRenamed(back)
