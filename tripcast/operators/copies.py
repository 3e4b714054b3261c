"""Repeated rows found by hash first (Q5, Q16).

Whole rows are wide. A first pass shuffles 16 bytes a row, two 64-bit hashes,
and keeps the hashes that occur more than once; they are written, so that Spark
knows their size and joins them by broadcast where they are few. Only rows that
share a hash are then compared in full, by grouping on all columns: the partial
aggregate folds a hot group of copies before it is shuffled. Rows of one hash
that differ stay apart, so the result is exact.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripcast.session import written

HASHES = ("__h1", "__h2")


def _cols(names: Sequence[str]):
    return [F.col(f"`{c}`") for c in names]


def _hashed(df: DataFrame, names: Sequence[str]) -> DataFrame:
    # NULLs leave a hash as it was, so each column's place in the row is hashed too
    marks = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in _cols(names)])
    return df.withColumns({HASHES[0]: F.xxhash64(*_cols(names), marks),
                           HASHES[1]: F.xxhash64(marks, *_cols(names)[::-1], F.lit(1))})


def repeated_hashes(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Hash pairs that more than one row has (written)."""
    pairs = _hashed(df.select(*_cols(names)), names).groupBy(*HASHES).agg(F.count(F.lit(1)).alias("__n"))
    return written(pairs.where("__n > 1").select(*HASHES), "repeated-hashes")


def parted(df: DataFrame, names: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``df`` as (rows that may be copies, rows that are certainly single)."""
    names = list(names or df.columns)
    hashes = repeated_hashes(df, names)
    rows = _hashed(df, names)
    return (rows.join(hashes, list(HASHES), "left_semi").drop(*HASHES),
            rows.join(hashes, list(HASHES), "left_anti").drop(*HASHES))


def copy_groups(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One row per group of two or more equal rows: the columns and ``copies``.
    NULLs compare equal."""
    names = list(names or df.columns)
    maybe, _ = parted(df.select(*_cols(names)), names)
    return maybe.groupBy(*_cols(names)).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def distinct_rows(df: DataFrame) -> DataFrame:
    """One of each group of equal rows; single rows pass straight through."""
    maybe, single = parted(df)
    return single.unionByName(maybe.dropDuplicates())
