"""File scans and sinks.

Monthly trip files are read with **one** multi-file scan; the source file of
each row comes from the hidden ``_metadata.file_name`` column, so per-file
logic is a grouping column, never a driver loop over files.
"""

from __future__ import annotations

from typing import Optional, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (LongType, StringType, StructField, StructType,
                               TimestampNTZType)

from tripcast.functions.columns import to_ts
from tripcast.params import DEMAND, LOCATION, LOOKUP_BOROUGH, LOOKUP_ID, PERIOD, REGION, Scope
from tripcast.session import written

# Fixed value that must equal the reference's behaviour: monthly file names.
MONTH_FILE_PATTERN = r"(?i)^fhvhv_(tripdata_)?(\d{4})-(\d{2})\.parquet$"
#: The month file in a path: the file itself, or the folder that holds its parts.
MONTH_LABEL_PATTERN = r"(?i)(?:^|[/=])(fhvhv_(?:tripdata_)?\d{4}-\d{2}\.parquet)(?:/[^/]+)?$"

#: Error conditions that say a file is no readable Parquet.
UNREADABLE = ("CANNOT_READ_FILE_FOOTER", "UNABLE_TO_INFER_SCHEMA")

SERIES_SCHEMA = StructType([StructField(PERIOD, TimestampNTZType()),
                            StructField(REGION, StringType()),
                            StructField(DEMAND, LongType())])
LOOKUP_SCHEMA = StructType([StructField(LOOKUP_ID, LongType()),
                            StructField(LOOKUP_BOROUGH, StringType())])


# --------------------------------------------------------------------------- S1/S2
def read_trips(spark: SparkSession, path: str | Sequence[str],
               columns: Optional[Sequence[str]] = None, schema=None) -> DataFrame:
    """Parquet scan; a missing path raises FileNotFoundError naming it.

    ``columns`` projects right away so Catalyst prunes the scan.
    """
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        df = reader.parquet(*paths)
    except (PySparkException, Py4JJavaError) as e:
        # only these two mean a missing or unreadable file; all else is raised as it is
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"Parquet file not found: {paths}") from e
        if any(c in str(e) for c in UNREADABLE):
            raise ValueError(f"could not read Parquet at {paths}: {str(e)[:500]}") from e
        raise
    return df.select(*columns) if columns else df


# --------------------------------------------------------------------------- S3/S4/S5
def stated_month_from_name(name_col) -> "F.Column":
    """DATE of the month in a monthly file name; NULL when the name does not match."""
    c = F.col(name_col) if isinstance(name_col, str) else name_col
    # one match a row: the name ends in YYYY-MM.parquet if there is one
    part = lambda n, start, length: F.substring(n, start, length).try_cast("int")
    return F.transform(F.array(F.regexp_extract(c, MONTH_FILE_PATTERN, 0)), lambda n: F.try_make_timestamp_ntz(
        part(n, -15, 4), part(n, -10, 2), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("date"))[0]


def month_label(path_col) -> "F.Column":
    """The month file (or the month file's folder) that a path names; '' if none."""
    return F.regexp_extract(F.substring_index(path_col, "/", -2), MONTH_LABEL_PATTERN, 1)


def read_month_files(spark: SparkSession, data_dir: str, columns: Optional[Sequence[str]] = None,
                     latest_only: bool = False) -> DataFrame:
    """All rows of the monthly trip files of ``data_dir``, with ``file_name``
    and ``stated_month`` (from the name); columns whose types drift between
    months are widened. Other files are left out. See :mod:`.month_files`.
    """
    from tripcast.sources.month_files import scan_month_files
    return scan_month_files(spark, data_dir, columns, latest_only).rows


# --------------------------------------------------------------------------- S6/S7
def read_zone_lookup(spark: SparkSession, path: str) -> DataFrame:
    try:
        raw = spark.read.option("header", True).csv(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"zone lookup not found: {path}") from e
        raise
    return raw.select(F.col(LOOKUP_ID).try_cast("long").alias(LOOKUP_ID),
                      F.col(LOOKUP_BOROUGH).cast("string").alias(LOOKUP_BOROUGH))


def derive_zone_lookup(trips: DataFrame, location_col: str = LOCATION) -> DataFrame:
    """Fallback lookup: every observed id becomes its own region 'Region-<id>'."""
    ids = trips.select(F.col(location_col).alias(LOOKUP_ID)).where(F.col(LOOKUP_ID).isNotNull()).distinct()
    return ids.select(LOOKUP_ID, F.concat(F.lit("Region-"), F.col(LOOKUP_ID).cast("string"))
                      .alias(LOOKUP_BOROUGH))


# --------------------------------------------------------------------------- S8/S9
def read_series(spark: SparkSession, path: str, fmt: Optional[str] = None) -> DataFrame:
    """Load a prepared or uploaded (period, region, demand) table.

    Parquet first (or by extension), CSV otherwise; unparsable dates -> NULL.
    The three columns must be present (subset check).
    """
    fmt = fmt or ("csv" if path.lower().endswith(".csv") else "parquet")
    if fmt == "parquet":
        df = read_trips(spark, path)
    else:
        try:
            df = spark.read.option("header", True).csv(path)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                raise FileNotFoundError(f"series not found: {path}") from e
            raise
        if PERIOD in df.columns:
            df = df.withColumn(PERIOD, to_ts(F.col(PERIOD)))
        if DEMAND in df.columns:
            df = df.withColumn(DEMAND, F.col(DEMAND).try_cast("long"))
    missing = [c for c in (PERIOD, REGION, DEMAND) if c not in df.columns]
    if missing:
        raise ValueError(f"series at {path} lacks columns {missing}")
    return df


def read_first_series(spark: SparkSession, candidates: Sequence[str]) -> DataFrame:
    """The first of ``candidates`` (paths, in order) that is there and has
    the three columns. None: FileNotFoundError saying why each was passed over."""
    passed = []
    for path in candidates:
        try:
            return read_series(spark, path)
        except (FileNotFoundError, ValueError) as e:
            passed.append(f"{path}: {str(e)[:200]}")
    raise FileNotFoundError("no prepared series among " + "; ".join(passed or ["no candidates"]))


# --------------------------------------------------------------------------- S10
def write_series(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


# --------------------------------------------------------------------------- S11
def write_partials(partials: DataFrame, path: str) -> None:
    """Write (month, period, region, demand) partials, one folder per month.

    Dynamic partition overwrite replaces only the months present in
    ``partials``; months already on disk and absent here are kept (resume).
    """
    (partials.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("month").parquet(path))


def stored_or_none(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The table at ``path`` (any store), None where nothing was written yet;
    every other failure to read is raised."""
    try:
        return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def months_to_build(spark: SparkSession, wanted: DataFrame, path: str) -> DataFrame:
    """Months of ``wanted`` (column ``month``) that have no partial yet (left anti)."""
    done = stored_or_none(spark, path)
    return wanted if done is None else wanted.join(done.select("month").distinct(), "month", "left_anti")


# --------------------------------------------------------------------------- S12
def window_months_frame(spark: SparkSession, scope: Scope) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(
        F.lit(scope.window_start.replace(day=1)), F.lit(scope.window_end.replace(day=1)),
        F.expr("INTERVAL 1 MONTH"))).alias("month"))


def missing_months(present: DataFrame, scope: Scope) -> DataFrame:
    """Window months (DATE, first day) without data in ``present.month``."""
    want = window_months_frame(present.sparkSession, scope)
    have = present.select(F.col("month").cast("date").alias("month")).distinct()
    return want.join(have, "month", "left_anti")


def assert_months_complete(present: DataFrame, scope: Scope) -> None:
    miss = [r["month"] for r in missing_months(present, scope).collect()]  # <= 24 rows
    if miss:
        raise RuntimeError(f"partials missing for months {sorted(miss)}; refusing to combine")


# --------------------------------------------------------------------------- S14
def merge_forecasts(old: DataFrame, new: DataFrame, key: str = "model") -> DataFrame:
    """Replace the rows of every model present in ``new``; keep the others.

    The names in ``new`` (a row a model) are written, so that Spark knows their
    size, and the old rows are kept by an anti join with them.
    """
    names = written(new.select(key).where(F.col(key).isNotNull()).distinct(), "merged-models")
    return old.join(names, key, "left_anti").unionByName(new)
