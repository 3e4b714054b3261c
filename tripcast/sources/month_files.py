"""Monthly trip files whose types drift, and their resumable partial counts.

A *month file* is a Parquet file, or a folder of part files, whose name states
its month (``fhvhv_tripdata_2025-05.parquet``); a partition folder such as
``file=fhvhv_tripdata_2025-05.parquet`` counts too. Listing, footers and scans
go through Spark's readers, so any store Spark can read will do.

* **Types drift** between months (an id turns from INT into BIGINT, a day into
  a timestamp, a column is renamed or appears). Spark merges the footers of a
  run of neighbouring files in one parallel job; where their types conflict the
  run is halved. Each schema group becomes one scan, its columns are widened to
  the common type, and the groups are united: as many scans as there are
  schemas, not files.
* **Partial counts** are immutable builds. A ledger row (file, fingerprint,
  rows) is appended only after the build's counts are written, and a reader
  takes the counts of ledgered builds of files as they are now. A changed or
  new file is rebuilt, a vanished one no longer counts, and a build that was
  interrupted half-way is never read.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Optional, Sequence

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ByteType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType,
                               LongType, ShortType, StringType, StructField, StructType, TimestampNTZType,
                               TimestampType)

from tripcast.operators.quality import resolve_timestamp_name
from tripcast.params import DEMAND, LOCATION, PERIOD, PICKUP, REGION
from tripcast.session import written
from tripcast.sources.files import MONTH_LABEL_PATTERN, stated_month_from_name, stored_or_none

FILE, MONTH = "file_name", "stated_month"
FOOTER_JOBS = 8
_WHOLE = [ByteType(), ShortType(), IntegerType(), LongType()]
_WHOLE_DIGITS = {ByteType(): 3, ShortType(): 5, IntegerType(): 10, LongType(): 19}

LEDGER_SCHEMA = ("build string, built_at timestamp, file_name string, stated_month date, n_parts long, "
                 "size long, modified timestamp, print long, rows long, counted long")
PARTIAL_SCHEMA = "build string, file_name string, stated_month date, period timestamp_ntz, region string, demand long"


# ----------------------------------------------------------------- listing
def _label(path):
    return F.regexp_extract(path, MONTH_LABEL_PATTERN, 1)


def list_month_files(spark: SparkSession, data_dir: str) -> DataFrame:
    """The parts of all month files: (file_name, stated_month, path, size, modified).

    Spark's listing of the folder; contents are not read. A missing folder
    raises FileNotFoundError; other names and impossible months are left out.
    """
    try:
        listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                  .option("pathGlobFilter", "*.parquet").load(data_dir))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"data directory not found: {data_dir}") from e
        raise
    rows = listed.select(_label(F.col("path")).alias(FILE), "path", F.col("length").alias("size"),
                         F.col("modificationTime").alias("modified"))
    return (rows.withColumn(MONTH, stated_month_from_name(FILE)).where(F.col(MONTH).isNotNull())
            .select(FILE, MONTH, "path", "size", "modified"))


def fingerprints(files: DataFrame) -> DataFrame:
    """One row per month file: parts, bytes, newest change and a hash of all its
    parts' (path, size, change) that does not depend on their order."""
    return files.groupBy(FILE, MONTH).agg(
        F.count(F.lit(1)).alias("n_parts"), F.sum("size").alias("size"), F.max("modified").alias("modified"),
        F.bit_xor(F.xxhash64("path", "size", "modified")).alias("print"))


# ----------------------------------------------------------------- schema groups
@dataclass(frozen=True)
class SchemaGroup:
    """Month files of one schema."""
    schema: StructType
    files: tuple[str, ...]
    paths: tuple[str, ...]


def schema_groups(spark: SparkSession, parts: Sequence[tuple[str, str]]) -> list[SchemaGroup]:
    """(file, path) rows grouped by their files' schemas, in order of the files.
    A file's footers are read by Spark (all parts' at once, merged); FOOTER_JOBS
    files at a time. An unreadable file raises ValueError naming it."""
    names = sorted({f for f, _ in parts})
    by_file = {n: sorted(p for f, p in parts if f == n) for n in names}

    def schema_of(name):
        try:
            return spark.read.option("mergeSchema", len(by_file[name]) > 1).parquet(*by_file[name]).schema
        except (PySparkException, Py4JJavaError) as e:
            raise ValueError(f"could not read Parquet file {name}: {str(e)[:500]}") from e

    with ThreadPoolExecutor(FOOTER_JOBS) as pool:
        schemas = list(pool.map(inheritable_thread_target(spark)(schema_of), names))
    groups: dict[tuple, list] = {}
    for name, schema in zip(names, schemas):
        groups.setdefault(tuple((f.name, f.dataType) for f in schema.fields), [schema, []])[1].append(name)
    return [SchemaGroup(schema, tuple(files), tuple(p for f in files for p in by_file[f]))
            for schema, files in groups.values()]


def common_type(a: DataType, b: DataType) -> DataType:
    """The narrowest type that holds the values of both; text where there is none."""
    if a == b:
        return a
    if a in _WHOLE and b in _WHOLE:
        return max(a, b, key=_WHOLE.index)
    floats, dates = (FloatType, DoubleType), (DateType, TimestampNTZType, TimestampType)
    number = lambda t: t in _WHOLE or isinstance(t, (*floats, DecimalType))
    if number(a) and number(b):
        if isinstance(a, floats) or isinstance(b, floats):
            return DoubleType()
        a, b = (t if isinstance(t, DecimalType) else DecimalType(_WHOLE_DIGITS[t], 0) for t in (a, b))
        scale = max(a.scale, b.scale)
        digits = max(a.precision - a.scale, b.precision - b.scale) + scale
        return DecimalType(digits, scale) if digits <= 38 else DoubleType()
    if isinstance(a, dates) and isinstance(b, dates):
        return TimestampNTZType()  # wall clock, as everywhere in the engine
    return StringType()


def widened(groups: Sequence[SchemaGroup], ts_col: str = PICKUP) -> StructType:
    """The columns of all groups in order of appearance, with their common
    types; a group's variant of the pickup column counts as the pickup column."""
    found: dict[str, StructField] = {}
    for group in groups:
        for name, field in _renamed(group, ts_col):
            have = found.get(name.lower())
            kind = field.dataType if have is None else common_type(have.dataType, field.dataType)
            found[name.lower()] = StructField(have.name if have else name, kind, True)
    return StructType(list(found.values()))


def _renamed(group: SchemaGroup, ts_col: str) -> list[tuple[str, StructField]]:
    pickup = resolve_timestamp_name(group.schema.names, ts_col)
    return [(ts_col if f.name == pickup else f.name, f) for f in group.schema.fields]


# ----------------------------------------------------------------- scan
@dataclass(frozen=True)
class MonthFiles:
    """All rows of the month files (widened columns, file_name, stated_month),
    and each file's own columns and types."""
    rows: DataFrame
    schemas: DataFrame


def scan_month_files(spark: SparkSession, data_dir: str, columns: Optional[Sequence[str]] = None,
                     latest_only: bool = False, files: Optional[DataFrame] = None,
                     ts_col: str = PICKUP) -> MonthFiles:
    """The month files of ``data_dir`` (those in ``files``, if given) in one plan
    with a scan for each schema group. Without any file: ValueError."""
    parts = list_month_files(spark, data_dir) if files is None else files
    listed = parts.select(FILE, MONTH, "path").collect()  # names only: a row per part file
    if latest_only and listed:
        newest = max(r[MONTH] for r in listed)
        listed = [r for r in listed if r[MONTH] == newest]
    if not listed:
        raise ValueError(f"no monthly trip files under {data_dir}")
    groups = schema_groups(spark, [(r[FILE], r["path"]) for r in listed])
    target = widened(groups, ts_col)
    if columns:
        lower = {c.lower() for c in columns}
        target = StructType([f for f in target.fields if f.name.lower() in lower])
        if missing := lower - {f.name.lower() for f in target.fields}:
            raise KeyError(f"monthly files under {data_dir} lack column(s) {sorted(missing)}")

    united = None
    for group in groups:
        there = {name.lower(): f.name for name, f in _renamed(group, ts_col)}
        scan = spark.read.schema(group.schema).parquet(*group.paths)
        rows = scan.select(
            *[(F.col(f"`{there[f.name.lower()]}`") if f.name.lower() in there else F.lit(None))
              .cast(f.dataType).alias(f.name) for f in target.fields],
            _label(F.col("_metadata.file_path")).alias(FILE))
        united = rows if united is None else united.unionByName(rows)
    united = united.withColumn(MONTH, stated_month_from_name(FILE))

    own = [(name, i, f.name, f.dataType.simpleString())
           for g in groups for name in g.files for i, f in enumerate(g.schema.fields)]
    schemas = spark.createDataFrame(own, "file_name string, ordinal int, column string, dtype string")
    return MonthFiles(united, schemas)


# ----------------------------------------------------------------- partial counts
def _ledger_path(root: str) -> str:
    return f"{root.rstrip('/')}/ledger"


def _counts_path(root: str) -> str:
    return f"{root.rstrip('/')}/counts"


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """The newest ledger row of every file (none where nothing was built)."""
    rows = stored_or_none(spark, _ledger_path(root), LEDGER_SCHEMA)
    if rows is None:
        return spark.createDataFrame([], LEDGER_SCHEMA)
    newest = rows.groupBy(FILE).agg(F.max_by(F.struct(*[c for c in rows.columns if c != FILE]),
                                             F.struct("built_at", "build")).alias("r"))
    return newest.select(FILE, "r.*").select(*[f.split()[0] for f in LEDGER_SCHEMA.split(", ")])


def files_to_build(spark: SparkSession, files: DataFrame, root: str) -> DataFrame:
    """Fingerprints of the month files without a finished build of what they are now."""
    done = ledger(spark, root).select(FILE, "n_parts", "size", "print")
    return fingerprints(files).join(done, [FILE, "n_parts", "size", "print"], "left_anti")


def build_partials(spark: SparkSession, data_dir: str, root: str, lookup: DataFrame,
                   location_col: str = LOCATION) -> DataFrame:
    """Count the trips of every new or changed month file by (file, day, region)
    and enter the files into the ledger. Returns the ledger's new rows.

    Trips outside of their file's month are not counted. Counts first, ledger
    last: a build that is interrupted leaves counts that nobody reads.
    """
    from tripcast.operators import prepare as P
    from tripcast.operators.quality import apply_validity_rules
    parts = written(list_month_files(spark, data_dir), "month-files")
    todo = written(files_to_build(spark, parts, root), "files-to-build")
    names = todo.select(FILE)
    build = uuid.uuid4().hex
    schema = LEDGER_SCHEMA
    if not todo.take(1):
        return spark.createDataFrame([], schema)
    scan = scan_month_files(spark, data_dir, [PICKUP, location_col], files=parts.join(names, FILE, "left_semi"))
    inside, _ = apply_validity_rules(scan.rows, stated_month=None, non_negative_columns=[], month_col=MONTH)
    zones = P.dedup_lookup(lookup).select(F.col("LocationID").alias("__zone"), F.col("Borough").alias(REGION))
    # every (file, zone, day) is counted where it is read; only counts meet the lookup
    per_zone = (inside.groupBy(FILE, MONTH, F.col(location_col).alias("__at"),
                               P.truncate_to_grain(F.col(PICKUP)).alias(PERIOD))
                .agg(F.count(F.lit(1)).alias("__n")))
    counts = (per_zone.join(zones, F.col("__at") == F.col("__zone"), "left")
              .groupBy(FILE, MONTH, PERIOD, REGION).agg(F.sum("__n").cast("long").alias(DEMAND))
              .select(F.lit(build).alias("build"), FILE, MONTH, PERIOD, REGION, DEMAND))
    counts.write.mode("append").partitionBy("build").parquet(_counts_path(root))

    stored = spark.read.schema(PARTIAL_SCHEMA).parquet(_counts_path(root)).where(F.col("build") == build)
    known = F.col(PERIOD).isNotNull() & F.col(REGION).isNotNull()
    rows = stored.groupBy(FILE).agg(F.sum(DEMAND).alias("rows"), F.sum(F.when(known, F.col(DEMAND))).alias("counted"))
    zero = F.lit(0).cast("long")
    entry = (todo.join(rows, FILE, "left")
             .select(F.lit(build).alias("build"), F.current_timestamp().alias("built_at"), FILE, MONTH, "n_parts",
                     "size", "modified", "print", F.coalesce("rows", zero).alias("rows"),
                     F.coalesce("counted", zero).alias("counted")))
    entry = written(entry, "ledger-rows")
    entry.coalesce(1).write.mode("append").parquet(_ledger_path(root))
    return entry


def read_partials(spark: SparkSession, data_dir: str, root: str) -> DataFrame:
    """(stated_month, period, region, demand) of the files that are there now
    and whose newest build is finished; fails while a file waits to be built."""
    present = list_month_files(spark, data_dir)
    waiting = [r[FILE] for r in files_to_build(spark, present, root).select(FILE).collect()]
    if waiting:
        raise RuntimeError(f"partials of {sorted(waiting)} are not built; refusing to combine")
    counts = stored_or_none(spark, _counts_path(root), PARTIAL_SCHEMA)
    if counts is None:
        return spark.createDataFrame([], "stated_month date, period timestamp_ntz, region string, demand long")
    good = ledger(spark, root).join(present.select(FILE).distinct(), FILE, "left_semi").select("build", FILE)
    return (counts.join(good, ["build", FILE], "left_semi")
            .where(F.col(PERIOD).isNotNull() & F.col(REGION).isNotNull())
            .groupBy(MONTH, PERIOD, REGION).agg(F.sum(DEMAND).cast("long").alias(DEMAND)))
