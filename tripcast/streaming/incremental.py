"""Incremental, resumable daily demand.

Newly arrived month files are picked up by the file source; the checkpoint
makes a re-run resume where the last one stopped.  Counting is a tumbling 1-day
window per region; rows outside the stated month of their file are dropped by a
stateless predicate.  Two ways to keep the counts:

* **append**: with a watermark a day is written once, when it is over, into a
  file sink in shared storage; days still open are read from the state store of
  the same checkpoint, so closed and open days together are always whole.
* **update**: ``foreachBatch`` stores each micro-batch's new totals as a version
  of their own and then enters the batch into a commit table.  Nothing is
  overwritten in place: a batch that is replayed after a crash replaces its own
  uncommitted version, and one that was committed changes nothing.
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tripcast.functions.columns import epoch_seconds, month_start
from tripcast.sources.files import month_label, stated_month_from_name, stored_or_none

COUNTS_SCHEMA = "period timestamp_ntz, region string, demand long"
COMMIT_SCHEMA = "batch long, kind string, committed_at timestamp"


def stream_trips(spark: SparkSession, data_dir: str, schema: StructType,
                 max_files_per_trigger: Optional[int] = None, glob: str = "*.parquet",
                 monthly_names: bool = True) -> DataFrame:
    """File-source stream of trip files; with ``monthly_names`` only month files
    (or parts in a month file's folder) are kept, ``file_name`` is the month
    file and ``stated_month`` comes from its name. ``schema`` may be wider than
    a file's own (BIGINT over INT, a timestamp over a day)."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    df = r.parquet(data_dir)
    if not monthly_names:
        return df.withColumn("file_name", F.col("_metadata.file_name"))
    df = df.withColumn("file_name", month_label(F.col("_metadata.file_path")))
    df = df.withColumn("stated_month", stated_month_from_name("file_name"))
    return df.where(F.col("stated_month").isNotNull())


def in_stated_month(df: DataFrame, ts_col: str = "pickup_datetime") -> DataFrame:
    """Keep rows whose pickup month equals the file's stated month."""
    m = month_start(F.col(ts_col))
    return df.where(m.isNotNull() & (m == F.col("stated_month")))


def daily_counts(stream: DataFrame, ts_col: str = "pickup_datetime", region_col: str = "region",
                 watermark: Optional[str] = None) -> DataFrame:
    """Trips per (day, region) as a tumbling window aggregate.

    ``watermark`` (e.g. '2 days') bounds the state and allows append mode. It
    needs a TIMESTAMP, which is built from the wall clock as if it were UTC, so
    that days do not depend on the session's zone.
    """
    s = stream.where(F.col(region_col).isNotNull())
    if watermark:
        s = s.withColumn("__ts", F.timestamp_seconds(epoch_seconds(F.col(ts_col)))).withWatermark("__ts", watermark)
    else:
        # TIMESTAMP_NTZ windows are wall-clock windows, independent of the session zone
        s = s.withColumn("__ts", F.col(ts_col))
    g = s.groupBy(F.window("__ts", "1 day"), F.col(region_col).alias("region")).agg(
        F.count(F.lit(1)).cast("long").alias("demand"))
    start = _wall_day(F.col("window.start")) if watermark else F.col("window.start").cast("timestamp_ntz")
    return g.select(start.alias("period"), "region", "demand")


def _wall_day(start):
    """The day that a UTC day's TIMESTAMP stands for."""
    days = F.floor(F.unix_seconds(start) / 86400).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days).cast("timestamp_ntz")


# ------------------------------------------------------------------ append
def append_daily_counts(counts: DataFrame, out_path: str, checkpoint: str) -> None:
    """Write every day that is over by the watermark, once, as Parquet."""
    run_available(counts, checkpoint, sink="parquet", output_mode="append", path=out_path)


def closed_days(spark: SparkSession, out_path: str) -> DataFrame:
    """What :func:`append_daily_counts` has written (by the sink's own log)."""
    stored = stored_or_none(spark, out_path, COUNTS_SCHEMA)
    return spark.createDataFrame([], COUNTS_SCHEMA) if stored is None else stored


def open_days(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The days the watermark has not closed yet, from the checkpoint's state store."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(_wall_day(F.col("key.window.start")).alias("period"), F.col("key.region").alias("region"),
                        F.col("value.count").cast("long").alias("demand"))


# ------------------------------------------------------------------ update
def _committed(spark: SparkSession, out_path: str) -> DataFrame:
    done = stored_or_none(spark, f"{out_path}/commits", COMMIT_SCHEMA)
    return spark.createDataFrame([], COMMIT_SCHEMA) if done is None else done


def _commit(spark: SparkSession, out_path: str, batch: int, kind: str) -> None:
    entry = spark.range(1).select(F.lit(batch).cast("long").alias("batch"), F.lit(kind).alias("kind"),
                                  F.current_timestamp().alias("committed_at"))
    entry.write.mode("append").parquet(f"{out_path}/commits")


def stage_batch(batch: DataFrame, batch_id: int, out_path: str) -> None:
    """Store a batch's totals as version ``batch_id``; not read until committed."""
    rows = batch.select("period", "region", F.col("demand").cast("long").alias("demand"))
    rows.write.mode("overwrite").parquet(f"{out_path}/versions/batch={batch_id}")


def merge_stream_batch(out_path: str):
    """A ``foreachBatch`` sink for ``update`` output, in which a micro-batch
    holds the new total of every touched (period, region). Staged, then
    committed: exactly once, whatever is replayed."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if _committed(spark, out_path).where(F.col("batch") >= batch_id).take(1):
            return
        stage_batch(batch, batch_id, out_path)
        _commit(spark, out_path, batch_id, "batch")
    return sink


def read_merged(spark: SparkSession, out_path: str) -> DataFrame:
    """The stored series: each (period, region)'s total in its newest committed version."""
    done = _committed(spark, out_path).groupBy().agg(
        F.max("batch").alias("last"), F.max(F.when(F.col("kind") == "base", F.col("batch"))).alias("base")).first()
    if done["last"] is None:
        return spark.createDataFrame([], COUNTS_SCHEMA)
    parts = []
    if done["base"] is not None:
        base = spark.read.schema(COUNTS_SCHEMA).parquet(f"{out_path}/bases/batch={done['base']}")
        parts.append(base.withColumn("batch", F.lit(done["base"]).cast("long")))
    versions = spark.read.schema(COUNTS_SCHEMA + ", batch long").parquet(f"{out_path}/versions")
    committed = _committed(spark, out_path).where(F.col("kind") == "batch").select("batch").distinct()
    newer = versions.where(F.col("batch") > (-1 if done["base"] is None else done["base"]))
    parts.append(newer.join(committed, "batch", "left_semi").select("period", "region", "demand", "batch"))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.groupBy("period", "region").agg(F.max_by("demand", "batch").alias("demand"))


def compact(spark: SparkSession, out_path: str) -> None:
    """Write the merged series as a base, so that readers skip older versions."""
    last = _committed(spark, out_path).agg(F.max("batch")).first()[0]
    if last is not None:
        read_merged(spark, out_path).write.mode("overwrite").parquet(f"{out_path}/bases/batch={last}")
        _commit(spark, out_path, last, "base")


def run_available(query_df: DataFrame, checkpoint: str, *, sink: str = "memory", name: str = "daily_counts",
                  output_mode: str = "complete", foreach_batch=None, path: Optional[str] = None):
    """Run a streaming aggregate over everything available now and stop. The
    memory sink is for tests: it holds the result on the driver."""
    w = query_df.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
    if foreach_batch is not None:
        w = w.foreachBatch(foreach_batch)
    elif path is not None:
        w = w.format(sink).option("path", path)
    else:
        w = w.format(sink).queryName(name)
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    return q
