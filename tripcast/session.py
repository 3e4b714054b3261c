"""SparkSession construction and shared-storage helpers."""

from __future__ import annotations

import atexit
import functools
import glob
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC wall clock (period truncation must not
# depend on the machine zone), AQE for runtime coalescing / skew splitting,
# no UI server.
_BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def spark_session(master: str | None = None, app: str = "tripcast",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(_BASE_CONF)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor
        conf["spark.driver.memory"] = "12g"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is only read here.
    Only a local master (tests, laptops), where driver and executor are one
    process, gets a scratch folder of its own when the setting is unset; any
    other master without the setting is refused, as its executors would each
    write to their own disk.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a "
                             f"non-local master ({master or 'unknown'})")
        d = tempfile.mkdtemp(prefix="tripcast-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def _scratch_root(spark: SparkSession) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tripcast-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-path of this application's folder in the shared checkpoint folder."""
    return f"{_scratch_root(spark)}/{name}"


def written(df, name: str):
    """``df`` written as Parquet into the shared checkpoint folder and read
    back: cuts the lineage, survives executor loss, and gives later joins the
    true size of the data."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables. Frames that still read
    them must have been written out before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once an application,
    so that they need neither an installation nor the driver's working folder.
    The driver serves the archive, which stays until it ends."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="tripcast-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with zipfile.ZipFile(os.path.join(folder, "tripcast.zip"), "w") as z:
        for path in sorted(glob.glob(os.path.join(root, "tripcast", "**", "*.py"), recursive=True)):
            z.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(os.path.join(folder, "tripcast.zip"))
    _shipped.add(app)


def shipping(query):
    """``query(spark, ...)`` after sending the package to the executors."""
    @functools.wraps(query)
    def run(spark, *args, **kwargs):
        ship_package(spark)
        return query(spark, *args, **kwargs)
    return run


def materialize(df):
    """Reliable checkpoint of an intermediate result into the shared
    checkpoint folder: cuts the lineage and survives executor loss.

    The frame is persisted first, so the eager count and the checkpoint
    write read the cache instead of computing the plan twice.
    """
    ensure_checkpoint_dir(df.sparkSession)
    df = df.persist()
    try:
        return df.checkpoint()
    finally:
        df.unpersist()
