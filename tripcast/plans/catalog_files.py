"""Registered queries over month files, their ledger and streams (S1-S5, S11, Q11, X1-X3),
and fuller rows of the quality operators (Q5, Q9, Q10, Q14-Q17, P9).

The month files are derived from ``orders`` and written into the shared scratch
folder in two schemas, as a feed whose types changed in 1998: before that the
pickup is a DATE under another spelling, the location an INT and there is no
fare. One order in fifty lies in the file of the following month.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tripcast.operators import quality as Q
from tripcast.plans.catalog import r6, register
from tripcast.session import scratch_path
from tripcast.sources import month_files as M
from tripcast.sources import tables as T
from tripcast.streaming import incremental as X

CHANGE = "1998-01-01"
GIVEN = {"fhvhv_tripdata_1995-02.parquet": (1995, 2), "fhvhv_tripdata_1996-06.parquet": (1996, 7),
         "fhvhv_tripdata_2000-03.parquet": (2000, 3)}

SQL_FEED = f"""
  feed AS (
    SELECT *, 'fhvhv_tripdata_' || strftime(label, '%Y-%m') || '.parquet' AS file_name,
           date_trunc('month', pickup_datetime)::DATE AS month, label::DATE AS stated_month
    FROM (SELECT o_orderkey AS row_id,
                 CASE WHEN l < DATE '{CHANGE}' THEN date_trunc('day', o_orderdate) ELSE o_orderdate END::TIMESTAMP AS pickup_datetime,
                 o_custkey AS PULocationID,
                 CASE WHEN l >= DATE '{CHANGE}' THEN o_totalprice END AS base_passenger_fare, l AS label
          FROM (SELECT *, (date_trunc('month', o_orderdate)
                           + CASE WHEN o_orderkey % 50 = 0 THEN INTERVAL 1 MONTH ELSE INTERVAL 0 MONTH END)::DATE AS l
                FROM orders WHERE o_orderdate IS NOT NULL)))"""
SQL_ZONES = """
  zones AS (
    SELECT c.c_custkey AS zone, min(r.r_name) AS region
    FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
                    JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1)"""


def feed_rows(spark, sf_dir):
    """Orders with the month file each lies in."""
    o = T.table(spark, sf_dir, "orders").where("o_orderdate IS NOT NULL")
    own = F.trunc(F.col("o_orderdate").cast("date"), "MM")
    label = F.add_months(own, F.when(F.col("o_orderkey") % 50 == 0, 1).otherwise(0))
    return o.withColumn("label", label).withColumn(
        "file", F.concat(F.lit("fhvhv_tripdata_"), F.date_format("label", "yyyy-MM"), F.lit(".parquet")))


def write_feed(rows, path: str, mode: str = "errorifexists") -> None:
    """Month files in folders ``file=<month file>``, one write per schema."""
    old, new = rows.where(F.col("label") < CHANGE), rows.where(F.col("label") >= CHANGE)
    old = old.select(F.col("o_orderkey").alias("row_id"), F.col("o_orderdate").cast("date").alias("Pickup_DateTime"),
                     F.col("o_custkey").cast("int").alias("PULocationID"), "file")
    new = new.select(F.col("o_orderkey").alias("row_id"), F.col("o_orderdate").alias("pickup_datetime"),
                     F.col("o_custkey").alias("PULocationID"), F.col("o_totalprice").alias("base_passenger_fare"), "file")
    for part, how in ((old, mode), (new, "append" if mode == "errorifexists" else mode)):
        part.write.mode(how).option("partitionOverwriteMode", "dynamic").partitionBy("file").parquet(path)


def month_feed(spark, sf_dir) -> str:
    path = scratch_path(spark, f"feed-{uuid.uuid4().hex}")
    write_feed(feed_rows(spark, sf_dir), path)
    return path


# ====================================================================== S1-S5
@register("read_month_files", f"WITH {SQL_FEED}" + """
SELECT row_id, pickup_datetime, PULocationID, base_passenger_fare, file_name, stated_month FROM feed""")
def read_month_files_q(spark, sf_dir):
    """The month files of both schemas, columns widened."""
    from tripcast.sources.files import read_month_files
    return read_month_files(spark, month_feed(spark, sf_dir))


@register("read_trips_files", """
SELECT CAST(o_orderdate AS TIMESTAMP) AS pickup_datetime, o_custkey AS PULocationID FROM orders""")
def read_trips_files_q(spark, sf_dir):
    """Trips written to the shared folder and read back, two columns."""
    from tripcast.sources.files import read_trips
    path = scratch_path(spark, f"trips-{uuid.uuid4().hex}")
    T.trips_orders(spark, sf_dir).write.parquet(path)
    return read_trips(spark, path, ["pickup_datetime", "PULocationID"])


@register("month_file_schemas", f"WITH {SQL_FEED}, " + f"""
files AS (SELECT file_name, min(stated_month) AS m FROM feed GROUP BY 1)
SELECT file_name, c.ordinal, c."column", c.dtype FROM files JOIN (VALUES
  (true, 0, 'row_id', 'bigint'), (true, 1, 'Pickup_DateTime', 'date'), (true, 2, 'PULocationID', 'int'),
  (false, 0, 'row_id', 'bigint'), (false, 1, 'pickup_datetime', 'timestamp_ntz'), (false, 2, 'PULocationID', 'bigint'),
  (false, 3, 'base_passenger_fare', 'double')) c(old, ordinal, "column", dtype) ON c.old = (files.m < DATE '{CHANGE}')""")
def month_file_schemas_q(spark, sf_dir):
    """Every month file's own columns and types, from its footers."""
    return M.scan_month_files(spark, month_feed(spark, sf_dir)).schemas


_GIVEN_SQL = " ".join(f"WHEN '{f}' THEN DATE '{y}-{m:02d}-01'" for f, (y, m) in GIVEN.items())
_EXAMPLE_SQL = """('{"row_id":' || row_id || ',"pickup_datetime":"' || strftime(pickup_datetime, '%Y-%m-%dT%H:%M:%S.%g')
  || '","PULocationID":' || PULocationID || CASE WHEN base_passenger_fare IS NULL THEN '' ELSE
  ',"base_passenger_fare":' || base_passenger_fare END || '}')"""


@register("month_files_report", f"""WITH {SQL_FEED},
bym AS (SELECT file_name, month, count(*) AS n FROM feed GROUP BY ALL),
modal AS (SELECT file_name, month AS modal FROM (
  SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY n DESC, month) AS k FROM bym) WHERE k = 1),
rows_ AS (SELECT f.*, CASE f.file_name {_GIVEN_SQL} ELSE modal END AS stated, f.stated_month < DATE '{CHANGE}' AS old
          FROM feed f JOIN modal USING (file_name)),
files AS (SELECT file_name AS file, any_value(old) AS old, count(*) AS n, row_number() OVER (ORDER BY file_name) - 1 AS file_ordinal,
                 min(pickup_datetime) AS lo, max(pickup_datetime) AS hi,
                 count(*) FILTER (WHERE month <> stated) AS out_n,
                 arg_min({_EXAMPLE_SQL}, row_id) FILTER (WHERE month <> stated) AS out_x,
                 count(*) FILTER (WHERE base_passenger_fare < 0) AS neg_n,
                 arg_min({_EXAMPLE_SQL}, row_id) FILTER (WHERE base_passenger_fare < 0) AS neg_x,
                 count(*) FILTER (WHERE row_id IS NULL) AS n0, count(*) FILTER (WHERE pickup_datetime IS NULL) AS n1,
                 count(*) FILTER (WHERE PULocationID IS NULL) AS n2,
                 count(*) FILTER (WHERE base_passenger_fare IS NULL OR isnan(base_passenger_fare)) AS n3
          FROM rows_ GROUP BY file_name),
dups AS (SELECT file_name AS file, sum(c - 1) AS d FROM (
  SELECT file_name, count(*) AS c FROM feed GROUP BY file_name, row_id, pickup_datetime, PULocationID, base_passenger_fare) GROUP BY 1),
cols AS (SELECT * FROM (VALUES
  (true, 0, 'row_id', 'row_id', 'bigint'), (true, 1, 'Pickup_DateTime', 'pickup_datetime', 'date'),
  (true, 2, 'PULocationID', 'PULocationID', 'int'),
  (false, 0, 'row_id', 'row_id', 'bigint'), (false, 1, 'pickup_datetime', 'pickup_datetime', 'timestamp_ntz'),
  (false, 2, 'PULocationID', 'PULocationID', 'bigint'),
  (false, 3, 'base_passenger_fare', 'base_passenger_fare', 'double')) c(old, ordinal, own, name, dtype)),
nulls AS (SELECT f.*, c.ordinal, c.name, CASE c.ordinal WHEN 0 THEN n0 WHEN 1 THEN n1 WHEN 2 THEN n2 ELSE n3 END AS c
          FROM files f JOIN cols c ON c.old = f.old)
SELECT file_ordinal::INT AS file_ordinal, file, 'schema' AS section, c.ordinal, c.own AS key, 'dtype' AS metric, n::DOUBLE AS value, c.dtype AS text
  FROM files f JOIN cols c ON c.old = f.old
UNION ALL SELECT file_ordinal, file, 'nulls', ordinal, name, 'null_count', c::DOUBLE, NULL FROM nulls
UNION ALL SELECT file_ordinal, file, 'nulls', ordinal, name, 'null_pct', round(c * 100.0 / n, 6), NULL FROM nulls
UNION ALL SELECT file_ordinal, file, 'date_range', 0, 'pickup_datetime', 'min', NULL, lo::VARCHAR FROM files
UNION ALL SELECT file_ordinal, file, 'date_range', 1, 'pickup_datetime', 'max', NULL, hi::VARCHAR FROM files
UNION ALL SELECT file_ordinal, file, 'duplicates', 0, 'all_columns', 'duplicate_count', d::DOUBLE, NULL FROM files JOIN dups USING (file)
UNION ALL SELECT file_ordinal, file, 'violations', 0, 'pickup_outside_stated_month', 'count', out_n::DOUBLE, out_x FROM files WHERE out_n > 0
UNION ALL SELECT file_ordinal, file, 'violations', 1, 'negative_base_passenger_fare', 'count', neg_n::DOUBLE, neg_x FROM files WHERE neg_n > 0""")
def month_files_report_q(spark, sf_dir):
    """The full report of every month file: three months given, the
    others each file's commonest; in order of the file names."""
    scan = M.scan_month_files(spark, month_feed(spark, sf_dir))
    return r6(Q.full_report_by_file(scan.rows.drop(M.MONTH), M.FILE, stated_months=GIVEN, order_key="row_id",
                                    schemas=scan.schemas), "value")


# ====================================================================== S11
CHANGED, ADDED = "fhvhv_tripdata_1997-05.parquet", "fhvhv_tripdata_2001-07.parquet"
CHANGED_BELOW = 150000


def _resumed(spark, sf_dir):
    """Partials of a feed that grew and changed: built; then one file added, one
    rewritten, a build interrupted before its ledger row; then built again."""
    base = uuid.uuid4().hex
    feed, root = scratch_path(spark, f"feed-{base}"), scratch_path(spark, f"partials-{base}")
    rows, lookup = feed_rows(spark, sf_dir), T.zone_lookup_customers(spark, sf_dir)
    write_feed(rows.where(F.col("file") != ADDED), feed)
    M.build_partials(spark, feed, root, lookup)
    changed = rows.where((F.col("file") == ADDED) | (F.col("file") == CHANGED) & (F.col("o_totalprice") < CHANGED_BELOW))
    write_feed(changed, feed, mode="overwrite")
    crashed = spark.read.schema(M.PARTIAL_SCHEMA).parquet(f"{root}/counts").withColumn("build", F.lit("interrupted"))
    crashed.write.mode("append").partitionBy("build").parquet(f"{root}/counts")
    M.build_partials(spark, feed, root, lookup)
    return feed, root


SQL_RESUMED = f"WITH {SQL_FEED}, {SQL_ZONES}," + f"""
  now AS (SELECT f.*, z.region FROM feed f LEFT JOIN zones z ON f.PULocationID = z.zone
          JOIN orders o ON o.o_orderkey = f.row_id
          WHERE f.file_name <> '{CHANGED}' OR o.o_totalprice < {CHANGED_BELOW})"""


@register("partials_ledger", SQL_RESUMED + f"""
SELECT file_name, stated_month, count(*) FILTER (WHERE month = stated_month) AS rows,
       count(*) FILTER (WHERE month = stated_month AND region IS NOT NULL) AS counted,
       CASE file_name WHEN '{CHANGED}' THEN 2 ELSE 1 END::BIGINT AS builds
FROM now GROUP BY file_name, stated_month""")
def partials_ledger_q(spark, sf_dir):
    """The ledger after a resume; only the changed file was built twice."""
    _, root = _resumed(spark, sf_dir)
    builds = spark.read.schema(M.LEDGER_SCHEMA).parquet(f"{root}/ledger").groupBy(M.FILE).agg(
        F.count(F.lit(1)).alias("builds"))
    return M.ledger(spark, root).join(builds, M.FILE).select(M.FILE, M.MONTH, "rows", "counted", "builds")


@register("partials_resumed", SQL_RESUMED + """
SELECT stated_month, date_trunc('day', pickup_datetime)::TIMESTAMP AS period, region, count(*) AS demand
FROM now WHERE month = stated_month AND region IS NOT NULL GROUP BY ALL""")
def partials_resumed_q(spark, sf_dir):
    """The counts that a resumed build combines."""
    feed, root = _resumed(spark, sf_dir)
    return M.read_partials(spark, feed, root)


# ====================================================================== X1-X3
SQL_STREAMED = f"WITH {SQL_FEED}, {SQL_ZONES}" + """
SELECT date_trunc('day', pickup_datetime)::TIMESTAMP AS period, region, count(*) AS demand
FROM feed JOIN zones ON PULocationID = zone WHERE month = stated_month GROUP BY ALL"""


def _month_stream(spark, sf_dir, batches=None):
    """Trips of the month files as a stream, in at least so many micro-batches if there are as many files."""
    feed = month_feed(spark, sf_dir)
    listed = M.list_month_files(spark, feed).select(M.FILE, "path").collect()
    schema = M.widened(M.schema_groups(spark, [(r[0], r[1]) for r in listed]))
    files_per_batch = max(1, -(-len(listed) // batches)) if batches else None
    trips = X.in_stated_month(X.stream_trips(spark, feed, schema, files_per_batch))
    zones = T.zone_lookup_customers(spark, sf_dir).select(
        F.col("LocationID").alias("PULocationID"), F.col("Borough").alias("region"))
    return trips.join(zones, "PULocationID")


@register("stream_month_files", SQL_STREAMED)
def stream_month_files_q(spark, sf_dir):
    """Month files as a stream, checked against their month, appended
    day by day to files in the shared folder; open days from the state."""
    trips = _month_stream(spark, sf_dir)
    path = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    X.append_daily_counts(X.daily_counts(trips, watermark="2 days"), f"{path}/days", f"{path}/checkpoint")
    return X.closed_days(spark, f"{path}/days").unionByName(X.open_days(spark, f"{path}/checkpoint"))


@register("merge_stream_replayed", SQL_STREAMED)
def merge_stream_replayed_q(spark, sf_dir):
    """Three or more micro-batches merged; every one is staged by an attempt that
    crashes before its commit, replayed, and replayed again after its commit."""
    trips = _month_stream(spark, sf_dir, batches=3)
    path = scratch_path(spark, f"merge-{uuid.uuid4().hex}")
    merge = X.merge_stream_batch(f"{path}/series")

    def crashing(batch, batch_id):
        batch = batch.persist()  # a total a day and region; every action on it would read the batch's files again
        half = batch.withColumn("demand", F.col("demand") + 1).where(F.pmod(F.xxhash64("period", "region"), F.lit(2)) == 0)
        X.stage_batch(half, batch_id, f"{path}/series")  # what a lost attempt may leave
        merge(batch, batch_id)
        merge(batch.withColumn("demand", F.lit(-1)), batch_id)  # a replay after the commit
        batch.unpersist()
        if batch_id == 1:
            X.compact(spark, f"{path}/series")

    X.run_available(X.daily_counts(trips), f"{path}/checkpoint", output_mode="update", foreach_batch=crashing)
    return X.read_merged(spark, f"{path}/series")


# ====================================================================== Q5, Q9, Q10, P9, Q14-Q17 in full
_EVENT_COLUMNS = "event_id, ts, user_id, event_type, value, props"


def _events_twice(spark, sf_dir):
    """Events of a feed that delivered its purchases twice and its views three times."""
    e = T.table(spark, sf_dir, "events")
    times = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "view", 3).otherwise(1)
    return e.withColumn("again", F.explode(F.sequence(F.lit(1), times))).drop("again")


SQL_EVENTS_TWICE = """
  twice AS (SELECT e.* FROM events e, range(3) t(k)
            WHERE k < CASE WHEN event_type = 'purchase' THEN 2 WHEN event_type = 'view' THEN 3 ELSE 1 END)"""


@register("count_duplicate_rows", f"WITH {SQL_EVENTS_TWICE}" + f"""
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_count
FROM (SELECT count(*) AS n FROM twice GROUP BY {_EVENT_COLUMNS})""")
def count_duplicate_rows_q(spark, sf_dir):
    """Q5 over whole event rows."""
    return Q.count_duplicates(_events_twice(spark, sf_dir))


def _tagged(spark, sf_dir):
    """Repeated events as trips of month files: every seventh event lies in the next month's file."""
    e = _events_twice(spark, sf_dir)
    own = F.trunc(F.col("ts").cast("date"), "MM")
    return e.select(F.col("ts").alias("pickup_datetime"), "user_id", "event_type", F.col("value").alias("tips"), "props",
                    F.add_months(own, F.when(F.col("user_id") % 7 == 0, 1).otherwise(0)).alias("stated_month"))


SQL_TAGGED = SQL_EVENTS_TWICE + """,
  tagged AS (SELECT ts AS pickup_datetime, user_id, event_type, value AS tips, props,
                    (date_trunc('month', ts) + CASE WHEN user_id % 7 = 0 THEN INTERVAL 1 MONTH ELSE INTERVAL 0 MONTH END)::DATE AS stated_month,
                    date_trunc('month', ts)::DATE AS month FROM twice),
  g AS (SELECT pickup_datetime, user_id, event_type, tips, props, stated_month, count(*) AS n,
               any_value(month) <> stated_month AS late, coalesce(tips < 0, false) AS neg, props IS NULL AS nul
        FROM tagged GROUP BY pickup_datetime, user_id, event_type, tips, props, stated_month)"""
_CHECKS = dict(stated_month=None, check_duplicates=True, null_columns=["props"], month_col="stated_month")


@register("apply_validity_rules_files", f"WITH {SQL_TAGGED}" + """
SELECT pickup_datetime, user_id, event_type, tips, props, stated_month FROM g
WHERE NOT coalesce(late, false) AND NOT neg AND NOT nul""")
def apply_validity_rules_files_q(spark, sf_dir):
    """Q14-Q17 over several files at once: a copy counts within its file."""
    return Q.apply_validity_rules(_tagged(spark, sf_dir), **_CHECKS)[0]


@register("handling_log_files", f"WITH {SQL_TAGGED}" + """
SELECT sum(n)::BIGINT - count(*) FILTER (WHERE NOT coalesce(late, false) AND NOT neg AND NOT nul) AS total_invalid_handled,
       coalesce(sum(n) FILTER (WHERE late), 0)::BIGINT AS outside_month,
       coalesce(sum(n) FILTER (WHERE neg), 0)::BIGINT AS negative_tips,
       coalesce(sum(n) FILTER (WHERE nul), 0)::BIGINT AS null_props,
       sum(n - 1)::BIGINT AS duplicate, sum(n)::BIGINT AS input_row_count,
       count(*) FILTER (WHERE NOT coalesce(late, false) AND NOT neg AND NOT nul) AS output_row_count
FROM g""")
def handling_log_files_q(spark, sf_dir):
    """Q15-Q17: the log of the same run; it agrees with the clean rows."""
    log = Q.handling_log(_tagged(spark, sf_dir), **_CHECKS)
    of = lambda t: F.coalesce(F.col("counts_by_type")[t], F.lit(0)).cast("long")
    return log.select("total_invalid_handled", of(Q.OUTSIDE_MONTH).alias("outside_month"),
                      of("negative_tips").alias("negative_tips"), of("null_props").alias("null_props"),
                      of("duplicate").alias("duplicate"), "input_row_count", "output_row_count")


_ORDER_JSON = """('{"row_id":' || o_orderkey || ',"pickup_datetime":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g')
  || '","PULocationID":' || o_custkey || ',"base_passenger_fare":' || o_totalprice || '}')"""


@register("validation_report_full", f"""WITH
  modal AS (SELECT date_trunc('month', o_orderdate)::DATE AS m FROM orders WHERE o_orderdate IS NOT NULL
            GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
  one AS (SELECT count(*) AS n, count(*) FILTER (WHERE date_trunc('month', o_orderdate) <> m) AS out_n,
                 arg_min({_ORDER_JSON}, o_orderkey) FILTER (WHERE date_trunc('month', o_orderdate) <> m) AS out_x,
                 min(o_orderdate) AS lo, max(o_orderdate) AS hi,
                 [count(*) FILTER (WHERE o_orderkey IS NULL), count(*) FILTER (WHERE o_orderdate IS NULL),
                  count(*) FILTER (WHERE o_custkey IS NULL), count(*) FILTER (WHERE o_totalprice IS NULL OR isnan(o_totalprice))] AS nul
          FROM orders, modal),
  cols AS (SELECT * FROM (VALUES (0, 'row_id', 'bigint'), (1, 'pickup_datetime', 'timestamp_ntz'),
                                 (2, 'PULocationID', 'bigint'), (3, 'base_passenger_fare', 'double')) c(ordinal, key, dtype))
SELECT 'schema' AS section, ordinal, key, 'dtype' AS metric, n::DOUBLE AS value, dtype AS text FROM cols, one
UNION ALL SELECT 'nulls', ordinal, key, 'null_count', nul[ordinal + 1]::DOUBLE, NULL FROM cols, one
UNION ALL SELECT 'nulls', ordinal, key, 'null_pct', round(100.0 * nul[ordinal + 1] / n, 6), NULL FROM cols, one
UNION ALL SELECT 'date_range', 0, 'pickup_datetime', 'min', NULL, lo::VARCHAR FROM one
UNION ALL SELECT 'date_range', 1, 'pickup_datetime', 'max', NULL, hi::VARCHAR FROM one
UNION ALL SELECT 'duplicates', 0, 'all_columns', 'duplicate_count', (SELECT sum(c - 1) FROM (
  SELECT count(*) AS c FROM orders GROUP BY o_orderkey, o_orderdate, o_custkey, o_totalprice))::DOUBLE, NULL
UNION ALL SELECT 'violations', 0, 'pickup_outside_stated_month', 'count', out_n::DOUBLE, out_x FROM one WHERE out_n > 0""")
def validation_report_full_q(spark, sf_dir):
    """Q10 whole: schema rows, nulls, range, duplicates, violations with their examples."""
    return r6(Q.validation_report(T.trips_orders(spark, sf_dir), order_key="row_id"), "value")


@register("stage_audit_samples", f"""
SELECT 0 AS ordinal, 'raw' AS stage, count(*) AS rows,
       (SELECT list(x ORDER BY k) FROM (SELECT {_ORDER_JSON} AS x, o_orderkey AS k FROM orders ORDER BY o_orderkey LIMIT 5)) AS sample FROM orders
UNION ALL SELECT 1, 'clean', count(*) FILTER (WHERE NOT coalesce(o_totalprice < 0, false)),
       (SELECT list(x ORDER BY k) FROM (SELECT {_ORDER_JSON} AS x, o_orderkey AS k FROM orders
        WHERE NOT coalesce(o_totalprice < 0, false) ORDER BY o_orderkey LIMIT 5)) FROM orders""")
def stage_audit_samples_q(spark, sf_dir):
    """P9 with the samples: the raw and the clean stage of the flagship, one pass each."""
    from tripcast.operators.prepare import stage_audit
    trips = T.trips_orders(spark, sf_dir)
    return stage_audit([("raw", trips), ("clean", Q.apply_validity_rules(trips, stated_month=None)[0])])


# ====================================================================== S6, S8-S10, Q3
@register("read_zone_lookup", """
SELECT c.c_custkey AS LocationID, r.r_name AS Borough
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
UNION ALL SELECT NULL, r_name FROM region""")
def read_zone_lookup_q(spark, sf_dir):
    """The customers' zones as a CSV with a further column and ids that are no numbers."""
    from tripcast.sources.files import read_zone_lookup
    path = scratch_path(spark, f"zones-{uuid.uuid4().hex}")
    rows = T.zone_lookup_customers(spark, sf_dir).select(F.col("LocationID").cast("string").alias("LocationID"), "Borough")
    bad = T.region_names(spark, sf_dir).select(F.concat(F.lit("zone "), F.col("region")).alias("LocationID"), F.col("region").alias("Borough"))
    rows.unionByName(bad).withColumn("service_zone", F.lit("x")).write.option("header", True).csv(path)
    return read_zone_lookup(spark, path)


@register("read_series_files", """
SELECT CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS period, o_orderpriority AS region, count(*) AS demand
FROM orders WHERE o_orderdate IS NOT NULL GROUP BY ALL""")
def read_series_files_q(spark, sf_dir):
    """A series written as CSV and found behind a missing and a wrong candidate."""
    from tripcast.sources.files import read_first_series, write_series
    base = scratch_path(spark, f"series-{uuid.uuid4().hex}")
    day = F.col("o_orderdate").cast("date").cast("timestamp_ntz")
    series = T.table(spark, sf_dir, "orders").where("o_orderdate IS NOT NULL").groupBy(
        day.alias("period"), F.col("o_orderpriority").alias("region")).agg(F.count(F.lit(1)).alias("demand"))
    write_series(series.select("period", "region"), f"{base}/wrong")
    series.write.option("header", True).csv(f"{base}/series.csv")
    return read_first_series(spark, [f"{base}/missing", f"{base}/wrong", f"{base}/series.csv"])


@register("with_pickup", """
SELECT o_orderkey AS row_id, o_orderdate AS pickup_datetime FROM orders""")
def with_pickup_q(spark, sf_dir):
    """Q3: trips of a feed that names its pickup column otherwise, and in capitals."""
    o = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderdate").alias("TPEP_Pickup_DateTime"))
    return Q.with_pickup(o)
