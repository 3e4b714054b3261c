"""Registered queries over the driver's tables.

Each entry maps a name to ``(builder(spark, sf_dir) -> DataFrame, oracle SQL or
None)``.  The SQL runs on DuckDB over the same parquet tables; doubles are
rounded to 6 places on both sides.  Every query reads whole tables.
"""

from __future__ import annotations

from collections import OrderedDict
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripcast.functions.columns import round6
from tripcast.operators import prepare as P
from tripcast.operators import quality as Q
from tripcast.params import TEST_SCOPE
from tripcast.session import materialize
from tripcast.sources import tables as T

REGISTRY: "OrderedDict[str, tuple]" = OrderedDict()
SCOPE = TEST_SCOPE
W_START, W_END = SCOPE.window_start.isoformat(), SCOPE.window_end.isoformat()


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def r6(df: DataFrame, *cols: str) -> DataFrame:
    """Round the named double columns to 6 places (oracle hygiene)."""
    return df.select(*[round6(c).alias(c) if c in cols else F.col(c) for c in df.columns])


# ------------------------------------------------------------------ shared SQL
SQL_LOOKUP = """
  lookup AS (
    SELECT c.c_custkey AS LocationID, min(r.r_name) AS Borough
    FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
                    JOIN region r ON n.n_regionkey = r.r_regionkey
    GROUP BY c.c_custkey)"""
SQL_TRIPS = """
  trips AS (
    SELECT o_orderkey AS row_id, o_orderdate AS pickup_datetime,
           o_custkey AS PULocationID, o_totalprice AS base_passenger_fare
    FROM orders)"""
SQL_COUNTED = """
  counted AS (
    SELECT CAST(CAST(t.pickup_datetime AS DATE) AS TIMESTAMP) AS period,
           l.Borough AS region, CAST(count(*) AS BIGINT) AS demand
    FROM trips t JOIN lookup l ON t.PULocationID = l.LocationID
    WHERE NOT coalesce(t.base_passenger_fare < 0, false)
      AND t.pickup_datetime IS NOT NULL
    GROUP BY 1, 2)"""
SQL_GRID = f"""
  grid AS (
    SELECT CAST(d AS TIMESTAMP) AS period, r_name AS region
    FROM region CROSS JOIN generate_series(TIMESTAMP '{W_START}', TIMESTAMP '{W_END}',
                                           INTERVAL 1 DAY) AS t(d))"""
SQL_FILLED = """
  filled AS (
    SELECT g.period, g.region, CAST(coalesce(c.demand, 0) AS BIGINT) AS demand
    FROM grid g LEFT JOIN counted c ON g.period = c.period AND g.region = c.region)"""
SQL_SERIES = """
  series AS (
    SELECT period, region, demand,
           CAST(lag(demand, 1) OVER w AS DOUBLE) AS lag_1,
           CAST(lag(demand, 7) OVER w AS DOUBLE) AS lag_7,
           CAST(lag(demand, 14) OVER w AS DOUBLE) AS lag_14
    FROM filled WINDOW w AS (PARTITION BY region ORDER BY period))"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


# ------------------------------------------------------------------ flagship
def demand_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips (orders) -> clean -> zone map -> daily count -> zero-fill -> lags."""
    trips = T.trips_orders(spark, sf_dir)
    lookup = T.zone_lookup_customers(spark, sf_dir)
    series, _, _ = P.prepare(trips, lookup, SCOPE, regions=T.region_names(spark, sf_dir),
                             stated_month=None)
    return series


register("demand_series", _with(SQL_LOOKUP, SQL_TRIPS, SQL_COUNTED, SQL_GRID, SQL_FILLED,
                                SQL_SERIES) + "SELECT * FROM series")(demand_series)


def series_ckpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship series materialised once (reliable checkpoint into
    ``spark.checkpoint.dir``).  Analyses that take several passes or driver
    parameters over the series then read KBs instead of re-running the scan,
    clean, join and count over the raw tables each time."""
    return materialize(demand_series(spark, sf_dir))


# ====================================================================== sources
@register("read_trips", """
SELECT o_orderdate AS pickup_datetime, o_custkey AS PULocationID FROM orders""")
def read_trips_q(spark, sf_dir):
    """Pruned scan - only the pickup time and location reach the reader."""
    return T.trips_orders(spark, sf_dir).select("pickup_datetime", "PULocationID")


@register("derive_zone_lookup", """
SELECT DISTINCT o_custkey AS LocationID, 'Region-' || CAST(o_custkey AS VARCHAR) AS Borough
FROM orders WHERE o_custkey IS NOT NULL""")
def derive_zone_lookup_q(spark, sf_dir):
    from tripcast.sources.files import derive_zone_lookup
    return derive_zone_lookup(T.trips_orders(spark, sf_dir))


@register("assert_months_complete", """
WITH months AS (
  SELECT CAST(m AS DATE) AS month
  FROM generate_series(TIMESTAMP '2001-01-01', TIMESTAMP '2001-12-01', INTERVAL 1 MONTH) t(m)),
present AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders)
SELECT month FROM months WHERE month NOT IN (SELECT month FROM present)""")
def assert_months_complete_q(spark, sf_dir):
    """S12 over the 2001 window, where the orders stop in August."""
    from tripcast.sources.files import missing_months
    scope = SCOPE.with_changes(window_start=date(2001, 1, 1), window_end=date(2001, 12, 31))
    present = T.trips_orders(spark, sf_dir).select(
        F.trunc(F.col("pickup_datetime").cast("date"), "MM").alias("month"))
    return missing_months(present, scope)


# ====================================================================== quality
def _events_cols():
    return ["event_id", "ts", "user_id", "event_type", "value", "props"]


def _nulls_sql():
    parts = []
    for i, c in enumerate(_events_cols()):
        pred = f"{c} IS NULL OR isnan({c})" if c == "value" else f"{c} IS NULL"
        parts.append(f"SELECT {i} AS ordinal, '{c}' AS \"column\", "
                     f"CAST(count(*) FILTER (WHERE {pred}) AS BIGINT) AS null_count, "
                     f"round(coalesce(100.0 * count(*) FILTER (WHERE {pred}) / nullif(count(*), 0), 0.0), 6) AS null_pct FROM events")
    return "\nUNION ALL\n".join(parts)


@register("profile_nulls", _nulls_sql())
def profile_nulls_q(spark, sf_dir):
    return r6(Q.profile_nulls(T.table(spark, sf_dir, "events")), "null_pct")


@register("profile_schema", """
SELECT 0 AS ordinal, 'event_id' AS "column", CASE typeof(any_value(event_id)) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DATE' THEN 'date' ELSE lower(typeof(any_value(event_id))) END AS dtype, CAST(count(*) AS BIGINT) AS row_count FROM events
UNION ALL
SELECT 1 AS ordinal, 'ts' AS "column", CASE typeof(any_value(ts)) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DATE' THEN 'date' ELSE lower(typeof(any_value(ts))) END AS dtype, CAST(count(*) AS BIGINT) AS row_count FROM events
UNION ALL
SELECT 2 AS ordinal, 'user_id' AS "column", CASE typeof(any_value(user_id)) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DATE' THEN 'date' ELSE lower(typeof(any_value(user_id))) END AS dtype, CAST(count(*) AS BIGINT) AS row_count FROM events
UNION ALL
SELECT 3 AS ordinal, 'event_type' AS "column", CASE typeof(any_value(event_type)) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DATE' THEN 'date' ELSE lower(typeof(any_value(event_type))) END AS dtype, CAST(count(*) AS BIGINT) AS row_count FROM events
UNION ALL
SELECT 4 AS ordinal, 'value' AS "column", CASE typeof(any_value(value)) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DATE' THEN 'date' ELSE lower(typeof(any_value(value))) END AS dtype, CAST(count(*) AS BIGINT) AS row_count FROM events
UNION ALL
SELECT 5 AS ordinal, 'props' AS "column", CASE typeof(any_value(props)) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DATE' THEN 'date' ELSE lower(typeof(any_value(props))) END AS dtype, CAST(count(*) AS BIGINT) AS row_count FROM events""")
def profile_schema_q(spark, sf_dir):
    return Q.profile_schema(T.table(spark, sf_dir, "events"))


@register("date_range", """
SELECT min(o_orderdate) AS min_pickup, max(o_orderdate) AS max_pickup,
       date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS span_days
FROM orders""")
def date_range_q(spark, sf_dir):
    return Q.date_range(T.trips_orders(spark, sf_dir))


@register("count_duplicates", """
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_count
FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type)""")
def count_duplicates_q(spark, sf_dir):
    return Q.count_duplicates(T.table(spark, sf_dir, "events").select("user_id", "event_type"))


SQL_MODAL = """
  modal AS (
    SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS stated_month, count(*) AS n
    FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1)"""


@register("infer_stated_month", _with(SQL_MODAL) + "SELECT stated_month, n FROM modal")
def infer_stated_month_q(spark, sf_dir):
    return Q.modal_month(T.trips_orders(spark, sf_dir))


@register("flag_outside_month", _with(SQL_MODAL) + """
SELECT 0 AS ordinal, 'pickup_outside_stated_month' AS violation_type,
       CAST(count(*) AS BIGINT) AS count, CAST(min(o_orderkey) AS VARCHAR) AS example_key
FROM orders, modal
WHERE o_orderdate IS NOT NULL
  AND CAST(date_trunc('month', o_orderdate) AS DATE) <> modal.stated_month
HAVING count(*) >= 1""")
def flag_outside_month_q(spark, sf_dir):
    """Q7 + Q9: orders outside the modal (stated) month, first offender by key."""
    v = Q.flag_domain_violations(T.trips_orders(spark, sf_dir), order_key="row_id")
    return v.select("ordinal", "violation_type", "count", "example_key")


@register("flag_negative", """
SELECT 0 AS ordinal, 'negative_driver_pay' AS violation_type, CAST(count(*) AS BIGINT) AS count,
       CAST(arg_min(c_custkey, c_custkey) AS VARCHAR) AS example_key,
       arg_min(c_acctbal, c_custkey) AS example_value
FROM customer WHERE c_acctbal < 0 HAVING count(*) >= 1""")
def flag_negative_q(spark, sf_dir):
    """Q8 + Q9: negative account balances read as a non-negative measure."""
    c = T.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("row_id"), F.col("c_acctbal").alias("driver_pay"),
        "c_mktsegment")
    v = Q.flag_domain_violations(c, order_key="row_id")
    return v.select("ordinal", "violation_type", "count", "example_key",
                    F.get_json_object("example", "$.driver_pay").cast("double").alias("example_value"))


SQL_VALIDATION_REPORT = """WITH
  modal AS (
    SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS stated_month, count(*) AS n
    FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1)
SELECT 'nulls' AS section, 0 AS ordinal, 'row_id' AS key, 'null_count' AS metric, round(CAST(count(*) FILTER (WHERE o_orderkey IS NULL) AS DOUBLE), 6) AS value, CAST(NULL AS VARCHAR) AS text FROM orders
UNION ALL
SELECT 'nulls', 0, 'row_id', 'null_pct', round(coalesce(100.0 * count(*) FILTER (WHERE o_orderkey IS NULL) / nullif(count(*), 0), 0.0), 6), NULL FROM orders
UNION ALL
SELECT 'nulls' AS section, 1 AS ordinal, 'pickup_datetime' AS key, 'null_count' AS metric, round(CAST(count(*) FILTER (WHERE o_orderdate IS NULL) AS DOUBLE), 6) AS value, CAST(NULL AS VARCHAR) AS text FROM orders
UNION ALL
SELECT 'nulls', 1, 'pickup_datetime', 'null_pct', round(coalesce(100.0 * count(*) FILTER (WHERE o_orderdate IS NULL) / nullif(count(*), 0), 0.0), 6), NULL FROM orders
UNION ALL
SELECT 'nulls' AS section, 2 AS ordinal, 'PULocationID' AS key, 'null_count' AS metric, round(CAST(count(*) FILTER (WHERE o_custkey IS NULL) AS DOUBLE), 6) AS value, CAST(NULL AS VARCHAR) AS text FROM orders
UNION ALL
SELECT 'nulls', 2, 'PULocationID', 'null_pct', round(coalesce(100.0 * count(*) FILTER (WHERE o_custkey IS NULL) / nullif(count(*), 0), 0.0), 6), NULL FROM orders
UNION ALL
SELECT 'nulls' AS section, 3 AS ordinal, 'base_passenger_fare' AS key, 'null_count' AS metric, round(CAST(count(*) FILTER (WHERE o_totalprice IS NULL OR isnan(o_totalprice)) AS DOUBLE), 6) AS value, CAST(NULL AS VARCHAR) AS text FROM orders
UNION ALL
SELECT 'nulls', 3, 'base_passenger_fare', 'null_pct', round(coalesce(100.0 * count(*) FILTER (WHERE o_totalprice IS NULL OR isnan(o_totalprice)) / nullif(count(*), 0), 0.0), 6), NULL FROM orders
UNION ALL
SELECT 'date_range', 0, 'pickup_datetime', 'min', NULL, CAST(min(o_orderdate) AS VARCHAR) FROM orders
UNION ALL
SELECT 'date_range', 1, 'pickup_datetime', 'max', NULL, CAST(max(o_orderdate) AS VARCHAR) FROM orders
UNION ALL
SELECT 'duplicates', 0, 'all_columns', 'duplicate_count', round(CAST(coalesce(sum(n - 1), 0) AS DOUBLE), 6), NULL FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey, o_orderdate, o_custkey, o_totalprice)
UNION ALL
SELECT 'violations', 0, 'pickup_outside_stated_month', 'count', round(CAST(count(*) AS DOUBLE), 6), NULL FROM orders, modal WHERE o_orderdate IS NOT NULL AND CAST(date_trunc('month', o_orderdate) AS DATE) <> modal.stated_month HAVING count(*) >= 1
UNION ALL
SELECT 'violations', 1, 'negative_base_passenger_fare', 'count', round(CAST(count(*) AS DOUBLE), 6), NULL FROM orders WHERE o_totalprice < 0 HAVING count(*) >= 1"""


@register("validation_report", SQL_VALIDATION_REPORT)
def validation_report_q(spark, sf_dir):
    """Q10 over the orders trips (schema rows carry Spark type names, so they
    are left to the unit tests); the example JSON stays out of the check."""
    rep = Q.validation_report(T.trips_orders(spark, sf_dir), order_key="row_id")
    return r6(rep.where("section <> 'schema'").select(
        "section", "ordinal", "key", "metric", "value",
        F.when(F.col("section") == "date_range", F.col("text")).alias("text")), "value")


@register("validation_report_by_file", """
WITH t AS (
  SELECT 'orders_' || CAST(year(o_orderdate) AS VARCHAR) AS file, o_orderdate AS ts,
         o_totalprice AS fare, CAST(date_trunc('month', o_orderdate) AS DATE) AS m
  FROM orders),
bym AS (SELECT file, m, count(*) AS n FROM t WHERE m IS NOT NULL GROUP BY 1, 2),
modal AS (SELECT file, m AS stated FROM (
  SELECT file, m, row_number() OVER (PARTITION BY file ORDER BY n DESC, m) AS rk FROM bym) WHERE rk = 1),
dups AS (SELECT file, sum(n - 1) AS d FROM (
  SELECT file, count(*) AS n FROM (SELECT 'orders_' || CAST(year(o_orderdate) AS VARCHAR) AS file, * FROM orders)
  GROUP BY file, o_orderkey, o_orderdate, o_custkey, o_totalprice) GROUP BY file),
wide AS (
  SELECT t.file, CAST(count(*) AS DOUBLE) AS rows,
         CAST(epoch(min(ts)) AS DOUBLE) AS min_pickup, CAST(epoch(max(ts)) AS DOUBLE) AS max_pickup,
         CAST(count(*) FILTER (WHERE t.m IS NOT NULL AND t.m <> modal.stated) AS DOUBLE) AS outside,
         CAST(count(*) FILTER (WHERE fare < 0) AS DOUBLE) AS neg
  FROM t LEFT JOIN modal ON t.file = modal.file GROUP BY t.file)
SELECT * FROM (
  SELECT w.file, 0 AS ordinal, 'rows' AS metric, rows AS value FROM wide w
  UNION ALL SELECT w.file, 1, 'duplicate_count', CAST(coalesce(d.d, 0) AS DOUBLE) FROM wide w LEFT JOIN dups d ON w.file = d.file
  UNION ALL SELECT file, 2, 'min_pickup', min_pickup FROM wide
  UNION ALL SELECT file, 3, 'max_pickup', max_pickup FROM wide
  UNION ALL SELECT file, 4, 'pickup_outside_stated_month', outside FROM wide
  UNION ALL SELECT file, 5, 'negative_base_passenger_fare', neg FROM wide)
WHERE NOT (ordinal >= 4 AND value = 0)""")
def validation_report_by_file_q(spark, sf_dir):
    """Q11: one report per yearly 'file' of orders, modal month per file."""
    t = T.trips_orders(spark, sf_dir).select(
        F.concat(F.lit("orders_"), F.year("pickup_datetime").cast("string")).alias("file"),
        "row_id", "pickup_datetime", "PULocationID", "base_passenger_fare")
    return r6(Q.validation_report_by_file(t, "file"), "value")


@register("check_contract", """
WITH a AS (
  SELECT count(*) FILTER (WHERE o_totalprice IS NOT NULL AND o_totalprice <> round(o_totalprice)) AS bf,
         count(*) FILTER (WHERE o_totalprice < 0) AS bg
  FROM orders)
SELECT (bf = 0 AND bg = 0) AS ok,
       CASE WHEN bf > 0 THEN 'Column ''demand'' must contain whole-number trip counts but has fractional values.'
            WHEN bg > 0 THEN 'Column ''demand'' must be non-negative (>= 0) but has negative values.' END AS error,
       CASE WHEN bf > 0 OR bg > 0 THEN 'demand' END AS offending_column
FROM a""")
def check_contract_q(spark, sf_dir):
    """Q12 on orders read as (period, region, demand=total price): fractional."""
    o = T.table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").alias("period"), F.col("o_orderpriority").alias("region"),
        F.col("o_totalprice").alias("demand"))
    return Q.check_contract(o)


@register("check_contract_series", _with(SQL_LOOKUP, SQL_TRIPS, SQL_COUNTED, SQL_GRID, SQL_FILLED) + """
SELECT count(*) FILTER (WHERE demand < 0) = 0 AS ok, CAST(NULL AS VARCHAR) AS error,
       CAST(NULL AS VARCHAR) AS offending_column FROM filled""")
def check_contract_series_q(spark, sf_dir):
    """Q12 on the prepared series: conforms."""
    return Q.check_contract(demand_series(spark, sf_dir))


SQL_CLEAN_ORDERS = _with(SQL_MODAL) + """, clean AS (
  SELECT o_orderkey AS row_id, o_orderdate AS pickup_datetime, o_custkey AS PULocationID,
         o_totalprice AS base_passenger_fare
  FROM orders, modal
  WHERE NOT coalesce(o_orderdate IS NOT NULL AND CAST(date_trunc('month', o_orderdate) AS DATE) <> modal.stated_month, false)
    AND NOT coalesce(o_totalprice < 0, false))
"""


@register("apply_validity_rules", SQL_CLEAN_ORDERS + "SELECT * FROM clean")
def apply_validity_rules_q(spark, sf_dir):
    """Q14: drop rule with the inferred stated month (the reference default)."""
    return Q.apply_validity_rules(T.trips_orders(spark, sf_dir))[0]


@register("handling_log", _with(SQL_MODAL) + """
SELECT 'drop' AS rule, CAST(count(*) FILTER (WHERE bad) AS BIGINT) AS total_invalid_handled,
       CAST(count(*) FILTER (WHERE outside) AS BIGINT) AS outside_month,
       CAST(count(*) FILTER (WHERE neg) AS BIGINT) AS negative_fare,
       CAST(count(*) AS BIGINT) AS input_row_count,
       CAST(count(*) FILTER (WHERE NOT bad) AS BIGINT) AS output_row_count
FROM (SELECT *, outside OR neg AS bad FROM (
  SELECT coalesce(o_orderdate IS NOT NULL AND CAST(date_trunc('month', o_orderdate) AS DATE) <> modal.stated_month, false) AS outside,
         coalesce(o_totalprice < 0, false) AS neg
  FROM orders, modal))""")
def handling_log_q(spark, sf_dir):
    """Q15: the log of the Q14 run."""
    log = Q.apply_validity_rules(T.trips_orders(spark, sf_dir))[1]
    return log.select("rule", "total_invalid_handled",
                      F.coalesce(F.col("counts_by_type")["pickup_outside_stated_month"], F.lit(0))
                      .cast("long").alias("outside_month"),
                      F.coalesce(F.col("counts_by_type")["negative_base_passenger_fare"], F.lit(0))
                      .cast("long").alias("negative_fare"),
                      "input_row_count", "output_row_count")


SQL_EVENT_TRIPS = """
  et AS (
    SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS pickup_datetime, user_id AS PULocationID,
           event_type AS region, CAST(CASE WHEN event_type = 'purchase' THEN -1.0 ELSE 0.0 END AS DOUBLE) AS tips
    FROM events)"""


def _event_trips(spark, sf_dir):
    """Events as day-level trips per user; a purchase carries a tip of -1
    (a refund marker) so the negative-measure rule has work to do."""
    e = T.table(spark, sf_dir, "events")
    return e.select(F.col("ts").cast("date").cast("timestamp_ntz").alias("pickup_datetime"),
                    F.col("user_id").alias("PULocationID"), F.col("event_type").alias("region"),
                    F.when(F.col("event_type") == "purchase", F.lit(-1.0))
                     .otherwise(F.lit(0.0)).alias("tips"))


@register("apply_validity_rules_dedup", _with(SQL_EVENT_TRIPS) + """
SELECT DISTINCT * FROM et WHERE NOT coalesce(tips < 0, false) AND region IS NOT NULL""")
def apply_validity_rules_dedup_q(spark, sf_dir):
    """Q14 + Q16 + Q17: later copies and NULL regions are invalid too."""
    return Q.apply_validity_rules(_event_trips(spark, sf_dir), stated_month=None,
                                  check_duplicates=True, null_columns=["region"])[0]


@register("handling_log_dedup", _with(SQL_EVENT_TRIPS) + """
, g AS (SELECT count(*) AS n, bool_or(NOT coalesce(tips < 0, false) AND region IS NOT NULL) AS ok,
               bool_or(coalesce(tips < 0, false)) AS neg, bool_or(region IS NULL) AS nul
        FROM et GROUP BY pickup_datetime, PULocationID, region, tips)
SELECT CAST(sum(n) - count(*) FILTER (WHERE ok) AS BIGINT) AS total_invalid_handled,
       CAST(coalesce(sum(n) FILTER (WHERE neg), 0) AS BIGINT) AS negative_tips,
       CAST(sum(n - 1) AS BIGINT) AS duplicate,
       CAST(sum(n) AS BIGINT) AS input_row_count,
       CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS output_row_count
FROM (SELECT * FROM g)""")
def handling_log_dedup_q(spark, sf_dir):
    log = Q.apply_validity_rules(_event_trips(spark, sf_dir), stated_month=None,
                                 check_duplicates=True, null_columns=["region"])[1]
    m = F.col("counts_by_type")
    return log.select("total_invalid_handled",
                      F.coalesce(m["negative_tips"], F.lit(0)).cast("long").alias("negative_tips"),
                      F.coalesce(m["duplicate"], F.lit(0)).cast("long").alias("duplicate"),
                      "input_row_count", "output_row_count")


SQL_IN_WINDOW = f"""
  in_window AS (
    SELECT count(*) AS n FROM trips t JOIN lookup l ON t.PULocationID = l.LocationID
    WHERE NOT coalesce(t.base_passenger_fare < 0, false)
      AND CAST(t.pickup_datetime AS DATE) BETWEEN DATE '{W_START}' AND DATE '{W_END}')"""


@register("reconcile", _with(SQL_LOOKUP, SQL_TRIPS, SQL_COUNTED, SQL_GRID, SQL_FILLED, SQL_IN_WINDOW) + """
SELECT CAST(sum(demand) AS BIGINT) AS total_demand, CAST(max(n) AS BIGINT) AS raw_valid_count,
       CAST(sum(demand) - max(n) AS BIGINT) AS difference, sum(demand) = max(n) AS reconciled
FROM filled, in_window""")
def reconcile_q(spark, sf_dir):
    """Q18: series total vs the valid trips that have a region inside the window (T5)."""
    from tripcast.operators.prepare import map_zones_to_regions
    trips = T.trips_orders(spark, sf_dir)
    clean, _ = Q.apply_validity_rules(trips, stated_month=None)
    mapped = map_zones_to_regions(clean, T.zone_lookup_customers(spark, sf_dir))
    d = F.col("pickup_datetime").cast("date")
    usable = mapped.where(F.col("region").isNotNull() &
                          d.between(F.lit(SCOPE.window_start), F.lit(SCOPE.window_end)))
    return Q.reconcile(demand_series(spark, sf_dir), usable)


@register("reconcile_partials", _with(SQL_LOOKUP, SQL_TRIPS, SQL_COUNTED, SQL_GRID, SQL_FILLED) + f"""
SELECT CAST((SELECT sum(demand) FROM counted WHERE CAST(period AS DATE) BETWEEN DATE '{W_START}' AND DATE '{W_END}') AS BIGINT) AS partials_total,
       CAST((SELECT sum(demand) FROM filled) AS BIGINT) AS series_total,
       CAST((SELECT sum(demand) FROM filled) - (SELECT sum(demand) FROM counted WHERE CAST(period AS DATE) BETWEEN DATE '{W_START}' AND DATE '{W_END}') AS BIGINT) AS difference,
       (SELECT sum(demand) FROM filled) = (SELECT sum(demand) FROM counted WHERE CAST(period AS DATE) BETWEEN DATE '{W_START}' AND DATE '{W_END}') AS reconciled""")
def reconcile_partials_q(spark, sf_dir):
    """Q19: per-month partial counts (independent plan) vs the prepared series."""
    from tripcast.operators.prepare import aggregate_demand_by_zone
    clean, _ = Q.apply_validity_rules(T.trips_orders(spark, sf_dir), stated_month=None)
    counted = aggregate_demand_by_zone(clean, T.zone_lookup_customers(spark, sf_dir), SCOPE)
    partials = counted.where(F.col("period").cast("date").between(
        F.lit(SCOPE.window_start), F.lit(SCOPE.window_end)))
    return Q.reconcile_partials(partials, demand_series(spark, sf_dir))


@register("check_grid", _with(SQL_LOOKUP, SQL_TRIPS, SQL_COUNTED, SQL_GRID, SQL_FILLED) + """
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT period) AS BIGINT) AS periods,
       CAST(count(DISTINCT region) AS BIGINT) AS regions,
       CAST(count(DISTINCT (period, region)) AS BIGINT) AS distinct_keys,
       CAST(min(demand) AS BIGINT) AS min_demand,
       count(*) = count(DISTINCT period) * count(DISTINCT region)
         AND count(DISTINCT (period, region)) = count(*) AND min(demand) >= 0 AS complete
FROM filled""")
def check_grid_q(spark, sf_dir):
    return Q.check_grid(demand_series(spark, sf_dir))


@register("check_lags", _with(SQL_LOOKUP, SQL_TRIPS, SQL_COUNTED, SQL_GRID, SQL_FILLED, SQL_SERIES) + """
, rn AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY period) AS rn FROM series)
SELECT CAST(v.k AS INTEGER) AS lag, CAST(count(*) AS BIGINT) AS checked,
       CAST(count(*) FILTER (WHERE (CASE v.k WHEN 1 THEN a.lag_1 WHEN 7 THEN a.lag_7 ELSE a.lag_14 END)
                                   IS DISTINCT FROM CAST(b.demand AS DOUBLE)) AS BIGINT) AS mismatches
FROM (VALUES (1), (7), (14)) v(k) CROSS JOIN rn a
LEFT JOIN rn b ON a.region = b.region AND b.rn = a.rn - v.k
GROUP BY v.k""")
def check_lags_q(spark, sf_dir):
    """Q21: independent row-shift re-computation of the flagship's lags."""
    return Q.check_lags(demand_series(spark, sf_dir), SCOPE.lags)


# ================================================================== preparation
SQL_LOOKUP_NO_ASIA = """
  lookup AS (
    SELECT c.c_custkey AS LocationID, min(r.r_name) AS Borough
    FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
                    JOIN region r ON n.n_regionkey = r.r_regionkey
    WHERE r.r_name <> 'ASIA'
    GROUP BY c.c_custkey)"""


def _lookup_no_asia(spark, sf_dir):
    """The zone lookup with one region removed, so some trips stay unmatched."""
    return T.zone_lookup_customers(spark, sf_dir).where(F.col("Borough") != "ASIA")


@register("map_zones_to_regions", _with(SQL_LOOKUP_NO_ASIA, SQL_TRIPS) + """
SELECT t.*, l.Borough AS region FROM trips t LEFT JOIN lookup l ON t.PULocationID = l.LocationID""")
def map_zones_to_regions_q(spark, sf_dir):
    """Left join; trips of the removed region keep a NULL region."""
    return P.map_zones_to_regions(T.trips_orders(spark, sf_dir), _lookup_no_asia(spark, sf_dir))


@register("aggregate_demand", _with(SQL_LOOKUP_NO_ASIA, SQL_TRIPS) + """
SELECT CAST(CAST(t.pickup_datetime AS DATE) AS TIMESTAMP) AS period, l.Borough AS region,
       CAST(count(*) AS BIGINT) AS demand
FROM trips t JOIN lookup l ON t.PULocationID = l.LocationID
WHERE t.pickup_datetime IS NOT NULL GROUP BY 1, 2""")
def aggregate_demand_q(spark, sf_dir):
    """P2 + P3: daily trips per region; NULL regions are left out."""
    mapped = P.map_zones_to_regions(T.trips_orders(spark, sf_dir), _lookup_no_asia(spark, sf_dir))
    return P.aggregate_demand(mapped, SCOPE)


SQL_SUPPLIER_LOOKUP = """
  slookup AS (
    SELECT s.s_suppkey AS LocationID, min(r.r_name) AS Borough
    FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
                    JOIN region r ON n.n_regionkey = r.r_regionkey
    GROUP BY s.s_suppkey)"""
SQL_LINE_COUNTED = """
  lcounted AS (
    SELECT CAST(CAST(l.l_shipdate AS DATE) AS TIMESTAMP) AS period, s.Borough AS region,
           CAST(count(*) AS BIGINT) AS demand
    FROM lineitem l JOIN slookup s ON l.l_suppkey = s.LocationID
    WHERE l.l_shipdate IS NOT NULL AND NOT coalesce(l.l_extendedprice < 0, false)
      AND NOT coalesce(l.l_quantity < 0, false)
    GROUP BY 1, 2)"""
SQL_LINE_FILLED = """
  lfilled AS (
    SELECT g.period, g.region, CAST(coalesce(c.demand, 0) AS BIGINT) AS demand
    FROM grid g LEFT JOIN lcounted c ON g.period = c.period AND g.region = c.region)"""
SQL_LINE_SERIES = """
  lseries AS (
    SELECT period, region, demand,
           CAST(lag(demand, 1) OVER w AS DOUBLE) AS lag_1,
           CAST(lag(demand, 7) OVER w AS DOUBLE) AS lag_7,
           CAST(lag(demand, 14) OVER w AS DOUBLE) AS lag_14
    FROM lfilled WINDOW w AS (PARTITION BY region ORDER BY period))"""
SQL_LINE = (SQL_SUPPLIER_LOOKUP, SQL_LINE_COUNTED, SQL_GRID, SQL_LINE_FILLED, SQL_LINE_SERIES)


def line_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The denser series: line items located at their supplier's region."""
    from tripcast.plans.jobs import build_series
    return build_series(T.trips_lineitem(spark, sf_dir), T.zone_lookup_suppliers(spark, sf_dir),
                        SCOPE, regions=T.region_names(spark, sf_dir))


@register("build_series", _with(*SQL_LINE) + "SELECT * FROM lseries")
def build_series_q(spark, sf_dir):
    """Lineitem -> clean -> (fused zone map + partial/final count) -> fill -> lags."""
    return line_series(spark, sf_dir)


@register("period_region_grid", _with(SQL_GRID) + "SELECT * FROM grid")
def period_region_grid_q(spark, sf_dir):
    """P5: every day of the window for every region of the region table."""
    return P.period_region_grid(spark, SCOPE, T.region_names(spark, sf_dir))


@register("fill_missing_periods", _with(SQL_LOOKUP_NO_ASIA, SQL_TRIPS, SQL_GRID) + """
, counted AS (
    SELECT CAST(CAST(t.pickup_datetime AS DATE) AS TIMESTAMP) AS period, l.Borough AS region,
           count(*) AS demand
    FROM trips t JOIN lookup l ON t.PULocationID = l.LocationID GROUP BY 1, 2),
obs_regions AS (SELECT DISTINCT region FROM counted)
SELECT g.period, g.region, CAST(coalesce(c.demand, 0) AS BIGINT) AS demand
FROM grid g JOIN obs_regions o ON g.region = o.region
LEFT JOIN counted c ON g.period = c.period AND g.region = c.region""")
def fill_missing_periods_q(spark, sf_dir):
    """P6 with the observed regions (the removed region gets no rows)."""
    mapped = P.map_zones_to_regions(T.trips_orders(spark, sf_dir), _lookup_no_asia(spark, sf_dir))
    return P.fill_missing_periods(P.aggregate_demand(mapped, SCOPE), SCOPE)


@register("combine_partials", _with(SQL_LOOKUP, SQL_TRIPS, SQL_COUNTED, SQL_SUPPLIER_LOOKUP,
                                    SQL_LINE_COUNTED) + """
SELECT period, region, CAST(sum(demand) AS BIGINT) AS demand
FROM (SELECT * FROM counted UNION ALL SELECT * FROM lcounted) GROUP BY 1, 2""")
def combine_partials_q(spark, sf_dir):
    """Two partial count tables (orders, line items) unioned and re-summed."""
    from tripcast.operators.prepare import aggregate_demand_by_zone
    a = aggregate_demand_by_zone(Q.apply_validity_rules(T.trips_orders(spark, sf_dir), stated_month=None)[0],
                                 T.zone_lookup_customers(spark, sf_dir), SCOPE)
    b = aggregate_demand_by_zone(Q.apply_validity_rules(T.trips_lineitem(spark, sf_dir), stated_month=None)[0],
                                 T.zone_lookup_suppliers(spark, sf_dir), SCOPE)
    return P.combine_partials(a, b)


@register("prepare_modal_month", _with(SQL_LOOKUP, SQL_MODAL, SQL_GRID) + """
, clean AS (
  SELECT o_orderdate AS pickup_datetime, o_custkey AS PULocationID FROM orders, modal
  WHERE NOT coalesce(o_orderdate IS NOT NULL AND CAST(date_trunc('month', o_orderdate) AS DATE) <> modal.stated_month, false)
    AND NOT coalesce(o_totalprice < 0, false)),
counted AS (
  SELECT CAST(CAST(c.pickup_datetime AS DATE) AS TIMESTAMP) AS period, l.Borough AS region, count(*) AS demand
  FROM clean c JOIN lookup l ON c.PULocationID = l.LocationID GROUP BY 1, 2),
filled AS (
  SELECT g.period, g.region, CAST(coalesce(c.demand, 0) AS BIGINT) AS demand
  FROM grid g LEFT JOIN counted c ON g.period = c.period AND g.region = c.region)
SELECT period, region, demand,
       CAST(lag(demand, 1) OVER w AS DOUBLE) AS lag_1,
       CAST(lag(demand, 7) OVER w AS DOUBLE) AS lag_7,
       CAST(lag(demand, 14) OVER w AS DOUBLE) AS lag_14
FROM filled WINDOW w AS (PARTITION BY region ORDER BY period)""")
def prepare_modal_month_q(spark, sf_dir):
    """P8 with the reference's default month rule: the modal month survives."""
    s, _, _ = P.prepare(T.trips_orders(spark, sf_dir), T.zone_lookup_customers(spark, sf_dir),
                        SCOPE, regions=T.region_names(spark, sf_dir), stated_month="infer")
    return s


@register("stage_audit", _with(SQL_LOOKUP, SQL_TRIPS, SQL_COUNTED, SQL_GRID, SQL_FILLED) + """
SELECT 0 AS ordinal, 'raw' AS stage, CAST(count(*) AS BIGINT) AS rows FROM trips
UNION ALL SELECT 1, 'clean', CAST(count(*) AS BIGINT) FROM trips WHERE NOT coalesce(base_passenger_fare < 0, false)
UNION ALL SELECT 2, 'counted', CAST(count(*) FILTER (WHERE CAST(period AS DATE) BETWEEN DATE '{W_START}' AND DATE '{W_END}') AS BIGINT) FROM counted
UNION ALL SELECT 3, 'series', CAST(count(*) AS BIGINT) FROM filled""".format(W_START=W_START, W_END=W_END))
def stage_audit_q(spark, sf_dir):
    """Row counts per stage of the flagship (samples are checked in tests)."""
    _, _, audit = P.prepare(T.trips_orders(spark, sf_dir), T.zone_lookup_customers(spark, sf_dir),
                            SCOPE, regions=T.region_names(spark, sf_dir), stated_month=None, audit=True)
    return audit.select("ordinal", "stage", "rows")


# ================================================================ exploration
from tripcast.operators import explore as X  # noqa: E402
from tripcast.operators import features as W  # noqa: E402

SQL_TOT = """
  tot AS (SELECT period, CAST(sum(demand) AS DOUBLE) AS y FROM filled GROUP BY period)"""
SQL_TOT_CHAIN = (SQL_LOOKUP, SQL_TRIPS, SQL_COUNTED, SQL_GRID, SQL_FILLED, SQL_TOT)
REGION_NAMES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def total_series(spark, sf_dir):
    return X.total_per_period(series_ckpt(spark, sf_dir))


@register("total_per_period", _with(*SQL_TOT_CHAIN) + "SELECT * FROM tot")
def total_per_period_q(spark, sf_dir):
    """P10: total over regions per period, DOUBLE."""
    return total_series(spark, sf_dir)


def _regions(spark, sf_dir):
    return sorted(r[0] for r in T.region_names(spark, sf_dir).collect())  # 5-row dimension


@register("pivot_regions", _with(*SQL_TOT_CHAIN[:-1]) + "SELECT period, " + ", ".join(
    f"CAST(sum(demand) FILTER (WHERE region = '{r}') AS BIGINT) AS \"{r}\"" for r in REGION_NAMES)
    + " FROM filled GROUP BY period")
def pivot_regions_q(spark, sf_dir):
    """Wide period x region matrix with the region list passed in."""
    return X.pivot_regions(series_ckpt(spark, sf_dir), _regions(spark, sf_dir))


@register("series_kpis", _with(*SQL_TOT_CHAIN[:-1]) + """
SELECT CAST(sum(demand) AS BIGINT) AS total_demand, CAST(count(*) AS BIGINT) AS rows,
       CAST(count(DISTINCT period) AS BIGINT) AS periods, CAST(count(DISTINCT region) AS BIGINT) AS regions,
       CAST(count(DISTINCT period) * count(DISTINCT region) AS BIGINT) AS grid_cells FROM filled""")
def series_kpis_q(spark, sf_dir):
    return X.series_kpis(series_ckpt(spark, sf_dir))


@register("region_totals", _with(*SQL_TOT_CHAIN[:-1]) + """
, t AS (SELECT region, CAST(sum(demand) AS DOUBLE) AS total FROM filled GROUP BY region)
SELECT region, total, CAST(row_number() OVER (ORDER BY total DESC, region) AS INTEGER) AS rank,
       row_number() OVER (ORDER BY total DESC, region) = 1 AS is_busiest,
       row_number() OVER (ORDER BY total DESC, region) = count(*) OVER () AS is_quietest
FROM t""")
def region_totals_q(spark, sf_dir):
    """Regions ranked busiest first."""
    return X.region_totals(series_ckpt(spark, sf_dir))


@register("demand_lines", _with(*SQL_TOT_CHAIN[:-1]) + """
SELECT period, region AS line, CAST(demand AS DOUBLE) AS demand FROM filled
UNION ALL
SELECT period, 'All regions', CAST(sum(demand) AS DOUBLE) FROM filled GROUP BY period""")
def demand_lines_q(spark, sf_dir):
    """Per-region lines plus the total line (ROLLUP)."""
    return X.demand_lines(series_ckpt(spark, sf_dir))


@register("series_summary", _with(*SQL_TOT_CHAIN) + """
, t AS (SELECT period, y, row_number() OVER (ORDER BY period) AS rn, count(*) OVER () AS n FROM tot),
a AS (
  SELECT min(period) AS span_start, max(period) AS span_end, CAST(count(*) AS BIGINT) AS n_periods,
         avg(y) FILTER (WHERE rn <= greatest(1, n // 3)) AS early_mean,
         avg(y) FILTER (WHERE rn > n - greatest(1, n // 3)) AS late_mean,
         arg_max(period, y * 1e12 - epoch(period)) AS peak_period, max(y) AS peak_value FROM t),
r AS (SELECT region, sum(demand) AS total FROM filled GROUP BY region)
SELECT span_start, span_end, n_periods, round(early_mean, 6) AS early_mean, round(late_mean, 6) AS late_mean,
       peak_period, round(peak_value, 6) AS peak_value,
       round(CASE WHEN early_mean > 0 THEN (late_mean - early_mean) / early_mean * 100 ELSE 0 END, 6) AS pct_change,
       (SELECT CAST(count(*) AS BIGINT) FROM r) AS n_regions,
       (SELECT arg_max(region, total * 1e6 - ascii(region)) FROM r) AS busiest,
       (SELECT arg_min(region, total * 1e6 - ascii(region)) FROM r) AS quietest
FROM a""")
def series_summary_q(spark, sf_dir):
    """P17 (the reading text is checked in the tests)."""
    s = X.series_summary(series_ckpt(spark, sf_dir))
    return r6(s.select("span_start", "span_end", "n_periods", "early_mean", "late_mean", "peak_period",
                       "peak_value", "pct_change", "n_regions", "busiest", "quietest"),
              "early_mean", "late_mean", "peak_value", "pct_change")


# ================================================================== features
@register("calendar_features", _with(*SQL_TOT_CHAIN) + """
SELECT period, y, CAST(isodow(period) - 1 AS INTEGER) AS day_of_week,
       CAST(isodow(period) >= 6 AS INTEGER) AS is_weekend, CAST(month(period) AS INTEGER) AS month,
       CAST(day(period) AS INTEGER) AS day_of_month,
       CAST(isodow(period) - 1 AS INTEGER) AS cal_dayofweek, CAST(day(period) AS INTEGER) AS cal_day,
       CAST(month(period) AS INTEGER) AS cal_month, CAST(dayofyear(period) AS INTEGER) AS cal_dayofyear,
       CAST(isodow(period) >= 6 AS INTEGER) AS cal_is_weekend,
       CAST(weekofyear(period) AS VARCHAR) AS bucket FROM tot""")
def calendar_features_q(spark, sf_dir):
    """W2 + W3 + W14 on the total series."""
    t = W.calendar_features(total_series(spark, sf_dir))
    return W.iso_week_bucket(W.calendar_features(t, extended=True))


@register("dow_dummies", _with(*SQL_TOT_CHAIN) + "SELECT period, y, " + ", ".join(
    f"CASE WHEN isodow(period) - 1 = {d} THEN 1.0 ELSE 0.0 END::DOUBLE AS dow_{d}" for d in range(1, 7))
    + " FROM tot")
def dow_dummies_q(spark, sf_dir):
    """Monday is the reference level."""
    return W.dow_dummies(total_series(spark, sf_dir))


@register("feature_matrix", _with(SQL_LOOKUP, SQL_TRIPS, SQL_COUNTED, SQL_GRID, SQL_FILLED, SQL_SERIES)
          + "SELECT period, region, demand, lag_1, lag_7, lag_14, "
          "CAST(isodow(period) - 1 AS INTEGER) AS cal_dayofweek, CAST(day(period) AS INTEGER) AS cal_day, "
          "CAST(month(period) AS INTEGER) AS cal_month, CAST(dayofyear(period) AS INTEGER) AS cal_dayofyear, "
          "CAST(isodow(period) >= 6 AS INTEGER) AS cal_is_weekend, " + ", ".join(
              f"CASE WHEN region = '{r}' THEN 1.0 ELSE 0.0 END::DOUBLE AS \"region_{r}\"" for r in REGION_NAMES)
          + " FROM series")
def feature_matrix_q(spark, sf_dir):
    """Lags + cal_* + region one-hot over the flagship series."""
    return W.feature_matrix(series_ckpt(spark, sf_dir), SCOPE.lags, _regions(spark, sf_dir))


@register("infer_step", """
WITH p AS (SELECT DISTINCT o_orderdate AS p FROM orders WHERE o_orderdate IS NOT NULL),
g AS (SELECT epoch(p) - epoch(lag(p) OVER (ORDER BY p)) AS gap FROM p),
m AS (SELECT gap, count(*) AS n FROM g WHERE gap > 0 GROUP BY gap ORDER BY n DESC, gap LIMIT 1)
SELECT CAST(coalesce((SELECT gap FROM m), 86400) AS BIGINT) AS step_seconds""")
def infer_step_q(spark, sf_dir):
    """W6 over the raw order stamps."""
    return W.infer_step(T.trips_orders(spark, sf_dir), "pickup_datetime")


@register("future_periods", _with(*SQL_TOT_CHAIN[:-1]) + """
SELECT r.region, CAST(h AS INTEGER) AS h, m.last + h * INTERVAL 1 DAY AS period
FROM (SELECT DISTINCT region FROM filled) r, (SELECT max(period) AS last FROM filled) m,
     range(1, 15) t(h)""")
def future_periods_q(spark, sf_dir):
    """14 future days after the global last period, per region."""
    return W.future_periods(series_ckpt(spark, sf_dir), 14)


@register("window_sequences", _with(*SQL_TOT_CHAIN[:-1]) + """
, w AS (SELECT region, period, CAST(demand AS DOUBLE) AS y,
               list(CAST(demand AS DOUBLE)) OVER (PARTITION BY region ORDER BY period
                                                  ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS x
        FROM filled)
SELECT region, period, x, y FROM w WHERE len(x) = 7""")
def window_sequences_q(spark, sf_dir):
    """Previous 7 values -> next value, per region."""
    s = series_ckpt(spark, sf_dir).select("region", "period", F.col("demand").cast("double").alias("y"))
    return W.window_sequences(s, 7)


@register("standardize", _with(*SQL_TOT_CHAIN) + """
SELECT period, y, round(avg(y) OVER (), 6) AS mu, round(CASE WHEN stddev_pop(y) OVER () <= 1e-12 THEN 1.0
       ELSE stddev_pop(y) OVER () END, 6) AS sd,
       round((y - avg(y) OVER ()) / CASE WHEN stddev_pop(y) OVER () <= 1e-12 THEN 1.0 ELSE stddev_pop(y) OVER () END, 6) AS z
FROM tot""")
def standardize_q(spark, sf_dir):
    """Global mean / population std of the total series."""
    s = W.standardize(total_series(spark, sf_dir), "y")
    return r6(s.select("period", "y", F.col("__mu").alias("mu"), F.col("__sd").alias("sd"), "z"),
              "mu", "sd", "z")


@register("rolling_stats", _with(*SQL_TOT_CHAIN) + """
, m AS (SELECT period, y, CASE WHEN count(y) OVER w >= 2 THEN quantile_cont(y, 0.5) OVER w END AS local_median
        FROM tot WINDOW w AS (ORDER BY period ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
d AS (SELECT *, abs(y - local_median) AS abs_dev FROM m)
SELECT period, round(local_median, 6) AS local_median,
       round(CASE WHEN count(abs_dev) OVER w >= 2 THEN quantile_cont(abs_dev, 0.5) OVER w END, 6) AS local_mad,
       round(CASE WHEN count(abs_dev) OVER w >= 2 THEN avg(abs_dev) OVER w END, 6) AS local_mean_abs_dev
FROM d WINDOW w AS (ORDER BY period ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def rolling_stats_q(spark, sf_dir):
    """W11 + W12: centred 7-day rolling median and MAD of the total series."""
    d = W.rolling_mad(W.rolling_median(total_series(spark, sf_dir), 7), 7)
    return r6(d.select("period", "local_median", "local_mad", "local_mean_abs_dev"),
              "local_median", "local_mad", "local_mean_abs_dev")


@register("centered_moving_average", _with(*SQL_TOT_CHAIN) + """
SELECT period, round(CASE WHEN count(y) OVER w7 = 7 THEN avg(y) OVER w7 END, 6) AS trend_7,
       round(CASE WHEN count(y) OVER w12 = 13 THEN
             (sum(y) OVER w12 - 0.5 * (lag(y, 6) OVER o + lead(y, 6) OVER o)) / 12 END, 6) AS trend_12
FROM tot WINDOW w7 AS (ORDER BY period ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING),
                w12 AS (ORDER BY period ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING),
                o AS (ORDER BY period)""")
def centered_moving_average_q(spark, sf_dir):
    """Odd (7) and even (12, half-weight ends) centred moving averages."""
    t = W.centered_moving_average(total_series(spark, sf_dir), 7, out="trend_7")
    t = W.centered_moving_average(t, 12, out="trend_12")
    return r6(t.select("period", "trend_7", "trend_12"), "trend_7", "trend_12")


# ================================================================ statistics
SQL_DECOMP = """
  dtr AS (SELECT period, y, CASE WHEN count(y) OVER w = 7 THEN avg(y) OVER w END AS trend,
                 (row_number() OVER (ORDER BY period) - 1) % 7 AS idx
          FROM tot WINDOW w AS (ORDER BY period ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
  pm AS (SELECT idx, avg(y - trend) AS pm FROM dtr GROUP BY idx),
  sea AS (SELECT idx, pm - avg(pm) OVER () AS seasonal FROM pm),
  dec AS (SELECT d.period, d.y, d.trend, s.seasonal, d.y - d.trend - s.seasonal AS resid
          FROM dtr d JOIN sea s ON d.idx = s.idx)"""


@register("seasonal_decompose", _with(*SQL_TOT_CHAIN, SQL_DECOMP) + """
SELECT period, y, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(resid, 6) AS resid FROM dec""")
def seasonal_decompose_q(spark, sf_dir):
    """A1: additive decomposition, period 7, of the total series."""
    d = X.seasonal_decompose(total_series(spark, sf_dir), 7)
    return r6(d, "trend", "seasonal", "resid")


@register("decomposition_strength", _with(*SQL_TOT_CHAIN, SQL_DECOMP) + """
, c AS (SELECT * FROM dec WHERE trend IS NOT NULL AND resid IS NOT NULL),
a AS (SELECT arg_min(trend, period) FILTER (WHERE trend IS NOT NULL) AS ts,
             arg_max(trend, period) FILTER (WHERE trend IS NOT NULL) AS te,
             max(seasonal) - min(seasonal) AS swing,
             (SELECT var_samp(resid) FROM c) AS vr, (SELECT var_samp(resid + seasonal) FROM c) AS vds,
             (SELECT var_samp(resid + trend) FROM c) AS vdt,
             stddev_samp(resid) AS sr, stddev_samp(y) AS sy FROM dec)
SELECT round(ts, 6) AS trend_start, round(te, 6) AS trend_end,
       round(CASE WHEN ts <> 0 THEN (te - ts) / abs(ts) * 100 ELSE 0 END, 6) AS trend_pct,
       round(swing, 6) AS seasonal_swing,
       round(CASE WHEN vds > 0 THEN greatest(0, 1 - vr / vds) ELSE 0 END, 6) AS seasonal_strength,
       round(CASE WHEN vdt > 0 THEN greatest(0, 1 - vr / vdt) ELSE 0 END, 6) AS trend_strength,
       round(sr / CASE WHEN coalesce(sy, 0) = 0 THEN 1 ELSE sy END, 6) AS resid_share
FROM a""")
def decomposition_strength_q(spark, sf_dir):
    """A2 over the A1 output."""
    d = X.decomposition_strength(X.seasonal_decompose(total_series(spark, sf_dir), 7))
    return r6(d.drop("trend_direction"), "trend_start", "trend_end", "trend_pct", "seasonal_swing",
              "seasonal_strength", "trend_strength", "resid_share")


@register("adf_lag0", _with(*SQL_TOT_CHAIN) + """
, d AS (SELECT lag(y) OVER (ORDER BY period) AS x, y - lag(y) OVER (ORDER BY period) AS dy FROM tot),
a AS (SELECT regr_slope(dy, x) AS slope, regr_sxx(dy, x) AS sxx, regr_syy(dy, x) AS syy,
             regr_sxy(dy, x) AS sxy, regr_count(dy, x) AS n FROM d WHERE x IS NOT NULL AND dy IS NOT NULL)
SELECT CAST(n AS BIGINT) AS nobs, round(slope, 6) AS slope,
       round(slope / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx), 6) AS adf_stat FROM a""")
def adf_lag0_q(spark, sf_dir):
    """A3 at lag 0: Dickey-Fuller t statistic from SQL regression aggregates."""
    return r6(X.adf_lag0(total_series(spark, sf_dir)), "slope", "adf_stat")


SQL_ADF = """
, s AS (SELECT region, list(CAST(y AS DOUBLE) ORDER BY period) AS y, CAST(count(*) AS INT) AS n FROM series_y GROUP BY region),
s2 AS (SELECT region, n, list_transform(y, lambda v: v - list_avg(y)) AS y,
              list_transform(range(1, n), lambda i: y[i + 1] - y[i]) AS d,
              CAST(least(n // 2 - 2, ceil(12 * pow(n / 100.0, 0.25))) AS INT) AS maxlag FROM s),
live AS (SELECT * FROM s2 WHERE list_max(y) > list_min(y)),
c0 AS (SELECT region, n, maxlag, n - 1 - maxlag AS common, list_concat(
         [list_transform(range(maxlag + 1, n), lambda i: 1.0::DOUBLE), list_transform(range(maxlag + 1, n), lambda i: y[i])],
         list_transform(range(1, maxlag + 1), lambda j: list_transform(range(maxlag + 1, n), lambda i: d[i - j])),
         [list_transform(range(maxlag + 1, n), lambda i: d[i])]) AS cols FROM live),
lags AS (SELECT region, unnest(range(0, maxlag + 1)) AS lag, common, cols FROM c0),
e AS (
  WITH RECURSIVE r AS (
    SELECT region, 0 AS k, cols FROM c0
    UNION ALL
    SELECT region, k + 1, list_transform(cols[2:], lambda c: list_transform(range(1, len(c) + 1),
             lambda i: c[i] - list_dot_product(c, cols[1]) / list_dot_product(cols[1], cols[1]) * cols[1][i]))
    FROM r WHERE len(cols) > 1)
  SELECT region, k, list_dot_product(cols[len(cols)], cols[len(cols)]) AS ssr FROM r),
pick AS (SELECT region, lag FROM (
  SELECT l.region, l.lag, row_number() OVER (PARTITION BY l.region ORDER BY
         common * (ln(2 * pi()) + ln(e.ssr / common) + 1) + 2 * (2 + l.lag), l.lag) AS k
  FROM lags l JOIN e ON e.region = l.region AND e.k = 2 + l.lag) WHERE k = 1),
f0 AS (SELECT v.region, p.lag, v.n - 1 - p.lag AS nobs, list_concat(
         [list_transform(range(p.lag + 1, n), lambda i: 1.0::DOUBLE)],
         list_transform(range(1, p.lag + 1), lambda j: list_transform(range(p.lag + 1, n), lambda i: d[i - j])),
         [list_transform(range(p.lag + 1, n), lambda i: y[i]), list_transform(range(p.lag + 1, n), lambda i: d[i])]) AS cols
       FROM live v JOIN pick p ON p.region = v.region),
g AS (
  WITH RECURSIVE r AS (
    SELECT region, lag, nobs, 0 AS k, cols FROM f0
    UNION ALL
    SELECT region, lag, nobs, k + 1, list_transform(cols[2:], lambda c: list_transform(range(1, len(c) + 1),
             lambda i: c[i] - list_dot_product(c, cols[1]) / list_dot_product(cols[1], cols[1]) * cols[1][i]))
    FROM r WHERE len(cols) > 2)
  SELECT region, lag, nobs, cols[1] AS x, cols[2] AS t FROM r WHERE len(cols) = 2),
stat AS (SELECT region, lag, nobs, list_dot_product(x, t) / list_dot_product(x, x) AS slope,
                list_dot_product(x, x) AS xx, list_dot_product(t, t) AS tt FROM g)
SELECT s2.region, CAST(lag AS INT) AS used_lag, CAST(nobs AS INT) AS nobs,
       round(slope / sqrt((tt - slope * slope * xx) / (nobs - 2 - lag) / xx), 6) AS adf_stat,
       CASE WHEN list_max(s2.y) > list_min(s2.y) THEN 'ok' ELSE 'constant series' END AS status
FROM s2 LEFT JOIN stat ON stat.region = s2.region"""


def _adf_columns(found):
    return r6(found.select("region", "used_lag", "nobs", "adf_stat", "status"), "adf_stat")


@register("adf_test", _with(*SQL_TOT_CHAIN[:-1]) + """
, series_y AS (SELECT region, period, demand AS y FROM filled)""" + SQL_ADF)
def adf_test_q(spark, sf_dir):
    """A3 with the AIC lag search, per region."""
    return _adf_columns(X.adf_test(X.region_series(series_ckpt(spark, sf_dir)), by=["region"]))


@register("adf_test_flat", _with(*SQL_TOT_CHAIN[:-1]) + """
, series_y AS (SELECT region, period, demand AS y FROM filled
               UNION ALL SELECT 'NOWHERE', period, 0 FROM (SELECT DISTINCT period FROM filled))""" + SQL_ADF)
def adf_test_flat_q(spark, sf_dir):
    """A3 with a region that never has a trip among the others."""
    y = X.region_series(series_ckpt(spark, sf_dir))
    flat = y.select("period").distinct().select(F.lit("NOWHERE").alias("region"), "period", F.lit(0.0).alias("y"))
    return _adf_columns(X.adf_test(y.select("region", "period", "y").unionByName(flat), by=["region"]))


@register("acf", _with(*SQL_TOT_CHAIN) + """
, d AS (SELECT period, y - avg(y) OVER () AS x FROM tot),
n AS (SELECT count(*) AS n, sum(x * x) AS c0 FROM d),
l AS (SELECT * FROM range(0, 41) t(k))
SELECT CAST(l.k AS INTEGER) AS lag,
       round(sum(a.x * b.x) / max(n.c0), 6) AS acf, round(1.96 / sqrt(max(n.n)), 6) AS band
FROM l CROSS JOIN n JOIN d a ON true
JOIN d b ON b.period = a.period + l.k * INTERVAL 1 DAY
GROUP BY l.k""")
def acf_q(spark, sf_dir):
    """A4: ACF to lag 40 with the 95% band."""
    return r6(X.acf(total_series(spark, sf_dir)), "acf", "band")


SQL_PACF = """
, m AS (SELECT region, period, demand - avg(demand) OVER (PARTITION BY region) AS x,
               row_number() OVER (PARTITION BY region ORDER BY period) AS i, count(*) OVER (PARTITION BY region) AS n FROM filled),
c AS (SELECT a.region, any_value(a.n) AS n, b.i - a.i AS lag, sum(a.x * b.x) AS c
      FROM m a JOIN m b ON a.region = b.region AND b.i >= a.i AND b.i - a.i <= greatest(1, least(40, a.n // 2 - 1)) GROUP BY a.region, b.i - a.i),
r AS (SELECT region, any_value(n) AS n, list(c ORDER BY lag) AS cs FROM c GROUP BY region),
r1 AS (SELECT region, n, list_transform(cs, lambda v: v / cs[1]) AS r FROM r),
dl AS (
  WITH RECURSIVE t AS (
    SELECT region, n, r, 0 AS k, []::DOUBLE[] AS phi, r[1] AS v, 1.0::DOUBLE AS pacf FROM r1
    UNION ALL
    SELECT region, n, r, k, list_append(list_transform(range(1, k), lambda j: phi[j] - a * phi[k - j]), a), v * (1 - a * a), a
    FROM (SELECT region, n, r, k + 1 AS k, phi, v,
                 (r[k + 2] - coalesce(list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 2 - j])), 0)) / v AS a
          FROM t WHERE k + 1 < len(r)))
  SELECT region, n, CAST(k AS INT) AS lag, pacf FROM t)"""


@register("pacf", _with(*SQL_TOT_CHAIN[:-1]) + SQL_PACF + """
SELECT region, lag, round(pacf, 6) AS pacf, round(1.96 / sqrt(n), 6) AS band FROM dl""")
def pacf_q(spark, sf_dir):
    """A5: PACF (Yule-Walker / Durbin-Levinson) per region."""
    y = X.region_series(series_ckpt(spark, sf_dir))
    return r6(X.pacf(X.acf(y, by=["region"]), by=["region"]), "pacf", "band")


@register("order_hints", _with(*SQL_TOT_CHAIN[:-1]) + SQL_PACF + """
, a AS (SELECT region, CAST(lag AS INT) AS lag, r[lag + 1] AS acf, 1.96 / sqrt(n) AS band FROM r1, range(1, 41) t(lag) WHERE lag < len(r)),
sa AS (SELECT region, list(lag ORDER BY lag) AS sig_acf, bool_or(lag = 7) AS weekly FROM a WHERE abs(acf) > band GROUP BY region),
sp AS (SELECT region, list(lag ORDER BY lag) AS sig_pacf, min(lag) AS ar_order_hint FROM dl
       WHERE lag >= 1 AND abs(pacf) > 1.96 / sqrt(n) GROUP BY region)
SELECT r1.region, coalesce(sig_acf, []) AS sig_acf, coalesce(sig_pacf, []) AS sig_pacf, ar_order_hint,
       coalesce(weekly, false) AS weekly FROM r1 LEFT JOIN sa USING (region) LEFT JOIN sp USING (region)""")
def order_hints_q(spark, sf_dir):
    """Significant lags, AR hint and weekly flag per region."""
    y = X.region_series(series_ckpt(spark, sf_dir))
    a = X.acf(y, by=["region"])
    return X.order_hints(a, X.pacf(a, by=["region"]), by=["region"])


SQL_ANOM = """
  m AS (SELECT region, period, CAST(demand AS DOUBLE) AS y,
               CASE WHEN count(demand) OVER w >= 2 THEN quantile_cont(demand, 0.5) OVER w END AS med
        FROM filled WINDOW w AS (PARTITION BY region ORDER BY period ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
  d AS (SELECT *, abs(y - med) AS ad FROM m),
  s AS (SELECT region, period, y, med,
               CASE WHEN count(ad) OVER w >= 2 THEN quantile_cont(ad, 0.5) OVER w END * 1.4826 AS mad,
               CASE WHEN count(ad) OVER w >= 2 THEN avg(ad) OVER w END * 1.2533 AS fb
        FROM d WINDOW w AS (PARTITION BY region ORDER BY period ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
  sc AS (SELECT region, period, y AS value, med AS expected,
                coalesce(CASE WHEN mad > 0 THEN (y - med) / mad WHEN fb <> 0 THEN (y - med) / fb END, 0.0) AS score
         FROM s)"""


@register("detect_anomalies", _with(*SQL_TOT_CHAIN[:-1], SQL_ANOM) + """
SELECT region, period, value, round(expected, 6) AS expected, round(score, 6) AS score,
       CASE WHEN score > 0 THEN 'spike' ELSE 'drop' END AS direction,
       round(CASE WHEN expected > 0 THEN (value - expected) / expected * 100 END, 6) AS pct
FROM sc WHERE abs(score) > 3.5""")
def detect_anomalies_q(spark, sf_dir):
    """A7 + A8 per region (window 7, threshold 3.5)."""
    a = X.detect_anomalies(X.region_series(series_ckpt(spark, sf_dir)), by=["region"])
    return r6(a.select("region", "period", "value", "expected", "score", "direction",
                       X.anomaly_pct().alias("pct")), "expected", "score", "pct")


@register("anomaly_summary", _with(*SQL_TOT_CHAIN[:-1], SQL_ANOM) + """
, a AS (SELECT * FROM sc WHERE abs(score) > 3.5)
SELECT region, CAST(count(*) FILTER (WHERE score > 0) AS BIGINT) AS spikes,
       CAST(count(*) FILTER (WHERE score <= 0) AS BIGINT) AS drops,
       arg_max(period, abs(score) * 1e9 - epoch(period) / 1e3) AS extreme_period,
       round(arg_max(score, abs(score) * 1e9 - epoch(period) / 1e3), 6) AS extreme_score
FROM a GROUP BY region""")
def anomaly_summary_q(spark, sf_dir):
    """A9 per region."""
    a = X.detect_anomalies(X.region_series(series_ckpt(spark, sf_dir)), by=["region"])
    return r6(X.anomaly_summary(a, by=["region"]), "extreme_score")


def _corr_sql(method: str) -> str:
    cols = ["demand", "day_of_week", "is_weekend", "month", "day_of_month"]
    base = """
, b AS (SELECT y AS demand, CAST(isodow(period) - 1 AS DOUBLE) AS day_of_week,
               CAST(isodow(period) >= 6 AS DOUBLE) AS is_weekend, CAST(month(period) AS DOUBLE) AS month,
               CAST(day(period) AS DOUBLE) AS day_of_month FROM tot)"""
    if method == "spearman":
        base += ", r AS (SELECT " + ", ".join(
            f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) AS {c}" for c in cols) + " FROM b)"
        src = "r"
    else:
        src = "b"
    parts = []
    for a in cols:
        for c in cols:
            expr = (f"CASE WHEN stddev_pop({a}) > 0 THEN 1.0 END" if a == c else
                    f"covar_pop({a}, {c}) / nullif(stddev_pop({a}) * stddev_pop({c}), 0)")
            parts.append(f"SELECT '{a}' AS x, '{c}' AS y, round({expr}, 6) AS r FROM {src}")
    return base + "\n" + "\nUNION ALL\n".join(parts)


@register("demand_correlations", _with(*SQL_TOT_CHAIN) + _corr_sql("pearson"))
def demand_correlations_q(spark, sf_dir):
    """A10: Pearson matrix of total demand and the calendar features."""
    return r6(X.demand_correlations(total_series(spark, sf_dir)), "r")


@register("demand_correlations_spearman", _with(*SQL_TOT_CHAIN) + _corr_sql("spearman"))
def demand_correlations_spearman_q(spark, sf_dir):
    """Spearman (average ranks, then Pearson)."""
    return r6(X.demand_correlations(total_series(spark, sf_dir), method="spearman"), "r")


SQL_KENDALL = """
, base AS (SELECT row_number() OVER (ORDER BY period) AS i, [y, dow::DOUBLE, (dow >= 5)::INT::DOUBLE, month(period)::DOUBLE, day(period)::DOUBLE] AS v
           FROM (SELECT period, y, isodow(period) - 1 AS dow FROM tot)),
names AS (SELECT k, ['demand', 'day_of_week', 'is_weekend', 'month', 'day_of_month'][k] AS name FROM range(1, 6) t(k)),
pairs AS (SELECT a.k AS ka, b.k AS kb, sign(p.v[a.k] - q.v[a.k]) AS sa, sign(p.v[b.k] - q.v[b.k]) AS sb
          FROM names a, names b, base p JOIN base q ON p.i < q.i)
SELECT x.name AS x, y.name AS y, CASE WHEN ka = kb THEN 1.0 ELSE
       round(sum(sa * sb) / sqrt(CAST(count(*) FILTER (WHERE sa <> 0) AS DOUBLE) * count(*) FILTER (WHERE sb <> 0)), 6) END AS r
FROM pairs JOIN names x ON x.k = ka JOIN names y ON y.k = kb GROUP BY x.name, y.name, ka, kb"""


@register("demand_correlations_kendall", _with(*SQL_TOT_CHAIN) + SQL_KENDALL)
def demand_correlations_kendall_q(spark, sf_dir):
    """Kendall tau-b, pairs counted by blocks of both axes."""
    return r6(X.demand_correlations(total_series(spark, sf_dir), method="kendall"), "r")


@register("demand_correlations_exog", _with(*SQL_TOT_CHAIN) + """
, ex AS (SELECT CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS period, CAST(count(*) AS DOUBLE) AS shipments,
                avg(l_discount) AS avg_discount FROM lineitem GROUP BY 1),
b AS (SELECT t.y AS demand, ex.shipments, ex.avg_discount FROM tot t LEFT JOIN ex ON t.period = ex.period)
""" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS x, '{c}' AS y, round(" + (
        f"CASE WHEN stddev_pop({a}) > 0 THEN 1.0 END" if a == c else
        f"covar_pop({a}, {c}) / nullif(stddev_pop(CASE WHEN {c} IS NOT NULL THEN {a} END) * "
        f"stddev_pop(CASE WHEN {a} IS NOT NULL THEN {c} END), 0)") + ", 6) AS r FROM b"
    for a in ("demand", "shipments", "avg_discount") for c in ("demand", "shipments", "avg_discount")))
def demand_correlations_exog_q(spark, sf_dir):
    """Correlation with an exogenous daily table derived from line items."""
    li = T.table(spark, sf_dir, "lineitem")
    ex = li.groupBy(F.col("l_shipdate").cast("date").cast("timestamp_ntz").alias("period")).agg(
        F.count(F.lit(1)).cast("double").alias("shipments"), F.avg("l_discount").alias("avg_discount"))
    return r6(X.demand_correlations(total_series(spark, sf_dir), exog=ex), "r")


_PEARSON = _corr_sql("pearson")
_PEARSON_CTE, _PEARSON_UNION = _PEARSON[:_PEARSON.index("\nSELECT")], _PEARSON[_PEARSON.index("\nSELECT"):]


@register("correlation_ranking", _with(*SQL_TOT_CHAIN) + _PEARSON_CTE + ", pr AS (" + _PEARSON_UNION + ")" + """
SELECT y AS variable, r, CAST(row_number() OVER (ORDER BY abs(r) DESC, y) AS INTEGER) AS rank,
       CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate'
            WHEN abs(r) >= 0.2 THEN 'weak' ELSE 'negligible' END AS strength,
       CASE WHEN r >= 0 THEN 'positive' ELSE 'negative' END AS sign
FROM pr WHERE x = 'demand' AND y <> 'demand' AND r IS NOT NULL""")
def correlation_ranking_q(spark, sf_dir):
    """demand's correlations ranked by |r| with a strength class."""
    c = X.demand_correlations(total_series(spark, sf_dir))
    return r6(X.correlation_ranking(c), "r")


# ================================================= evaluation with the SQL model
from tripcast.operators import evaluate as E  # noqa: E402
from tripcast.operators import position as B  # noqa: E402
from tripcast.operators.forecast import naive as NV  # noqa: E402
from tripcast.operators.forecast import split as SP  # noqa: E402

HOLDOUT = 30
BASELINES = ("Seasonal-Naive", "Naive")
SQL_EVAL = """
  hp AS (SELECT DISTINCT period FROM lfilled ORDER BY period DESC LIMIT 30),
  train AS (SELECT * FROM lfilled WHERE period NOT IN (SELECT period FROM hp)),
  hold AS (SELECT * FROM lfilled WHERE period IN (SELECT period FROM hp)),
  lastp AS (SELECT region, max(period) AS last, count(*) AS n FROM train GROUP BY region),
  rd AS (SELECT region, period, demand,
                row_number() OVER (PARTITION BY region ORDER BY period DESC) AS rd FROM train),
  fut AS (SELECT region, h, last + h * INTERVAL 1 DAY AS period, n FROM lastp, range(1, 31) t(h)),
  fc AS (
    SELECT 'Seasonal-Naive' AS model, f.period, f.region,
           CAST(coalesce(a.demand, b.demand, 0) AS DOUBLE) AS yhat
    FROM fut f LEFT JOIN rd a ON a.region = f.region AND f.n >= 7 AND a.rd = 7 - ((f.h - 1) % 7)
               LEFT JOIN rd b ON b.region = f.region AND b.rd = 1
    UNION ALL
    SELECT 'Naive', f.period, f.region, CAST(coalesce(b.demand, 0) AS DOUBLE)
    FROM fut f LEFT JOIN rd b ON b.region = f.region AND b.rd = 1),
  act AS (SELECT period, CAST(sum(demand) AS DOUBLE) AS actual FROM hold GROUP BY period),
  ftot AS (SELECT m.model, a.period, CAST(coalesce(sum(f.yhat), 0) AS DOUBLE) AS yhat
           FROM (SELECT DISTINCT model FROM fc) m CROSS JOIN act a
           LEFT JOIN fc f ON f.model = m.model AND f.period = a.period GROUP BY m.model, a.period),
  scored AS (
    SELECT CASE model WHEN 'Seasonal-Naive' THEN 0 ELSE 1 END AS ordinal, model AS model_name,
           avg(abs(yhat - actual)) AS mae, sqrt(avg((yhat - actual) * (yhat - actual))) AS rmse,
           coalesce(avg(CASE WHEN actual <> 0 THEN abs(yhat - actual) / abs(actual) END) * 100, 0) AS mape
    FROM ftot JOIN act USING (period) GROUP BY model)"""
SQL_EVAL_CHAIN = (*SQL_LINE[:-1], SQL_EVAL)


def _eval_inputs(spark, sf_dir):
    """Line-item series -> 30-day holdout -> two seasonal-naive forecasts."""
    s = materialize(line_series(spark, sf_dir).select("period", "region", "demand"))
    train, hold = SP.split_holdout(s, HOLDOUT)
    fc = NV.seasonal_naive(train, HOLDOUT, 7, model=BASELINES[0]).unionByName(
        NV.seasonal_naive(train, HOLDOUT, 1, model=BASELINES[1]))
    return train, hold, fc


def _scored(spark, sf_dir):
    train, hold, fc = _eval_inputs(spark, sf_dir)
    act = E.actual_total(hold)
    ftot = E.forecast_total(fc, hold.select("period"))
    return act, ftot, E.score_models(ftot, act, order=BASELINES)


@register("split_holdout", _with(*SQL_EVAL_CHAIN) + """
SELECT period, region, demand, 'train' AS part FROM train UNION ALL
SELECT period, region, demand, 'holdout' FROM hold""")
def split_holdout_q(spark, sf_dir):
    """the 30 latest distinct days form the holdout for every region."""
    train, hold, _ = _eval_inputs(spark, sf_dir)
    return train.withColumn("part", F.lit("train")).unionByName(hold.withColumn("part", F.lit("holdout")))


@register("seasonal_naive", _with(*SQL_EVAL_CHAIN) + "SELECT * FROM fc")
def seasonal_naive_q(spark, sf_dir):
    """F4 with season 7 and season 1, per region, from each region's last day."""
    return _eval_inputs(spark, sf_dir)[2]


@register("forecast_total", _with(*SQL_EVAL_CHAIN) + "SELECT * FROM ftot")
def forecast_total_q(spark, sf_dir):
    """Each model reduced to a total per holdout day, missing -> 0."""
    return _scored(spark, sf_dir)[1]


@register("error_metrics", _with(*SQL_EVAL_CHAIN) + """
SELECT f.region, round(avg(abs(f.yhat - h.demand)), 6) AS mae,
       round(sqrt(avg((f.yhat - h.demand) * (f.yhat - h.demand))), 6) AS rmse,
       round(coalesce(avg(CASE WHEN h.demand <> 0 THEN abs(f.yhat - h.demand) / abs(h.demand) END) * 100, 0), 6) AS mape,
       CAST(count(*) AS BIGINT) AS n
FROM fc f JOIN hold h ON f.period = h.period AND f.region = h.region
WHERE f.model = 'Seasonal-Naive' GROUP BY f.region""")
def error_metrics_q(spark, sf_dir):
    """E1 per region for the seasonal-naive forecast."""
    _, hold, fc = _eval_inputs(spark, sf_dir)
    pairs = fc.where(F.col("model") == BASELINES[0]).join(
        hold.select("period", "region", F.col("demand").cast("double").alias("actual")), ["period", "region"])
    return r6(E.error_metrics(pairs, by=["region"]), "mae", "rmse", "mape")


@register("comparison_table", _with(*SQL_EVAL_CHAIN) + """
SELECT ordinal, model_name, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(mape, 6) AS mape,
       false AS excluded, CAST(NULL AS VARCHAR) AS excluded_reason FROM scored""")
def comparison_table_q(spark, sf_dir):
    """E2 + E3: one row per model, input order kept in ``ordinal``."""
    return r6(_scored(spark, sf_dir)[2], "mae", "rmse", "mape")


@register("leaderboard", _with(*SQL_EVAL_CHAIN) + """
SELECT ordinal, model_name, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(mape, 6) AS mape,
       false AS excluded, CAST(NULL AS VARCHAR) AS excluded_reason,
       CAST(row_number() OVER (ORDER BY mae NULLS LAST, ordinal) AS INTEGER) AS rank FROM scored""")
def leaderboard_q(spark, sf_dir):
    return r6(E.leaderboard(_scored(spark, sf_dir)[2]), "mae", "rmse", "mape")


@register("best_model", _with(*SQL_EVAL_CHAIN) + """
SELECT ordinal, model_name, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(mape, 6) AS mape,
       false AS excluded, CAST(NULL AS VARCHAR) AS excluded_reason
FROM scored ORDER BY mae, ordinal LIMIT 1""")
def best_model_q(spark, sf_dir):
    return r6(E.best_model(_scored(spark, sf_dir)[2]), "mae", "rmse", "mape")


@register("select_carry_forward", _with(*SQL_EVAL_CHAIN) + """
SELECT CAST(row_number() OVER (ORDER BY mae, rmse, mape, ordinal) AS INTEGER) AS cf_rank, model_name,
       round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(mape, 6) AS mape FROM scored""")
def select_carry_forward_q(spark, sf_dir):
    """E6 (two scored models: both carried)."""
    return r6(E.select_carry_forward(_scored(spark, sf_dir)[2]), "mae", "rmse", "mape")


@register("carry_forward_reasons", _with(*SQL_EVAL_CHAIN) + """
, r AS (SELECT CAST(row_number() OVER (ORDER BY mae, rmse, mape, ordinal) AS INTEGER) AS cf_rank, * FROM scored)
SELECT cf_rank, model_name,
       printf('#%d %s: MAE=%s, RMSE=%s, MAPE=%s%%', cf_rank, model_name, format('{:,.2f}', mae),
              format('{:,.2f}', rmse), format('{:,.2f}', mape)) AS justification
FROM r""")
def carry_forward_reasons_q(spark, sf_dir):
    return E.carry_forward_reasons(E.select_carry_forward(_scored(spark, sf_dir)[2]))


@register("error_by_period", _with(*SQL_EVAL_CHAIN) + """
, p AS (SELECT CAST(weekofyear(a.period) AS VARCHAR) AS bucket, a.period, a.actual, f.yhat
        FROM act a JOIN ftot f ON a.period = f.period WHERE f.model = 'Seasonal-Naive')
SELECT bucket, CAST(count(*) AS BIGINT) AS n_periods, round(avg(abs(yhat - actual)), 6) AS mae,
       round(sqrt(avg((yhat - actual) * (yhat - actual))), 6) AS rmse,
       round(coalesce(avg(CASE WHEN actual <> 0 THEN abs(yhat - actual) / abs(actual) END) * 100, 0), 6) AS mape,
       min(period) AS first_seen,
       CAST(row_number() OVER (ORDER BY min(period), bucket) AS INTEGER) AS bucket_order
FROM p GROUP BY bucket""")
def error_by_period_q(spark, sf_dir):
    """E8 by ISO week (W14) of the holdout days."""
    act, ftot, _ = _scored(spark, sf_dir)
    pairs = W.iso_week_bucket(ftot.where(F.col("model") == BASELINES[0]).join(act, "period"))
    return r6(E.error_by_period(pairs), "mae", "rmse", "mape")


@register("forecast_vs_actual", _with(*SQL_EVAL_CHAIN) + """
SELECT period, 'actual' AS line, actual AS value FROM act
UNION ALL SELECT period, model, yhat FROM ftot""")
def forecast_vs_actual_q(spark, sf_dir):
    act, ftot, tab = _scored(spark, sf_dir)
    return E.forecast_vs_actual(act, ftot, tab)


@register("metric_bars", _with(*SQL_EVAL_CHAIN) + """
, r AS (SELECT *, CAST(row_number() OVER (ORDER BY mae, ordinal) AS INTEGER) AS model_rank FROM scored)
SELECT model_rank, model_name, 'mae' AS metric, round(mae, 6) AS value FROM r
UNION ALL SELECT model_rank, model_name, 'rmse', round(rmse, 6) FROM r
UNION ALL SELECT model_rank, model_name, 'mape', round(mape, 6) FROM r""")
def metric_bars_q(spark, sf_dir):
    return r6(E.metric_bars(_scored(spark, sf_dir)[2]), "value")


@register("check_alignment", _with(*SQL_EVAL_CHAIN) + """
SELECT model, CAST(count(DISTINCT period) FILTER (WHERE period IN (SELECT period FROM hp)) AS BIGINT) AS covered,
       CAST((SELECT count(*) FROM hp) AS BIGINT) AS expected,
       count(DISTINCT period) FILTER (WHERE period IN (SELECT period FROM hp)) = (SELECT count(*) FROM hp) AS aligned
FROM fc GROUP BY model""")
def check_alignment_q(spark, sf_dir):
    """Q22: every model has one value per holdout day."""
    _, hold, fc = _eval_inputs(spark, sf_dir)
    return Q.check_alignment(fc, hold.select("period"))


@register("forecast_wide", _with(*SQL_EVAL_CHAIN) + "SELECT period, " + " + ".join(
    f"coalesce(CAST(sum(round_even(yhat, 0)) FILTER (WHERE region = '{r}') AS BIGINT), 0)" for r in REGION_NAMES)
    + " AS \"TOTAL\", " + ", ".join(
    f"coalesce(CAST(sum(round_even(yhat, 0)) FILTER (WHERE region = '{r}') AS BIGINT), 0) AS \"{r}\"" for r in REGION_NAMES)
    + " FROM fc WHERE model = 'Seasonal-Naive' GROUP BY period")
def forecast_wide_q(spark, sf_dir):
    """Forecast pivot with the TOTAL column first."""
    fc = _eval_inputs(spark, sf_dir)[2].where(F.col("model") == BASELINES[0])
    return X.forecast_wide(fc, _regions(spark, sf_dir))


SQL_PLACEMENTS = """
  pl AS (SELECT model, period, region, yhat AS predicted_demand FROM (
           SELECT *, row_number() OVER (PARTITION BY model, period ORDER BY yhat DESC, region) AS r FROM fc)
         WHERE r = 1)"""


@register("placements", _with(*SQL_EVAL_CHAIN, SQL_PLACEMENTS) + "SELECT * FROM pl")
def placements_q(spark, sf_dir):
    """B1: top region per model and day."""
    return B.placements(_eval_inputs(spark, sf_dir)[2])


@register("positioning_recommendation", _with(*SQL_EVAL_CHAIN, SQL_PLACEMENTS) + """
SELECT model, arg_max(region, predicted_demand * 1e10 - epoch(period) / 1e3) AS region,
       arg_max(period, predicted_demand * 1e10 - epoch(period) / 1e3) AS period,
       max(predicted_demand) AS predicted_demand, CAST(count(*) AS BIGINT) AS n_placements,
       printf('Position more drivers in %s (borough) for period %s: predicted demand is %.0f trips, the peak across the forecast horizon. Rebalance idle drivers toward the top predicted-demand borough in each period.',
              arg_max(region, predicted_demand * 1e10 - epoch(period) / 1e3),
              CAST(arg_max(period, predicted_demand * 1e10 - epoch(period) / 1e3) AS VARCHAR),
              max(predicted_demand)) AS action
FROM pl GROUP BY model""")
def positioning_recommendation_q(spark, sf_dir):
    """B2: global peak and action text per model."""
    return B.positioning_recommendation(_eval_inputs(spark, sf_dir)[2])


@register("quantify_impact", _with(*SQL_EVAL_CHAIN, SQL_PLACEMENTS) + """
SELECT model, period, region, predicted_demand,
       round(predicted_demand / 8.0, 6) AS drivers_positioned,
       round(predicted_demand * 6.0 * 0.30, 6) AS rider_wait_minutes_saved,
       round(predicted_demand / 8.0 * 12.0 * 0.25, 6) AS driver_idle_minutes_saved,
       round(predicted_demand * 6.0 * 0.30 + predicted_demand / 8.0 * 12.0 * 0.25, 6) AS total_minutes_saved
FROM pl""")
def quantify_impact_q(spark, sf_dir):
    """B3 for every placement row with the default assumptions."""
    imp = B.quantify_impact(B.placements(_eval_inputs(spark, sf_dir)[2]))
    return r6(imp.drop("assumptions", "formula"), "drivers_positioned", "rider_wait_minutes_saved",
              "driver_idle_minutes_saved", "total_minutes_saved")


@register("check_impact", _with(*SQL_EVAL_CHAIN, SQL_PLACEMENTS) + """
SELECT CAST(count(*) AS BIGINT) AS rows,
       CAST(count(*) FILTER (WHERE abs((predicted_demand * 6.0 * 0.30 + predicted_demand / 8.0 * 12.0 * 0.25)
            - (predicted_demand * 1.8 + predicted_demand * 0.375)) >= 1e-6) AS BIGINT) AS mismatches FROM pl""")
def check_impact_q(spark, sf_dir):
    """Recomputation agrees with the impact columns."""
    imp = B.quantify_impact(B.placements(_eval_inputs(spark, sf_dir)[2]))
    return B.check_impact(imp)


# ================================================================== forecasting
from tripcast.operators.forecast import train as TR  # noqa: E402
from tripcast.operators.forecast.additive import forecast_additive  # noqa: E402
from tripcast.operators.forecast.arima import forecast_sarima, forecast_sarimax  # noqa: E402
from tripcast.operators.forecast.gbt import forecast_gbt, recursive_features  # noqa: E402
from tripcast.operators.forecast.smoothing import forecast_holt_winters  # noqa: E402
from tripcast.operators.forecast.var import forecast_var  # noqa: E402
from tripcast.operators.forecast.windowed import forecast_windowed  # noqa: E402


def _train(spark, sf_dir):
    return _eval_inputs(spark, sf_dir)[0]


@register("holt_winters_fixed", _with(*SQL_EVAL_CHAIN) + """
, s AS (SELECT region, list(CAST(demand AS DOUBLE) ORDER BY period) AS y, max(period) AS last FROM train GROUP BY region),
r AS (
  WITH RECURSIVE t AS (
    SELECT region, y, last, 0 AS i, list_avg(y[1:7]) AS l, (list_avg(y[8:14]) - list_avg(y[1:7])) / 7 AS b,
           list_transform(y[1:7], lambda v: v - list_avg(y[1:7])) AS s, 0.0::DOUBLE AS sse FROM s
    UNION ALL
    SELECT region, y, last, i + 1, l2, 0.05 * (l2 - l) + 0.95 * b, list_append(s[2:], 0.2 * (y[i + 1] - l2) + 0.8 * s[1]),
           sse + (y[i + 1] - l - b - s[1]) * (y[i + 1] - l - b - s[1])
    FROM (SELECT *, 0.3 * (y[i + 1] - s[1]) + 0.7 * (l + b) AS l2 FROM t WHERE i < len(y)))
  SELECT * FROM t WHERE i = len(y))
SELECT 'Holt-Winters' AS model, last + h * INTERVAL 1 DAY AS period, region, round(l + h * b + s[(h - 1) % 7 + 1], 6) AS yhat,
       round(sse, 4) AS sse FROM r, range(1, 31) t(h)""")
def holt_winters_fixed_q(spark, sf_dir):
    """F5's recursion under given parameters (0.3, 0.05, 0.2), per region."""
    from tripcast.operators.forecast import smoothing as HW
    train = _train(spark, sf_dir)
    fitted = HW.fit_fixed(HW.ordered_series(train), 0.3, 0.05, 0.2)
    last = train.agg(F.max("period")).first()[0]
    rows = HW.forecast_rows(fitted, HOLDOUT, last, "Holt-Winters")
    return rows.join(fitted.select("region", F.round("state.sse", 4).alias("sse")), "region").select(
        "model", "period", "region", F.round("yhat", 6).alias("yhat"), "sse")


@register("forecast_holt_winters", None)
def forecast_holt_winters_q(spark, sf_dir):
    """F5 per region, 30 days after the global last training day."""
    return forecast_holt_winters(_train(spark, sf_dir), HOLDOUT)[0]


@register("forecast_sarima", None)
def forecast_sarima_q(spark, sf_dir):
    """F6 per region (CLS fit), clipped; failing regions fall back to F4."""
    return forecast_sarima(_train(spark, sf_dir), HOLDOUT)[0]


@register("forecast_sarimax", None)
def forecast_sarimax_q(spark, sf_dir):
    """F7 with day-of-week dummies."""
    return forecast_sarimax(_train(spark, sf_dir), HOLDOUT)[0]


#: Elimination on the cross products: the targets' block after 1 + 5 p columns holds the residuals' of order p.
SQL_VAR = """
, v AS (SELECT list(ys ORDER BY period) AS y, CAST(count(*) AS INT) AS n, any_value(rs) AS rs FROM (
  SELECT period, list(CAST(demand AS DOUBLE) ORDER BY region) AS ys, list(region ORDER BY region) AS rs FROM train GROUP BY period)),
kk AS (SELECT *, len(rs) AS k, CAST(greatest(1, least(7, (n - 1) // (len(rs) + 1))) AS INT) AS top FROM v),
cc AS (SELECT k, top, n, y, rs, list_concat([list_transform(range(top + 1, n + 1), lambda t: 1.0::DOUBLE)],
         list_transform(range(0, k * (top + 1)), lambda j: list_transform(range(top + 1, n + 1), lambda t:
           CASE WHEN j < k * top THEN y[t - 1 - j // k][j % k + 1] ELSE y[t][j - k * top + 1] END))) AS c FROM kk),
gg AS (SELECT k, top, n, list_transform(c, lambda a: list_transform(c, lambda b: list_dot_product(a, b))) AS m FROM cc)"""
SQL_VAR_FIT = SQL_VAR + """,
el AS (
  WITH RECURSIVE r AS (
    SELECT 0 AS done, k, top, n, m FROM gg
    UNION ALL
    SELECT done + 1, k, top, n, list_transform(m[2:], lambda w: list_transform(range(2, len(w) + 1),
             lambda j: w[j] - w[1] / m[1][1] * m[1][j])) FROM r WHERE done < k * top + 1)
  SELECT * FROM r),
sig AS (SELECT (done - 1) // k AS p, k, top, n, list_transform(m[k * top + 2 - done:], lambda w: w[k * top + 2 - done:]) AS s
        FROM el WHERE (done - 1) % k = 0 AND done >= 1),
dt AS (
  WITH RECURSIVE r AS (
    SELECT p, k, top, n, s, 0.0::DOUBLE AS logdet FROM sig
    UNION ALL
    SELECT p, k, top, n, list_transform(s[2:], lambda w: list_transform(range(2, len(w) + 1),
             lambda j: w[j] - w[1] / s[1][1] * s[1][j])), logdet + ln(s[1][1] / (n - top)) FROM r WHERE len(s) > 0)
  SELECT p, logdet + 2.0 / (n - top) * p * k * k AS aic FROM r WHERE len(s) = 0),
pick AS (SELECT CAST(greatest(1, arg_min(p, aic)) AS INT) AS p FROM dt),
fc0 AS (SELECT p, k, n, y, rs, list_concat([list_transform(range(p + 1, n + 1), lambda t: 1.0::DOUBLE)],
          list_transform(range(0, k * (p + 1)), lambda j: list_transform(range(p + 1, n + 1), lambda t:
            CASE WHEN j < k * p THEN y[t - 1 - j // k][j % k + 1] ELSE y[t][j - k * p + 1] END))) AS c FROM kk, pick),
sol AS (
  WITH RECURSIVE r AS (
    SELECT 0 AS done, p, k, n, y, rs, list_transform(c[:1 + k * p], lambda a: list_transform(c, lambda b: list_dot_product(a, b))) AS m FROM fc0
    UNION ALL
    SELECT done + 1, p, k, n, y, rs, list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m[1]) + 1), lambda j:
             CASE WHEN i = done + 1 THEN m[i][j] / m[i][i]
                  ELSE m[i][j] - m[i][done + 1] / m[done + 1][done + 1] * m[done + 1][j] END)) FROM r WHERE done < len(m))
  SELECT p, k, n, y, rs, list_transform(m, lambda w: w[len(m) + 1:]) AS b FROM r WHERE done = len(m)),
ahead AS (
  WITH RECURSIVE r AS (
    SELECT 0 AS h, p, k, rs, b, flatten(list_transform(range(0, p), lambda l: y[n - l])) AS hist, []::DOUBLE[] AS new FROM sol
    UNION ALL
    SELECT h + 1, p, k, rs, b, list_concat(new2, hist)[:k * p], new2 FROM (
      SELECT *, list_transform(range(1, k + 1), lambda q: b[1][q] + list_sum(list_transform(range(1, k * p + 1),
                  lambda j: b[j + 1][q] * hist[j]))) AS new2 FROM r WHERE h < 30))
  SELECT * FROM r WHERE h > 0)"""


@register("var_gram", _with(*SQL_EVAL_CHAIN) + SQL_VAR + """
SELECT CAST(i - 1 AS INT) AS i, CAST(j - 1 AS INT) AS j, round(m[i][j], 6) AS v
FROM gg, range(1, 1 + k * (top + 1) + 1) a(i), range(1, 1 + k * (top + 1) + 1) b(j)""")
def var_gram_q(spark, sf_dir):
    """the cross products of the design with seven lags over the common sample."""
    from tripcast.operators.forecast.var import design, gram, vectors
    rows = design(vectors(_train(spark, sf_dir)), 7, 5)
    return r6(gram(rows.where("t >= 7")), "v")


@register("forecast_var", _with(*SQL_EVAL_CHAIN) + SQL_VAR_FIT + """
SELECT 'VAR' AS model, last + h * INTERVAL 1 DAY AS period, rs[q] AS region, round(new[q], 4) AS yhat
FROM ahead, range(1, len(rs) + 1) t(q), (SELECT max(period) AS last FROM train)""")
def forecast_var_q(spark, sf_dir):
    """F9 jointly over the five regions (AIC lag order)."""
    fc = forecast_var(_train(spark, sf_dir), HOLDOUT)[0]
    return fc.withColumn("yhat", F.round("yhat", 4))


@register("forecast_additive", None)
def forecast_additive_q(spark, sf_dir):
    """F10 on the total series."""
    return forecast_additive(_train(spark, sf_dir), HOLDOUT)


@register("forecast_gbt", None)
def forecast_gbt_q(spark, sf_dir):
    """F11 + F12: one global boosted model, recursive by date."""
    return forecast_gbt(_train(spark, sf_dir), HOLDOUT)


@register("forecast_windowed", _with(*SQL_EVAL_CHAIN) + """
, st AS (SELECT avg(CAST(demand AS DOUBLE)) AS mu, stddev_pop(CAST(demand AS DOUBLE)) AS sd FROM train),
s AS (SELECT region, list((demand - mu) / sd ORDER BY period) AS z, max(period) AS last FROM train, st GROUP BY region),
pts AS (SELECT list_concat([1.0::DOUBLE], z[i - 7:i - 1]) AS x, z[i] AS y FROM s, range(8, len(z) + 1) t(i)),
cell AS (SELECT a, b, sum(x[a] * CASE WHEN b <= 8 THEN x[b] ELSE y END) AS v FROM pts, range(1, 9) p(a), range(1, 10) q(b) GROUP BY a, b),
m0 AS (SELECT list(r ORDER BY a) AS m FROM (SELECT a, list(v ORDER BY b) AS r FROM cell GROUP BY a)),
sol AS (
  WITH RECURSIVE r AS (
    SELECT 0 AS done, m FROM m0
    UNION ALL
    SELECT done + 1, list_transform(range(1, 9), lambda i: list_transform(range(1, 10), lambda j:
             CASE WHEN i = done + 1 THEN m[i][j] / m[i][i] ELSE m[i][j] - m[i][done + 1] / m[done + 1][done + 1] * m[done + 1][j] END))
    FROM r WHERE done < 8)
  SELECT list_transform(m, lambda w: w[9]) AS b FROM r WHERE done = 8),
ahead AS (
  WITH RECURSIVE r AS (
    SELECT 0 AS h, region, last, z[len(z) - 6:] AS win, 0.0::DOUBLE AS new, b FROM s, sol
    UNION ALL
    SELECT h + 1, region, last, list_append(win[2:], nxt), nxt, b FROM (
      SELECT *, b[1] + list_sum(list_transform(range(1, 8), lambda i: win[i] * b[i + 1])) AS nxt FROM r WHERE h < 30))
  SELECT * FROM r WHERE h > 0)
SELECT 'Windowed-LR' AS model, region, last + h * INTERVAL 1 DAY AS period, round(greatest(new * sd + mu, 0.0), 4) AS yhat FROM ahead, st""")
def forecast_windowed_q(spark, sf_dir):
    """window-7 global model, recursion as an aggregate() fold."""
    return forecast_windowed(_train(spark, sf_dir), HOLDOUT).withColumn("yhat", F.round("yhat", 4))


@register("recursive_features", _with(*SQL_LINE[:-1]) + """
, h AS (SELECT region, period, CAST(demand AS DOUBLE) AS value FROM lfilled),
step AS (SELECT region, max(period) + INTERVAL 1 DAY AS period FROM lfilled GROUP BY region)
SELECT s.region, s.period, a.value AS lag_1, b.value AS lag_7, c.value AS lag_14
FROM step s LEFT JOIN h a ON a.region = s.region AND a.period = s.period - INTERVAL 1 DAY
            LEFT JOIN h b ON b.region = s.region AND b.period = s.period - INTERVAL 7 DAY
            LEFT JOIN h c ON c.region = s.region AND c.period = s.period - INTERVAL 14 DAY""")
def recursive_features_q(spark, sf_dir):
    """F12, one step: lags of the next day looked up by date in the history."""
    s = line_series(spark, sf_dir)
    hist = s.select("region", "period", F.col("demand").cast("double").alias("value"))
    step = s.groupBy("region").agg((F.max("period") + F.expr("INTERVAL 1 DAY")).alias("period"))
    return recursive_features(hist, step, SCOPE.lags)


@register("clip_forecast", _with(*SQL_EVAL_CHAIN) + """
SELECT model, period, region, greatest(yhat - 3.0, 0.0) AS yhat FROM fc""")
def clip_forecast_q(spark, sf_dir):
    """F16 on a shifted baseline (yhat - 3) so negatives occur."""
    fc = _eval_inputs(spark, sf_dir)[2].withColumn("yhat", F.col("yhat") - 3.0)
    return NV.clip_forecast(fc)


@register("extend_exog", _with(*SQL_EVAL_CHAIN) + """
, ex AS (SELECT region, period, CAST(demand AS DOUBLE) AS x FROM train),
xr AS (SELECT region, period, x, row_number() OVER (PARTITION BY region ORDER BY period DESC) AS rd,
              count(*) OVER (PARTITION BY region) AS n FROM ex)
SELECT f.region, f.period, coalesce(a.x, b.x, 0.0) AS x
FROM fut f LEFT JOIN xr a ON a.region = f.region AND f.n >= 7 AND a.rd = 7 - ((f.h - 1) % 7)
           LEFT JOIN xr b ON b.region = f.region AND b.rd = 1""")
def extend_exog_q(spark, sf_dir):
    """F8: an exogenous column extended over the horizon by the seasonal rule."""
    train = _train(spark, sf_dir).withColumn("x", F.col("demand").cast("double"))
    return NV.extend_exog(train, ["x"], HOLDOUT)


@register("single_series", _with(*SQL_EVAL_CHAIN) + """
SELECT period, CAST(sum(demand) AS DOUBLE) AS y FROM train WHERE region = 'ASIA' GROUP BY period""")
def single_series_q(spark, sf_dir):
    """one region's training series as (period, y)."""
    return SP.single_series(_train(spark, sf_dir), "ASIA")


@register("train_all", None)
def train_all_q(spark, sf_dir):
    """every candidate on the 30-day horizon; exclusions recorded."""
    cands = TR.default_candidates()
    fc, status = TR.train_all(cands, _train(spark, sf_dir), HOLDOUT)
    return fc


@register("model_comparison", None)
def model_comparison_q(spark, sf_dir):
    """E2/E3 over all model families (the reference's comparison run)."""
    from tripcast.plans.jobs import train_and_evaluate
    return train_and_evaluate(line_series(spark, sf_dir), SCOPE)["comparison"]


# ==================================================================== streaming
@register("stream_daily_demand", """
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS period, event_type AS region,
       CAST(count(*) AS BIGINT) AS demand
FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2""")
def stream_daily_demand_q(spark, sf_dir):
    """Events as a file stream; tumbling 1-day window per type, run over
    everything available: days that are over are appended to files in the
    shared folder, the others are read from the state."""
    import uuid
    from tripcast.session import scratch_path
    from tripcast.streaming.incremental import (append_daily_counts, closed_days, daily_counts, open_days,
                                                stream_trips)
    schema = T.table(spark, sf_dir, "events").schema
    s = stream_trips(spark, sf_dir, schema, glob="events.parquet", monthly_names=False)
    s = s.select(F.col("ts").alias("pickup_datetime"), F.col("event_type").alias("region"))
    path = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    append_daily_counts(daily_counts(s, watermark="2 days"), f"{path}/days", f"{path}/checkpoint")
    return closed_days(spark, f"{path}/days").unionByName(open_days(spark, f"{path}/checkpoint"))


# ======================================================== remaining operators
@register("report_lines", """
WITH modal AS (SELECT date_trunc('month', o_orderdate)::DATE AS m FROM orders WHERE o_orderdate IS NOT NULL
               GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
  one AS (SELECT count(*) AS n, count(*) FILTER (WHERE date_trunc('month', o_orderdate) <> m) AS out_n,
                 min(o_orderdate) AS lo, max(o_orderdate) AS hi,
                 [count(*) FILTER (WHERE o_orderkey IS NULL), count(*) FILTER (WHERE o_orderdate IS NULL),
                  count(*) FILTER (WHERE o_custkey IS NULL), count(*) FILTER (WHERE o_totalprice IS NULL OR isnan(o_totalprice))] AS nul
          FROM orders, modal),
  dup AS (SELECT coalesce(sum(c - 1), 0) AS d FROM (SELECT count(*) AS c FROM orders GROUP BY o_orderkey, o_orderdate, o_custkey, o_totalprice)),
  cols AS (SELECT * FROM (VALUES (0, 'row_id', 'bigint'), (1, 'pickup_datetime', 'timestamp_ntz'),
                                 (2, 'PULocationID', 'bigint'), (3, 'base_passenger_fare', 'double')) c(ordinal, key, dtype))
SELECT 'schema' AS section, ordinal, 'column ' || key || ': ' || dtype AS line, 100.0 AS pct_of_rows FROM cols
UNION ALL SELECT 'nulls', ordinal, 'nulls ' || key || ' null_count: ' || format('{:,.2f}', nul[ordinal + 1]::DOUBLE), round(100.0 * nul[ordinal + 1] / n, 6) FROM cols, one
UNION ALL SELECT 'nulls', ordinal, 'nulls ' || key || ' null_pct: ' || format('{:,.2f}', 100.0 * nul[ordinal + 1] / n), round(100.0 * (100.0 * nul[ordinal + 1] / n) / n, 6) FROM cols, one
UNION ALL SELECT 'date_range', 0, 'pickup min: ' || lo, 0.0 FROM one
UNION ALL SELECT 'date_range', 1, 'pickup max: ' || hi, 0.0 FROM one
UNION ALL SELECT 'duplicates', 0, printf('duplicates: %d (%s%% of rows)', d::BIGINT, format('{:,.2f}', 100.0 * d / n)), round(100.0 * d / n, 6) FROM one, dup
UNION ALL SELECT 'violations', 0, printf('violation pickup_outside_stated_month: %d (%s%% of rows)', out_n, format('{:,.2f}', 100.0 * out_n / n)),
       round(100.0 * out_n / n, 6) FROM one WHERE out_n > 0""")
def report_lines_q(spark, sf_dir):
    """Q13: printable lines with percentages of rows over the Q10 report."""
    rep = Q.validation_report(T.trips_orders(spark, sf_dir), order_key="row_id")
    return r6(Q.report_lines(rep), "pct_of_rows")


@register("seed_window", _with(*SQL_TOT_CHAIN[:-1]) + """
, h AS (SELECT region, period, list(CAST(demand AS DOUBLE)) OVER (PARTITION BY region ORDER BY period
                                    ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS hist FROM filled)
SELECT region, period, list_concat(list_transform(range(7 - len(hist)), lambda i: hist[1]), hist) AS win FROM h""")
def seed_window_q(spark, sf_dir):
    """Every day's last-7 history, left-padded with its earliest value
    where the region's history is shorter (the first six days)."""
    from pyspark.sql import Window
    s = demand_series(spark, sf_dir)
    w = Window.partitionBy("region").orderBy("period").rowsBetween(-6, 0)
    h = s.select("region", "period", F.collect_list(F.col("demand").cast("double")).over(w).alias("hist"))
    return h.select("region", "period", W.seed_window(F.col("hist"), 7).alias("win"))


@register("merge_forecasts", _with(*SQL_EVAL_CHAIN) + """
SELECT * FROM fc WHERE model <> 'Naive'
UNION ALL SELECT 'Naive', period, region, yhat + 1.0 FROM fc WHERE model = 'Naive'""")
def merge_forecasts_q(spark, sf_dir):
    """A re-run of one model replaces its rows, the others are kept."""
    from tripcast.sources.files import merge_forecasts
    fc = _eval_inputs(spark, sf_dir)[2]
    new = fc.where(F.col("model") == "Naive").withColumn("yhat", F.col("yhat") + 1.0)
    return merge_forecasts(fc, new)


@register("results_document", _with(*SQL_EVAL_CHAIN) + """
SELECT 'actual' AS kind, 0 AS ordinal, 'actual' AS name, list(strftime(period, '%Y-%m-%d') ORDER BY period) AS "index",
       list(actual ORDER BY period) AS values, CAST(NULL AS VARCHAR) AS excluded_reason FROM act
UNION ALL SELECT 'model', any_value(ordinal), model, list(strftime(period, '%Y-%m-%d') ORDER BY period), list(yhat ORDER BY period), NULL
  FROM ftot JOIN scored ON model_name = model GROUP BY model
UNION ALL SELECT 'carry_forward', CAST(row_number() OVER (ORDER BY mae, rmse, mape, ordinal) AS INT), model_name, []::VARCHAR[], []::DOUBLE[], NULL
  FROM scored""")
def results_document_q(spark, sf_dir):
    """The artifact of the baseline evaluation, written as JSON and read back as records."""
    import uuid
    from tripcast.session import scratch_path
    from tripcast.sources import results as R
    act, ftot, tab = _scored(spark, sf_dir)
    path = scratch_path(spark, f"results-{uuid.uuid4().hex}")
    R.write_results(R.results_document(act, ftot, tab, E.select_carry_forward(tab)), path)
    return spark.read.schema(R.RECORD).json(path)


@register("results_forecasts", _with(*SQL_EVAL_CHAIN) + """
SELECT model, CAST(NULL AS VARCHAR) AS excluded_reason, CAST(row_number() OVER (PARTITION BY model ORDER BY period) - 1 AS INT) AS pos,
       period, yhat FROM ftot""")
def results_forecasts_q(spark, sf_dir):
    """The forecasts read from the stored artifact."""
    import uuid
    from tripcast.session import scratch_path
    from tripcast.sources import results as R
    act, ftot, tab = _scored(spark, sf_dir)
    path = scratch_path(spark, f"results-{uuid.uuid4().hex}")
    R.write_results(R.results_document(act, ftot, tab, E.select_carry_forward(tab)), path)
    return R.read_results(spark, path)[1]


@register("comparison_incomplete", _with(*SQL_EVAL_CHAIN) + """
SELECT ordinal, model_name, CASE WHEN ordinal = 0 THEN round(mae, 6) END AS mae, CASE WHEN ordinal = 0 THEN round(rmse, 6) END AS rmse,
       CASE WHEN ordinal = 0 THEN round(mape, 6) END AS mape, ordinal <> 0 AS excluded,
       CASE WHEN ordinal <> 0 THEN printf('forecast covers %d of %d (period, region) cells',
            (SELECT count(*) FROM hold WHERE region <> 'ASIA'), (SELECT count(*) FROM hold)) END AS excluded_reason FROM scored""")
def comparison_incomplete_q(spark, sf_dir):
    """A model whose forecast lacks a region in every period is not scored."""
    _, hold, fc = _eval_inputs(spark, sf_dir)
    fc = fc.where(~((F.col("model") == BASELINES[1]) & (F.col("region") == "ASIA")))
    table = E.score_models(E.forecast_total(fc, hold.select("period")), E.actual_total(hold), order=BASELINES,
                           coverage=E.forecast_coverage(fc, hold))
    return r6(table, "mae", "rmse", "mape")


@register("train_all_status", _with(*SQL_EVAL_CHAIN) + """
SELECT 'Seasonal-Naive' AS model, CAST(NULL AS VARCHAR) AS region, false AS excluded, CAST(NULL AS VARCHAR) AS reason
UNION ALL SELECT 'Holt-Winters', region, false, NULL FROM (SELECT DISTINCT region FROM train)
UNION ALL SELECT 'VAR', NULL, true, 'ValueError: VAR needs at least 2 regions; got 1'
UNION ALL SELECT 'Broken', NULL, true, 'RuntimeError: no such model'""")
def train_all_status_q(spark, sf_dir):
    """the status of every candidate; failing ones do not stop the others."""
    def broken(train, horizon):
        raise RuntimeError("no such model")
    cands = {"Seasonal-Naive": lambda t, h: NV.seasonal_naive(t, h, 7), "Holt-Winters": forecast_holt_winters,
             "VAR": lambda t, h: forecast_var(t.where("region = 'ASIA'"), h), "Broken": broken}
    return TR.train_all(cands, _train(spark, sf_dir), HOLDOUT)[1]


@register("refresh_job", _with(SQL_LOOKUP, SQL_TRIPS, SQL_COUNTED, SQL_GRID, SQL_FILLED) + """
SELECT count(*) AS rows, count(DISTINCT region) AS regions,
       (SELECT count(*) FILTER (WHERE coalesce(base_passenger_fare < 0, false)) FROM trips) AS handled,
       count(DISTINCT region) AS trained, 'ok' AS status, CAST(NULL AS VARCHAR) AS reason FROM filled""")
def refresh_job_q(spark, sf_dir):
    """prepare -> split -> Holt-Winters -> status row."""
    from tripcast.plans.jobs import refresh_job
    return refresh_job(T.trips_orders(spark, sf_dir), T.zone_lookup_customers(spark, sf_dir), SCOPE,
                       regions=T.region_names(spark, sf_dir))


@register("forecast_user_series", None)
def forecast_user_series_q(spark, sf_dir):
    """the line-item series treated as an uploaded file: contract,
    adaptive split, Holt-Winters score, forward forecast pivot."""
    from tripcast.plans.jobs import forecast_user_series
    s = line_series(spark, sf_dir).select("period", "region", "demand")
    return forecast_user_series(s, SCOPE)["wide"]


@register("anomaly_descriptions", _with(*SQL_TOT_CHAIN[:-1], SQL_ANOM) + """
SELECT region, period, printf('%s on %s: %d trips, local median %d (%s), robust score %+.1f',
         CASE WHEN score > 0 THEN 'spike' ELSE 'drop' END, strftime(period, '%Y-%m-%d'), CAST(value AS BIGINT),
         CAST(floor(expected + 0.5) AS BIGINT), CASE WHEN expected > 0 THEN printf('%+d%% vs local median',
           CAST(round((value - expected) / expected * 100) AS BIGINT)) ELSE 'local level near zero' END,
         round(score, 1)) AS description
FROM sc WHERE abs(score) > 3.5""")
def anomaly_descriptions_q(spark, sf_dir):
    """The plain-language reading of every anomaly per region."""
    a = X.detect_anomalies(X.region_series(series_ckpt(spark, sf_dir)), by=["region"])
    return a.select("region", "period", "description")


# ================================================== month files, ledger, streams
from tripcast.plans import catalog_files as _files  # noqa: E402,F401
