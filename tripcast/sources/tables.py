"""The driver's TPC-H-like tables presented in the engine's input shapes.

* trips (sparse)   : orders   -> pickup_datetime, PULocationID, fare
* zone lookup      : customer x nation x region -> LocationID, Borough
* trips (denser)   : lineitem -> pickup_datetime, PULocationID (= supplier)
* supplier lookup  : supplier x nation x region -> LocationID, Borough
* trips (intraday) : events   -> pickup_datetime, region (= event_type)

``nation`` (25 rows) and ``region`` (5 rows) have a fixed size in TPC-H at
every scale factor, so they are broadcast; customer / supplier grow with the
data and are never broadcast blindly.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripcast.params import LOCATION, LOOKUP_BOROUGH, LOOKUP_ID, PICKUP


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _nation_region(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    # both sides are fixed-size TPC-H dimensions (25 and 5 rows)
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey) \
            .select("n_nationkey", "r_name")


def trips_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse trips: one order = one trip."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_orderdate").alias(PICKUP),
        F.col("o_custkey").alias(LOCATION),
        F.col("o_totalprice").alias("base_passenger_fare"),
    )


def trips_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Denser trips: one line item = one trip, located at its supplier."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias(PICKUP),
        F.col("l_suppkey").alias(LOCATION),
        F.col("l_extendedprice").alias("base_passenger_fare"),
        F.col("l_quantity").alias("trip_miles"),
    )


def trips_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intraday trips with the region already attached (event_type)."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"),
        F.col("ts").alias(PICKUP),
        F.col("event_type").alias("region"),
        F.col("value").alias("base_passenger_fare"),
        F.col("user_id").alias(LOCATION),
    )


def zone_lookup_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nr = _nation_region(spark, sf_dir)
    return c.join(F.broadcast(nr), c.c_nationkey == nr.n_nationkey).select(
        F.col("c_custkey").alias(LOOKUP_ID), F.col("r_name").alias(LOOKUP_BOROUGH))


def zone_lookup_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nr = _nation_region(spark, sf_dir)
    return s.join(F.broadcast(nr), s.s_nationkey == nr.n_nationkey).select(
        F.col("s_suppkey").alias(LOOKUP_ID), F.col("r_name").alias(LOOKUP_BOROUGH))


def region_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("region"))
