"""Preparation: zone -> region mapping, daily counting, zero-fill, lags.

Plan shape at scale (billions of trips, a few hundred zones, a few regions):

* counting is a hash aggregate whose partial (map-side) half folds every task's
  rows into at most (days x regions) rows before the shuffle, so a hot region
  holding a third of all trips costs nothing extra;
* trips are first counted per (day, zone), and only those counts are joined
  with the de-duplicated lookup, which shrinks the join's input by orders of
  magnitude and removes key skew (each (day, zone) is one row);
* the zero-fill grid is generated (days x regions, <= 731 x regions rows) and
  left-joined; lags use one shared window spec (one exchange + sort).
"""

from __future__ import annotations

from datetime import date
from typing import Iterable, Optional, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from tripcast.functions.columns import day_period, to_ts
from tripcast.operators import quality as Q
from tripcast.params import (DEMAND, LOCATION, LOOKUP_BOROUGH, LOOKUP_ID, PERIOD, PICKUP,
                             REGION, SUPPORTED_TIME_GRAINS, Scope)
from tripcast.session import written


def _lit_ts(d: date):
    return F.lit(d.isoformat()).cast("date").cast("timestamp_ntz")


def dedup_lookup(lookup: DataFrame, id_col: str = LOOKUP_ID, borough_col: str = LOOKUP_BOROUGH,
                 order_col: Optional[str] = None) -> DataFrame:
    """One region per id (no fan-out).  First by ``order_col`` when given,
    otherwise the smallest region name - a deterministic choice."""
    Q.require_columns(lookup, [id_col, borough_col], "zone lookup")
    if order_col:
        return lookup.groupBy(id_col).agg(F.min_by(borough_col, order_col).alias(borough_col))
    return lookup.groupBy(id_col).agg(F.min(borough_col).alias(borough_col))


# --------------------------------------------------------------------------- P1
def map_zones_to_regions(df: DataFrame, lookup: DataFrame, *, location_col: str = LOCATION,
                         id_col: str = LOOKUP_ID, borough_col: str = LOOKUP_BOROUGH,
                         region_col: str = REGION, order_col: Optional[str] = None) -> DataFrame:
    """Left equi-join of trips to their region; unmatched -> NULL region.

    The redundant lookup id is dropped; the trip's own location is kept. The
    de-duplicated lookup is written first, so that Spark knows its size and
    broadcasts a small one instead of shuffling the trips by zone; callers that
    only count use :func:`aggregate_demand_by_zone`.
    """
    Q.require_columns(df, [location_col], "trips")
    small = written(dedup_lookup(lookup, id_col, borough_col, order_col), "zone-lookup")
    small = small.select(F.col(id_col).alias("__zid"), F.col(borough_col).alias(region_col))
    out = df.join(small, df[location_col] == small["__zid"], "left").drop("__zid")
    return out


# --------------------------------------------------------------------------- P2
def truncate_to_grain(c, time_grain: str = "daily"):
    """Period start for ``time_grain``; only 'daily' exists.  Bad values -> NULL."""
    if time_grain not in SUPPORTED_TIME_GRAINS:
        raise ValueError(f"Unsupported time grain {time_grain!r}; supported: "
                         f"{list(SUPPORTED_TIME_GRAINS)}")
    return day_period(c)


# --------------------------------------------------------------------------- P3
def aggregate_demand(df: DataFrame, scope: Scope | None = None, *, ts_col: str = PICKUP,
                     region_col: str = REGION) -> DataFrame:
    """Trips per (period, region); rows with a NULL period or region are left out."""
    Q.require_columns(df, [ts_col, region_col], "trips")
    grain = scope.time_grain if scope else "daily"
    return (df.select(truncate_to_grain(F.col(ts_col), grain).alias(PERIOD),
                      F.col(region_col).cast("string").alias(REGION))
              .where(F.col(PERIOD).isNotNull() & F.col(REGION).isNotNull())
              .groupBy(PERIOD, REGION).agg(F.count(F.lit(1)).cast("long").alias(DEMAND)))


def aggregate_demand_by_zone(df: DataFrame, lookup: DataFrame, scope: Scope | None = None, *,
                             ts_col: str = PICKUP, location_col: str = LOCATION,
                             id_col: str = LOOKUP_ID, borough_col: str = LOOKUP_BOROUGH) -> DataFrame:
    """P1 + P3 fused: trips are counted per (period, zone) map-side, only the
    counts are joined with the de-duplicated lookup (Spark picks the join by
    real sizes), and summed per region.  Gives exactly the P1 -> P3 result.
    """
    grain = scope.time_grain if scope else "daily"
    small = dedup_lookup(lookup, id_col, borough_col)
    per_zone = (df.select(truncate_to_grain(F.col(ts_col), grain).alias(PERIOD),
                          F.col(location_col).alias("__zid"))
                  .where(F.col(PERIOD).isNotNull() & F.col("__zid").isNotNull())
                  .groupBy(PERIOD, "__zid").agg(F.count(F.lit(1)).alias("__n")))
    joined = per_zone.join(small.select(F.col(id_col).alias("__zid"),
                                        F.col(borough_col).cast("string").alias(REGION)), "__zid")
    return (joined.where(F.col(REGION).isNotNull()).groupBy(PERIOD, REGION)
                  .agg(F.sum("__n").cast("long").alias(DEMAND)))


def within_window(df: DataFrame, scope: Scope, ts_col: str = PICKUP) -> DataFrame:
    """Keep trips whose pickup falls inside the analysis window.

    The zero-fill drops everything outside the window anyway; filtering on the
    raw timestamp column first lets the Parquet reader skip row groups / files
    outside the window (the bounds reach ``PushedFilters``).
    """
    lo = F.lit(scope.window_start.isoformat()).cast("timestamp_ntz")
    hi = F.lit(scope.window_end.isoformat()).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
    c = F.col(ts_col)
    if isinstance(df.schema[ts_col].dataType, TimestampNTZType):
        return df.where((c >= lo) & (c < hi))
    t = to_ts(c)
    return df.where((t >= lo) & (t < hi))


# --------------------------------------------------------------------------- P5
def period_axis(spark, start: date, end: date) -> DataFrame:
    """One row per day of the inclusive window (TIMESTAMP_NTZ, zone free)."""
    return spark.range(1).select(F.explode(F.sequence(
        _lit_ts(start), _lit_ts(end), F.expr("INTERVAL 1 DAY"))).alias(PERIOD))


def period_region_grid(spark, scope: Scope, regions: DataFrame) -> DataFrame:
    """Every (period, region) of the window.

    ``regions`` is a one-column frame of region names; the grid is built by
    exploding the day sequence per region - no cartesian join - and holds
    (window days <= 731) x regions rows.
    """
    days = F.sequence(_lit_ts(scope.window_start), _lit_ts(scope.window_end),
                      F.expr("INTERVAL 1 DAY"))
    return (regions.select(F.col(regions.columns[0]).cast("string").alias(REGION))
                   .where(F.col(REGION).isNotNull()).distinct()
                   .select(F.explode(days).alias(PERIOD), REGION))


# --------------------------------------------------------------------------- P6
def fill_missing_periods(series: DataFrame, scope: Scope,
                         regions: Optional[DataFrame | Sequence[str]] = None) -> DataFrame:
    """Zero-fill to the complete (period, region) grid of the window.

    Observed duplicates are summed; rows outside the window or region list
    vanish (as in the reference).  ``regions`` defaults to the observed ones.
    """
    Q.require_columns(series, [PERIOD, REGION, DEMAND], "series")
    spark = series.sparkSession
    if regions is None:
        reg = series.select(REGION)
    elif isinstance(regions, DataFrame):
        reg = regions
    else:
        reg = spark.createDataFrame([(r,) for r in dict.fromkeys(regions)], f"{REGION} string")
    grid = period_region_grid(spark, scope, reg)
    # keep the key expressions untouched when they already have the right
    # type, so the collapse reuses the upstream aggregate's partitioning
    pcol = F.col(PERIOD) if isinstance(series.schema[PERIOD].dataType, TimestampNTZType) \
        else to_ts(F.col(PERIOD)).alias(PERIOD)
    obs = (series.select(pcol, F.col(REGION).cast("string").alias(REGION), F.col(DEMAND))
                 .groupBy(PERIOD, REGION).agg(F.sum(DEMAND).alias(DEMAND)))
    return (grid.join(obs, [PERIOD, REGION], "left")
                .select(PERIOD, REGION, F.coalesce(F.col(DEMAND), F.lit(0)).cast("long").alias(DEMAND)))


# --------------------------------------------------------------------------- W1
def _check_lags(lags) -> list[int]:
    out = []
    for k in lags:
        if isinstance(k, bool) or not isinstance(k, int) or k <= 0:
            raise ValueError(f"lags must be positive integers; got {k!r}")
        if k not in out:
            out.append(k)
    return sorted(out)


def add_lag_features(series: DataFrame, lags: Iterable[int] = (1, 7, 14), *,
                     region_col: str = REGION, period_col: str = PERIOD,
                     value_col: str = DEMAND) -> DataFrame:
    """``lag_k = value k rows earlier in the same region`` (NULL for the first k).

    All lags share one window spec, so the plan has one exchange and one sort.
    """
    Q.require_columns(series, [region_col, period_col, value_col], "series")
    ks = _check_lags(list(lags))
    w = Window.partitionBy(region_col).orderBy(period_col)
    return series.select("*", *[F.lag(value_col, k).over(w).cast("double").alias(f"lag_{k}")
                                for k in ks])


# --------------------------------------------------------------------------- P7
def combine_partials(*partials: DataFrame) -> DataFrame:
    """Union of partial (period, region, demand) tables, overlapping buckets re-summed."""
    from functools import reduce
    u = reduce(lambda a, b: a.unionByName(b), [p.select(PERIOD, REGION, DEMAND) for p in partials])
    return u.groupBy(PERIOD, REGION).agg(F.sum(DEMAND).cast("long").alias(DEMAND))


# --------------------------------------------------------------------------- P8
def prepare(trips: DataFrame, lookup: DataFrame, scope: Scope, *,
            regions: Optional[DataFrame | Sequence[str]] = None,
            stated_month="infer", month_col: Optional[str] = None,
            non_negative_columns=None, ts_col: str = PICKUP,
            location_col: str = LOCATION, audit: bool = False, observe: bool = False):
    """Q14 -> P1 -> P3 -> P6 -> W1 as one lazy plan.

    Returns ``(series, handling_log, stages)``.  ``stages`` is

    * ``audit=True``: a DataFrame (P9) of row counts + samples per stage, each
      count its own aggregate;
    * ``observe=True``: a dict of ``pyspark.sql.Observation`` per stage - the
      counts are collected *during* the job that computes the series (no
      extra scan of the raw table), readable after that job ran;
    * otherwise ``None``.

    ``stated_month='infer'`` keeps the reference's modal-month rule; pass
    ``month_col`` (a per-row month from the source file) for multi-month
    input, or ``None`` to skip the check.
    """
    obs = {}

    def watch(name, df):
        if not observe:
            return df
        from pyspark.sql import Observation
        obs[name] = Observation(f"stage_{name}")
        return df.observe(obs[name], F.count(F.lit(1)).alias("rows"))
    trips = watch("raw", trips)
    clean, log = Q.apply_validity_rules(trips, ts_col=ts_col, stated_month=stated_month,
                                        non_negative_columns=non_negative_columns,
                                        month_col=month_col)
    clean = watch("clean", clean)
    counted = aggregate_demand_by_zone(within_window(clean, scope, ts_col), lookup, scope,
                                       ts_col=ts_col, location_col=location_col)
    counted = watch("counted", counted)
    filled = fill_missing_periods(counted, scope, regions)
    series = watch("series", add_lag_features(filled, scope.lags))
    if observe:
        return series, log, obs
    stages = None
    if audit:
        # the counted and final stages are read from the one pass that counts
        kept = written(counted, "audit-counted")
        final = add_lag_features(fill_missing_periods(kept, scope, regions), scope.lags)
        stages = stage_audit([("raw", trips), ("clean", clean), ("counted", kept), ("series", final)])
    return series, log, stages


def observed_counts(obs: dict) -> dict:
    """``{stage: rows}`` from :func:`prepare` observations (after the job ran);
    without the stages that the optimizer proved not to be needed, as where the
    lookup is statically empty: they had nothing to observe."""
    found = {}
    for stage, o in obs.items():
        try:
            found[stage] = int(o.get["rows"])
        except Py4JJavaError:  # an observation that no plan carried out
            pass
    return found


# --------------------------------------------------------------------------- P9
def stage_audit(stages: Sequence[tuple[str, DataFrame]], sample_keys: Optional[dict] = None,
                n: int = 5) -> DataFrame:
    """Row count per stage plus a 5-row sample (first rows by the stage's
    columns), as rows ``(ordinal, stage, rows, sample ARRAY<STRING>)``.

    One pass per stage: the sample is a bounded top-n (no sort of the stage),
    and the rows that pass by are counted by an Observation.
    """
    from pyspark.sql import Observation
    found = []
    for i, (name, df) in enumerate(stages):
        keys = (sample_keys or {}).get(name) or df.columns
        seen = Observation()
        first = (df.observe(seen, F.count(F.lit(1)).alias("rows"))
                   .orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in keys]).limit(n)
                   .select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
        sample = [r[0] for r in first.collect()]  # n rows
        found.append((i, name, int(seen.get["rows"]), sample))
    return stages[0][1].sparkSession.createDataFrame(
        found, "ordinal int, stage string, rows long, sample array<string>")
