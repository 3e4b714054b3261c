"""End-to-end jobs: series build, training/evaluation, refresh, user series."""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripcast.operators import prepare as P
from tripcast.operators import quality as Q
from tripcast.params import Scope
from tripcast.session import written


def build_series(trips: DataFrame, lookup: DataFrame, scope: Scope, *,
                 regions: Optional[DataFrame | Sequence[str]] = None,
                 month_col: Optional[str] = None) -> DataFrame:
    """The series build over all (monthly) trip files in one job.

    The month rule uses ``month_col`` (the stated month of each row's file,
    e.g. from :func:`tripcast.sources.files.read_month_files`) when given;
    negative measures are always dropped.  Counting is P1 + P3 fused
    (per day and zone before the join); then P6 + W1.
    """
    clean, _ = Q.apply_validity_rules(trips, stated_month=None, month_col=month_col)
    if month_col:
        clean = clean.drop(month_col)
    counted = P.aggregate_demand_by_zone(P.within_window(clean, scope), lookup, scope)
    return P.add_lag_features(P.fill_missing_periods(counted, scope, regions), scope.lags)


def build_report(trips: DataFrame, lookup: DataFrame, month_col: str = "stated_month") -> DataFrame:
    """Per stated month (file): rows read, rows dropped by the validity rules,
    trips with a region (what the series counts before the window filter).
    One grouped aggregate over the same scan as the build."""
    masks = Q.violation_masks(trips, stated_month=None, month_col=month_col)
    bad = F.lit(False)
    for _, m in masks:
        bad = bad | m
    small = P.dedup_lookup(lookup).select(F.col("LocationID").alias("__zid"), F.col("Borough").alias("__reg"))
    # counted per (month, zone) map-side; only those counts meet the lookup
    per_zone = trips.groupBy(F.col(month_col).alias("month"), F.col("PULocationID").alias("__loc")).agg(
        F.count(F.lit(1)).alias("__rows"), F.count_if(bad).alias("__bad"),
        F.count_if(~bad & F.col("pickup_datetime").isNotNull()).alias("__ok"))
    return (per_zone.join(small, F.col("__loc") == F.col("__zid"), "left").groupBy("month")
                    .agg(F.sum("__rows").cast("long").alias("rows"),
                         F.sum("__bad").cast("long").alias("dropped"),
                         F.coalesce(F.sum(F.when(F.col("__reg").isNotNull(), F.col("__ok"))), F.lit(0))
                         .cast("long").alias("counted")))


def monthly_partials(trips: DataFrame, lookup: DataFrame, scope: Scope,
                     month_col: str = "stated_month") -> DataFrame:
    """Per-file partial counts ``(month, period, region, demand)`` (S11 input)."""
    clean, _ = Q.apply_validity_rules(trips, stated_month=None, month_col=month_col)
    small = P.dedup_lookup(lookup)
    small = small.select(F.col("LocationID").alias("__zid"), F.col("Borough").alias("region"))
    per_zone = (clean.select(F.col(month_col).alias("month"), F.col("PULocationID").alias("__loc"),
                             P.truncate_to_grain(F.col("pickup_datetime")).alias("period"))
                     .where("period IS NOT NULL").groupBy("month", "period", "__loc").agg(F.count(F.lit(1)).alias("__n")))
    return (per_zone.join(small, F.col("__loc") == F.col("__zid")).where("region IS NOT NULL")
                    .groupBy("month", "period", "region").agg(F.sum("__n").cast("long").alias("demand")))


# ------------------------------------------------------------ train / evaluate
def train_and_evaluate(series: DataFrame, scope: Scope, candidates=None, gbt_params=None):
    """F1 -> F3 -> P13 -> E2/E3 -> E6 -> B1-B3 for a prepared series.

    Returns a dict of DataFrames: forecasts, status, actual, forecast_total,
    comparison, carry_forward, placements, recommendation, impact.
    """
    from tripcast.operators import evaluate as E
    from tripcast.operators import position as B
    from tripcast.operators.forecast.split import split_holdout
    from tripcast.operators.forecast.train import default_candidates, model_status, train_all
    # read by every model and score: the trips are counted once
    base = written(series.select("period", "region", "demand"), "series")
    train, hold = split_holdout(base, scope.holdout_periods)
    cands = candidates or default_candidates(gbt_params)
    fc, status = train_all(cands, train, scope.holdout_periods)
    act = E.actual_total(hold)
    ftot = E.forecast_total(fc, hold.select("period"))
    st = model_status(status)
    table = E.score_models(ftot, act, st, order=list(cands), coverage=E.forecast_coverage(fc, hold))
    cf = E.select_carry_forward(table)
    best = E.best_model(table).select("model_name").first()
    chosen = fc.where(F.col("model") == (best["model_name"] if best else ""))
    rec = B.positioning_recommendation(chosen)
    return {"forecasts": fc, "status": status, "actual": act, "forecast_total": ftot,
            "comparison": table, "carry_forward": cf, "placements": B.placements(chosen),
            "recommendation": rec, "impact": B.quantify_impact(rec)}


# ------------------------------------------------------------------ F15 refresh
def refresh_job(trips: DataFrame, lookup: DataFrame, scope: Scope, *, regions=None) -> DataFrame:
    """Lightweight refresh: prepare -> split -> Holt-Winters -> one status row
    ``(rows, regions, handled, trained, status, reason)``; no trained model =
    failure, with the reason. One pass over the trips: the rows handled are
    counted by observations while the series is built."""
    from tripcast.operators.forecast.smoothing import forecast_holt_winters
    from tripcast.operators.forecast.split import split_holdout
    series, log, seen = P.prepare(trips, lookup, scope, regions=regions, stated_month=None, observe=True)
    base = written(series.select("period", "region", "demand"), "refresh-series")
    counts = P.observed_counts(seen)
    spark, reason = trips.sparkSession, None
    try:
        train, _ = split_holdout(base, scope.holdout_periods)
        _, st = forecast_holt_winters(train, scope.holdout_periods)
        outcome = st.agg(F.count_if(~F.col("excluded")).alias("trained"),
                         F.min(F.when(F.col("excluded"), F.col("reason"))).alias("reason")).first()
        trained = outcome["trained"]
        reason = outcome["reason"] if not trained else None
    except ValueError as e:
        trained, reason = 0, f"{type(e).__name__}: {e}"
    k = base.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("region").alias("regions")).first()
    status = "ok" if trained > 0 else "failed"
    seen_both = {"raw", "clean"} <= set(counts)  # else the plan had no use for the trips; count them on their own
    handled = counts["raw"] - counts["clean"] if seen_both else log.first()["total_invalid_handled"]
    return spark.createDataFrame([(k["rows"], k["regions"], handled, trained, status, reason)],
                                 "rows long, regions long, handled long, trained long, status string, reason string")


# ----------------------------------------------------------- F14 user series
def adaptive_sizes(n_periods: int):
    """Holdout h = max(1, min(30, n//4)), forward = min(14, max(7, n//4)); n < 4 -> None."""
    if n_periods < 4:
        return None
    return max(1, min(30, n_periods // 4)), min(14, max(7, n_periods // 4))


def forecast_user_series(series: DataFrame, scope: Scope):
    """Q12 contract -> adaptive split -> Holt-Winters -> E1, then a refit on the
    whole series for the forward horizon -> B1/B2 -> P12 pivot."""
    from tripcast.operators import evaluate as E
    from tripcast.operators import position as B
    from tripcast.operators.explore import forecast_wide
    from tripcast.operators.forecast.smoothing import forecast_holt_winters
    from tripcast.operators.forecast.split import split_holdout
    verdict = Q.check_contract(series).first()
    if not verdict["ok"]:
        raise ValueError(verdict["error"])
    s = series.select(F.col("period").cast("timestamp_ntz").alias("period"), "region",
                      F.col("demand").cast("long").alias("demand"))
    n = s.select("period").distinct().count()  # bounded by the window
    sizes = adaptive_sizes(n)
    if sizes is None:
        raise ValueError(f"need at least 4 periods to forecast; got {n}")
    h, forward = sizes
    train, hold = split_holdout(s, h)
    fc, _ = forecast_holt_winters(train, h)
    act = E.actual_total(hold)
    metrics = E.score_models(E.forecast_total(fc, hold.select("period")), act, coverage=E.forecast_coverage(fc, hold))
    fwd, _ = forecast_holt_winters(s, forward)
    return {"metrics": metrics, "forward": fwd, "recommendation": B.positioning_recommendation(fwd),
            "wide": forecast_wide(fwd)}
