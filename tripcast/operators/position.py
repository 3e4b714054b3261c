"""Per-period placements, the headline recommendation and its impact."""

from __future__ import annotations

from typing import Mapping, Optional

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripcast.functions.columns import epoch_seconds
from tripcast.params import PERIOD, REGION

# Fixed values that must equal the reference's behaviour (planning assumptions).
DEFAULT_IMPACT_ASSUMPTIONS = {
    "baseline_wait_minutes": 6.0,
    "wait_reduction_pct": 0.30,
    "baseline_idle_minutes": 12.0,
    "idle_reduction_pct": 0.25,
    "trips_per_driver": 8.0,
}
# Fixed values that must equal the reference's behaviour: the action texts.
ACTION_NONE = "No forecast values available; cannot derive a positioning recommendation."
ACTION_TEMPLATE = ("Position more drivers in %s (%s) for period %s: predicted demand is %.0f trips, "
                   "the peak across the forecast horizon. Rebalance idle drivers toward the top "
                   "predicted-demand %s in each period.")
IMPACT_FORMULA = (
    "drivers_positioned = predicted_demand / trips_per_driver; "
    "rider_wait_minutes_saved = predicted_demand * baseline_wait_minutes * wait_reduction_pct; "
    "driver_idle_minutes_saved = drivers_positioned * baseline_idle_minutes * idle_reduction_pct; "
    "total_minutes_saved = rider_wait_minutes_saved + driver_idle_minutes_saved"
)


# --------------------------------------------------------------------------- B1
def placements(fc: DataFrame, by: tuple = ("model",)) -> DataFrame:
    """Top region per period (grouped top-1); ties go to the first region in
    (period, region) order.  ``row_number`` instead of ``max_by`` because the
    latter keeps the last row on a tie."""
    keys = [c for c in by if c in fc.columns]
    w = Window.partitionBy(*keys, PERIOD).orderBy(F.desc("yhat"), F.asc_nulls_first(REGION))
    return (fc.withColumn("__r", F.row_number().over(w)).where("__r = 1")
              .select(*keys, PERIOD, REGION, F.col("yhat").alias("predicted_demand")))


# --------------------------------------------------------------------------- B2
def positioning_recommendation(fc: DataFrame, geographic_grain: str = "borough",
                               by: tuple = ("model",)) -> DataFrame:
    """Global peak of the placements plus the action text.

    An empty forecast still yields one row (NULL region/period, demand 0):
    the peak is an aggregate (``max_by``) rather than a limit, so a group-less
    aggregate always returns a row.
    """
    p = placements(fc, by)
    keys = [c for c in by if c in fc.columns]
    order = F.struct(F.col("predicted_demand"), -epoch_seconds(F.col(PERIOD)))
    agg = p.groupBy(*keys).agg(F.max_by(REGION, order).alias(REGION), F.max_by(PERIOD, order).alias(PERIOD),
                               F.max("predicted_demand").alias("predicted_demand"),
                               F.count(F.lit(1)).cast("long").alias("n_placements"))
    where = F.coalesce(F.col(REGION), F.lit("the highest-demand area"))
    action = F.when(F.col(PERIOD).isNull(), F.lit(ACTION_NONE)).otherwise(
        F.format_string(ACTION_TEMPLATE, where, F.lit(geographic_grain), F.col(PERIOD).cast("string"),
                        "predicted_demand", F.lit(geographic_grain)))
    return agg.select(*keys, REGION, PERIOD,
                      F.coalesce("predicted_demand", F.lit(0.0)).alias("predicted_demand"),
                      F.coalesce("n_placements", F.lit(0)).alias("n_placements"), action.alias("action"))


# --------------------------------------------------------------------------- B3
def effective_assumptions(assumptions: Optional[Mapping[str, float]] = None) -> dict:
    eff = dict(DEFAULT_IMPACT_ASSUMPTIONS)
    eff.update({k: float(v) for k, v in (assumptions or {}).items()})
    if eff["trips_per_driver"] <= 0:
        raise ValueError("Assumption 'trips_per_driver' must be positive to convert predicted demand "
                         f"into a driver count; got {eff['trips_per_driver']}.")
    return eff


def quantify_impact(df: DataFrame, assumptions: Optional[Mapping[str, float]] = None,
                    demand_col: str = "predicted_demand") -> DataFrame:
    """Impact columns for every row (peak or each placement), with the
    effective assumptions as a MAP column and the formula text."""
    a = effective_assumptions(assumptions)
    d = F.col(demand_col).cast("double")
    drivers = d / F.lit(a["trips_per_driver"])
    wait = d * F.lit(a["baseline_wait_minutes"]) * F.lit(a["wait_reduction_pct"])
    idle = drivers * F.lit(a["baseline_idle_minutes"]) * F.lit(a["idle_reduction_pct"])
    amap = F.create_map(*[x for k, v in sorted(a.items()) for x in (F.lit(k), F.lit(v))])
    return df.select("*", drivers.alias("drivers_positioned"), wait.alias("rider_wait_minutes_saved"),
                     idle.alias("driver_idle_minutes_saved"), (wait + idle).alias("total_minutes_saved"),
                     amap.alias("assumptions"), F.lit(IMPACT_FORMULA).alias("formula"))


def quantify_impact_rows(df: DataFrame, demand_col: str = "predicted_demand",
                         assumptions_col: str = "assumptions") -> DataFrame:
    """B3 with per-row assumption maps (missing keys fall back to defaults)."""
    def get(k):
        return F.coalesce(F.col(assumptions_col)[k], F.lit(DEFAULT_IMPACT_ASSUMPTIONS[k]))
    d = F.col(demand_col).cast("double")
    tpd = get("trips_per_driver")
    drivers = F.when(tpd > 0, d / tpd)
    wait = d * get("baseline_wait_minutes") * get("wait_reduction_pct")
    idle = drivers * get("baseline_idle_minutes") * get("idle_reduction_pct")
    return df.select("*", drivers.alias("drivers_positioned"), wait.alias("rider_wait_minutes_saved"),
                     idle.alias("driver_idle_minutes_saved"), (wait + idle).alias("total_minutes_saved"))


# --------------------------------------------------------------------------- B4
def check_impact(impact: DataFrame, assumptions: Optional[Mapping[str, float]] = None,
                 tol: float = 1e-6) -> DataFrame:
    """Recompute the total in a second expression and compare."""
    a = effective_assumptions(assumptions)
    d = F.col("predicted_demand").cast("double")
    again = d * a["baseline_wait_minutes"] * a["wait_reduction_pct"] + \
        d / a["trips_per_driver"] * a["baseline_idle_minutes"] * a["idle_reduction_pct"]
    return impact.agg(F.count(F.lit(1)).cast("long").alias("rows"),
                      F.count_if(F.abs(F.col("total_minutes_saved") - again) >= tol).cast("long")
                      .alias("mismatches"))
