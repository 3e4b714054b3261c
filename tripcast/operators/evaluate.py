"""Scoring, comparison, ranking and carry-forward selection.

Forecasts of every model share one long schema
``(model, period, region [NULL = total], yhat)``; scoring is a join on
period plus grouped aggregates, so any number of models is one plan.
"""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripcast.functions.columns import lit_ntz
from tripcast.params import DEMAND, PERIOD, REGION

# Fixed values that must equal the reference's behaviour.
CARRY_FORWARD_MIN = 3
CARRY_FORWARD_MAX = 5
METRIC_COLUMNS = ("mae", "rmse", "mape")


# --------------------------------------------------------------------------- P13
def forecast_total(fc: DataFrame, holdout_periods: DataFrame) -> DataFrame:
    """Every model reduced to a total per holdout period; missing -> 0.

    ``holdout_periods`` has one column ``period``.  The (model x period) frame
    is built by exploding the period list per model (both small: horizon and
    model count), never by a cartesian join.
    """
    periods = holdout_periods.select(PERIOD).distinct().agg(F.collect_list(PERIOD).alias("__ps"))
    models = fc.select("model").distinct()
    tot = fc.groupBy("model", PERIOD).agg(F.sum("yhat").alias("yhat"))
    ps = periods.first()["__ps"] or []  # horizon-sized list (tens of values)
    grid = models.select("model", F.explode(F.array(*[lit_ntz(p) for p in ps])
                                            if ps else F.array().cast("array<timestamp_ntz>")).alias(PERIOD))
    return grid.join(tot, ["model", PERIOD], "left").select(
        "model", PERIOD, F.coalesce("yhat", F.lit(0.0)).cast("double").alias("yhat"))


def actual_total(holdout: DataFrame, value_col: str = DEMAND) -> DataFrame:
    return holdout.groupBy(PERIOD).agg(F.sum(value_col).cast("double").alias("actual"))


# --------------------------------------------------------------------------- E1
def metric_aggs(actual: str = "actual", forecast: str = "yhat"):
    """MAE, RMSE, MAPE (zero actuals left out of MAPE; all zero -> 0.0)."""
    e = F.col(forecast) - F.col(actual)
    ape = F.when(F.col(actual) != 0, F.abs(e) / F.abs(F.col(actual)))
    return [F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
            F.coalesce(F.avg(ape) * 100.0, F.lit(0.0)).alias("mape")]


def error_metrics(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """E1 over aligned ``(actual, yhat)`` rows, optionally grouped."""
    return pairs.groupBy(*by).agg(*metric_aggs(), F.count(F.lit(1)).cast("long").alias("n"))


# --------------------------------------------------------------------------- E2/E3
def forecast_coverage(fc: DataFrame, holdout: DataFrame) -> DataFrame:
    """Per model: ``covered`` of the ``expected`` (period, region) cells of the
    holdout. A forecast of the total (region NULL) has a cell per period."""
    cells = holdout.select(PERIOD, REGION).distinct()
    size = cells.agg(F.count(F.lit(1)).alias("cells"), F.count_distinct(PERIOD).alias("periods")).first()  # two scalars
    asked = fc.where(F.col("yhat").isNotNull() & ~F.isnan("yhat")).select("model", PERIOD, REGION).distinct()
    by_cell = asked.join(cells.withColumn("__hit", F.lit(1)), [PERIOD, REGION], "left")
    whole = asked.where(F.col(REGION).isNull()).join(cells.select(PERIOD).distinct(), PERIOD).groupBy("model").agg(
        F.count(F.lit(1)).alias("n"))
    found = by_cell.groupBy("model").agg(F.count("__hit").alias("covered"))
    both = fc.select("model").distinct().join(found, "model", "left").join(whole, "model", "left")
    return both.select("model", F.coalesce("n", "covered", F.lit(0)).cast("long").alias("covered"),
                       F.when(F.col("n").isNotNull(), F.lit(size["periods"])).otherwise(F.lit(size["cells"]))
                       .cast("long").alias("expected"))


def score_models(fc_total: DataFrame, actual: DataFrame, status: Optional[DataFrame] = None,
                 order: Optional[Sequence[str]] = None, coverage: Optional[DataFrame] = None) -> DataFrame:
    """E2 + E3: one row per model with metrics, ``excluded`` and a reason.

    A model is scored only when it covers every holdout period and, given the
    ``coverage`` of its forecasts, every (period, region); otherwise it stays in
    the table with NULL metrics and the reason.  ``status`` rows
    (model, excluded, reason) from training are kept via a full outer join.
    ``order`` gives the ``ordinal`` (input order) column.
    """
    n_expected = actual.count()  # horizon-sized
    j = fc_total.join(actual, PERIOD)
    scored = j.groupBy("model").agg(*metric_aggs(), F.count_distinct(PERIOD).alias("__n"))
    aligned = F.col("__n") == n_expected
    scored = scored.select(
        "model", *[F.when(aligned, F.col(c)).alias(c) for c in METRIC_COLUMNS],
        F.when(~aligned, F.format_string("forecast covers %d of %d holdout periods", "__n",
                                         F.lit(n_expected))).alias("__why"))
    if coverage is not None:
        short = coverage.where("covered < expected").select("model", F.format_string(
            "forecast covers %d of %d (period, region) cells", "covered", "expected").alias("__short"))
        scored = scored.join(short, "model", "left").select(
            "model", *[F.when(F.col("__short").isNull(), F.col(c)).alias(c) for c in METRIC_COLUMNS],
            F.coalesce("__why", "__short").alias("__why"))
    if status is not None:
        st = status.groupBy("model").agg(F.bool_or("excluded").alias("__ex"),
                                         F.max("reason").alias("__reason"))
        scored = scored.join(st, "model", "full")
    else:
        scored = scored.withColumn("__ex", F.lit(False)).withColumn("__reason", F.lit(None).cast("string"))
    out = scored.select(
        F.col("model").alias("model_name"), *METRIC_COLUMNS,
        (F.coalesce("__ex", F.lit(False)) | F.col("mae").isNull()).alias("excluded"),
        F.when(F.coalesce("__ex", F.lit(False)), F.col("__reason"))
         .otherwise(F.coalesce(F.col("__why"), F.when(F.col("mae").isNull(),
                                                      F.lit("no forecast produced"))))
         .alias("excluded_reason"))
    out = out.withColumn("mae", F.when(~F.col("excluded"), F.col("mae"))) \
             .withColumn("rmse", F.when(~F.col("excluded"), F.col("rmse"))) \
             .withColumn("mape", F.when(~F.col("excluded"), F.col("mape")))
    if order:
        idx = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model_name")).cast("int")
        out = out.withColumn("ordinal", F.when(idx > 0, idx - 1).otherwise(F.lit(len(order))))
    else:
        out = out.withColumn("ordinal", F.dense_rank().over(Window.orderBy("model_name")) - 1)
    return out.select("ordinal", "model_name", *METRIC_COLUMNS, "excluded", "excluded_reason")


comparison_table = score_models


# --------------------------------------------------------------------------- E4/E5
def leaderboard(table: DataFrame) -> DataFrame:
    """By MAE ascending, unscored last, then input order; explicit rank."""
    w = Window.orderBy(F.asc_nulls_last("mae"), "ordinal")
    return table.withColumn("rank", F.row_number().over(w))


def best_model(table: DataFrame) -> DataFrame:
    """E5: the top scored model (a top-1 plan)."""
    return table.where(F.col("mae").isNotNull()).orderBy("mae", "ordinal").limit(1)


# --------------------------------------------------------------------------- E6/E7
def select_carry_forward(table: DataFrame) -> DataFrame:
    """Rank names by (scored first, mae, rmse, mape, ordinal), de-duplicated
    by name; keep k = min(clamp(#scored, 3, 5), #names).  The comparison
    table has one row per model, so these windows are tiny."""
    t = table.withColumn("__scored", F.col("mae").isNotNull() if "mae" in table.columns else F.lit(False))
    keys = [F.desc("__scored")] + [F.asc_nulls_last(c) for c in METRIC_COLUMNS if c in table.columns] + \
           [F.asc("ordinal")]
    first = t.withColumn("__r", F.row_number().over(Window.partitionBy("model_name").orderBy(*keys))) \
             .where("__r = 1")
    ranked = first.withColumn("cf_rank", F.row_number().over(Window.orderBy(*keys)))
    stats = ranked.agg(F.count_if("__scored").alias("__ns"), F.count(F.lit(1)).alias("__na")).first()
    k = min(min(CARRY_FORWARD_MAX, max(CARRY_FORWARD_MIN, stats["__ns"] or 0)), stats["__na"] or 0)
    return ranked.where(F.col("cf_rank") <= k).select(
        "cf_rank", "model_name", *[c for c in METRIC_COLUMNS if c in table.columns])


def carry_forward_reasons(selected: DataFrame) -> DataFrame:
    """One justification line per selected model."""
    line = F.when(F.col("mae").isNotNull(), F.format_string(
        "#%d %s: MAE=%s, RMSE=%s, MAPE=%s%%", "cf_rank", "model_name",
        F.format_number("mae", 2), F.format_number("rmse", 2), F.format_number("mape", 2))) \
        .otherwise(F.format_string("#%d %s: not scored; carried to reach the minimum of %d models",
                                   "cf_rank", "model_name", F.lit(CARRY_FORWARD_MIN)))
    return selected.select("cf_rank", "model_name", line.alias("justification"))


# --------------------------------------------------------------------------- E8
def error_by_period(pairs: DataFrame, bucket_col: str = "bucket", by: Sequence[str] = ()) -> DataFrame:
    """n_periods + metrics per bucket label, in first-appearance order."""
    return (pairs.withColumn(bucket_col, F.col(bucket_col).cast("string"))
                 .groupBy(*by, bucket_col).agg(F.count(F.lit(1)).cast("long").alias("n_periods"),
                                               *metric_aggs(), F.min(PERIOD).alias("first_seen"))
                 .withColumn("bucket_order", F.row_number().over(
                     Window.partitionBy(*by).orderBy("first_seen", bucket_col))))


# --------------------------------------------------------------------------- E9
def forecast_vs_actual(actual: DataFrame, fc_total: DataFrame, table: DataFrame) -> DataFrame:
    """Long rows (period, line, value): the actual line plus one line per
    scored (aligned) model."""
    ok = table.where(F.col("mae").isNotNull()).select(F.col("model_name").alias("model"))
    models = fc_total.join(ok, "model", "left_semi").join(actual.select(PERIOD), PERIOD, "left_semi")
    return actual.select(PERIOD, F.lit("actual").alias("line"), F.col("actual").alias("value")) \
                 .unionByName(models.select(PERIOD, F.col("model").alias("line"), F.col("yhat").alias("value")))


# --------------------------------------------------------------------------- E10
def metric_bars(table: DataFrame) -> DataFrame:
    """Long (model, metric, value) of scored models, best MAE first."""
    s = table.where(F.col("mae").isNotNull())
    s = s.withColumn("model_rank", F.row_number().over(Window.orderBy("mae", "ordinal")))
    return s.select("model_rank", "model_name", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRIC_COLUMNS])))
