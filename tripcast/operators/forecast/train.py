"""Train every candidate on one horizon with failures isolated.

A candidate is ``name -> fn(train, horizon)`` returning a forecast frame or a
``(forecast, status)`` pair.  Each model's (small) forecast is materialised by
a reliable ``checkpoint()`` inside its own try-block, so a model that fails at
plan or run time becomes an exclusion row instead of failing the run.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripcast.operators.forecast import FORECAST_SCHEMA, STATUS_SCHEMA
from tripcast.operators.forecast.additive import forecast_additive
from tripcast.operators.forecast.arima import forecast_sarima, forecast_sarimax
from tripcast.operators.forecast.gbt import forecast_gbt
from tripcast.operators.forecast.naive import seasonal_naive
from tripcast.operators.forecast.smoothing import forecast_holt_winters
from tripcast.operators.forecast.var import forecast_var
from tripcast.operators.forecast.windowed import forecast_windowed
from tripcast.session import ensure_checkpoint_dir, materialize, written


def default_candidates(gbt_params: dict | None = None) -> dict[str, Callable]:
    """The reference's model families, re-aimed as Spark jobs (in its order)."""
    return {
        "Holt-Winters": lambda t, h: forecast_holt_winters(t, h),
        "SARIMA": lambda t, h: forecast_sarima(t, h),
        "SARIMAX": lambda t, h: forecast_sarimax(t, h),
        "VAR": lambda t, h: forecast_var(t, h),
        "Additive-Ridge": lambda t, h: forecast_additive(t, h),
        "Boosted-Trees": lambda t, h: forecast_gbt(t, h, params=gbt_params),
        "Windowed-LR": lambda t, h: forecast_windowed(t, h),
        "Seasonal-Naive": lambda t, h: seasonal_naive(t, h, 7),
    }


def train_all(candidates: Mapping[str, Callable], train: DataFrame, horizon: int):
    """Returns ``(forecasts, status)`` unions over all candidates."""
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    train = written(train, "train")  # every candidate reads it several times
    fcs, sts = [], []
    for name, fn in candidates.items():
        try:
            res = fn(train, horizon)
            fc, st = res if isinstance(res, tuple) else (res, None)
            fc = fc.select(F.lit(name).alias("model"), "period", F.col("region").cast("string"),
                           F.col("yhat").cast("double"))
            fc = materialize(fc)
            if st is None:
                st = spark.createDataFrame([(name, None, False, None)], STATUS_SCHEMA)
            else:
                st = st.select(F.lit(name).alias("model"), F.col("region").cast("string"),
                               "excluded", F.col("reason").cast("string"))
            sts.append(materialize(st))
            fcs.append(fc)
        except Exception as e:  # noqa: BLE001 - isolate the failing model
            sts.append(spark.createDataFrame([(name, None, True, f"{type(e).__name__}: {e}")],
                                             STATUS_SCHEMA))
    fc = reduce(lambda a, b: a.unionByName(b), fcs) if fcs else spark.createDataFrame([], FORECAST_SCHEMA)
    st = reduce(lambda a, b: a.unionByName(b), sts)
    return fc, st


def model_status(status: DataFrame) -> DataFrame:
    """One row per model: excluded when any series of it failed, since its
    total would lack that series."""
    return status.groupBy("model").agg(
        F.bool_or("excluded").alias("excluded"),
        F.max(F.when(F.col("excluded"), F.col("reason"))).alias("reason"))
