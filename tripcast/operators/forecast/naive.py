"""Seasonal-naive model, exogenous extension and clipping (F4, F8, F16).  Pure SQL plans."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripcast.functions.columns import clip_lower
from tripcast.operators.features import future_periods
from tripcast.params import DEMAND, PERIOD, REGION


def seasonal_naive(train: DataFrame, horizon: int, season: int = 7, value_col: str = DEMAND,
                   by: Sequence[str] = (REGION,), model: str = "Seasonal-Naive",
                   per_region: bool = True, future: DataFrame | None = None) -> DataFrame:
    """repeat the last ``season`` values; fewer than ``season`` -> the last
    value.  ``future`` (``(*by, h, period)``) defaults to W7 per series."""
    keys = list(by)
    w = Window.partitionBy(*keys).orderBy(F.desc(PERIOD))
    last = train.select(*keys, PERIOD, F.col(value_col).cast("double").alias("__v"),
                        F.row_number().over(w).alias("__rd"),
                        F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("__n"))
    last = last.where(F.col("__rd") <= season)
    # position inside the last season, 0 = oldest; a short history uses its last value
    last = last.select(*keys, "__v", "__rd", "__n",
                       F.when(F.col("__n") >= season, season - F.col("__rd")).alias("__pos"))
    fut = future if future is not None else future_periods(train, horizon, by=keys, per_region=per_region)
    fut = fut.withColumn("__need", (F.col("h") - 1) % season)
    full = last.where(F.col("__pos").isNotNull()).select(*keys, F.col("__pos").alias("__need"),
                                                         F.col("__v").alias("__a"))
    short = last.where(F.col("__rd") == 1).select(*keys, F.col("__v").alias("__b"))
    out = fut.join(full, [*keys, "__need"], "left").join(short, keys, "left")
    return out.select(F.lit(model).alias("model"), PERIOD,
                      (F.col(keys[0]).cast("string") if keys else F.lit(None).cast("string")).alias(REGION),
                      F.coalesce("__a", "__b", F.lit(0.0)).alias("yhat"))


def extend_exog(history: DataFrame, columns: Sequence[str], horizon: int, season: int = 7,
                by: Sequence[str] = (REGION,), future: DataFrame | None = None) -> DataFrame:
    """F8: future values of exogenous columns by the seasonal-naive rule
    (no history -> 0).  Output ``(*by, period, <columns>)``."""
    keys = list(by)
    fut = future if future is not None else future_periods(history, horizon, by=keys, per_region=True)
    out = fut.select(*keys, "h", PERIOD)
    for c in columns:
        f = seasonal_naive(history.select(*keys, PERIOD, F.col(c).cast("double").alias("__x")),
                           horizon, season, "__x", keys, future=fut)
        out = out.join(f.select(F.col(REGION).alias(keys[0]) if keys else F.lit(1), PERIOD,
                                F.col("yhat").alias(c)), [*keys, PERIOD], "left")
    return out.select(*keys, PERIOD, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in columns])


def clip_forecast(fc: DataFrame) -> DataFrame:
    """F16: ``yhat = max(yhat, 0)`` where present."""
    return fc.withColumn("yhat", clip_lower("yhat"))
