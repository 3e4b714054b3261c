"""Trend + seasonality additive regression (F10), fitted with pyspark.ml.

Piecewise-linear trend (hinges at candidate changepoints in the first 80% of
the history), weekly Fourier terms (order 3) and, with two years of history,
yearly Fourier terms (order 10) are plain column expressions; a ridge
``LinearRegression`` fits them.  Works on the total series or one region (F2).
No clipping.
"""

from __future__ import annotations

import datetime as dt
import math
from typing import Optional

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripcast.functions.columns import epoch_seconds, lit_ntz
from tripcast.operators.forecast.split import single_series
from tripcast.params import PERIOD

N_CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
WEEKLY_ORDER = 3
YEARLY_ORDER = 10


def _features(df: DataFrame, t0: float, span: float, cps: list[float], yearly: bool) -> tuple[DataFrame, list[str]]:
    secs = epoch_seconds(F.col(PERIOD)).cast("double")
    t = (secs - F.lit(t0)) / F.lit(span)
    days = secs / 86400.0
    cols = [t.alias("f_t")]
    cols += [F.greatest(t - F.lit(c), F.lit(0.0)).alias(f"f_cp{i}") for i, c in enumerate(cps)]
    for n in range(1, WEEKLY_ORDER + 1):
        cols += [F.sin(2 * math.pi * n * days / 7.0).alias(f"f_ws{n}"),
                 F.cos(2 * math.pi * n * days / 7.0).alias(f"f_wc{n}")]
    if yearly:
        for n in range(1, YEARLY_ORDER + 1):
            cols += [F.sin(2 * math.pi * n * days / 365.25).alias(f"f_ys{n}"),
                     F.cos(2 * math.pi * n * days / 365.25).alias(f"f_yc{n}")]
    out = df.select("*", *cols)
    return out, [c for c in out.columns if c.startswith("f_")]


def forecast_additive(train: DataFrame, horizon: int, region: Optional[str] = None,
                      model: str = "Additive-Ridge", reg_param: float = 0.001):
    y = single_series(train, region)
    stats = y.agg(F.min(PERIOD).alias("a"), F.max(PERIOD).alias("b"), F.count(F.lit(1)).alias("n")).first()
    if not stats["n"]:
        raise ValueError("empty training series")
    a = stats["a"].replace(tzinfo=dt.timezone.utc).timestamp()
    b = stats["b"].replace(tzinfo=dt.timezone.utc).timestamp()
    t0, span = a, max(b - a, 86400.0)
    cps = [CHANGEPOINT_RANGE * (i + 1) / (N_CHANGEPOINTS + 1) for i in range(N_CHANGEPOINTS)]
    yearly = (b - a) >= 2 * 365 * 86400
    feats, names = _features(y, t0, span, cps, yearly)
    va = VectorAssembler(inputCols=names, outputCol="features")
    lr = LinearRegression(featuresCol="features", labelCol="y", regParam=reg_param,
                          elasticNetParam=0.0, standardization=True, maxIter=200)
    fitted = lr.fit(va.transform(feats))
    spark = train.sparkSession
    fut = spark.range(1, horizon + 1).select(
        (lit_ntz(stats["b"]) + F.expr("make_dt_interval(id, 0, 0, 0)")).alias(PERIOD))
    ff, _ = _features(fut, t0, span, cps, yearly)
    pred = fitted.transform(va.transform(ff))
    return pred.select(F.lit(model).alias("model"), PERIOD,
                       F.lit(region).cast("string").alias("region"),
                       F.col("prediction").alias("yhat"))
