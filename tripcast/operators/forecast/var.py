"""VAR jointly over the regions (F9), as one plan.

Periods are numbered by their distance from the first; each period's values by
region are one vector, and a period's lags come from an equi-join on (number +
lag). The cross products of the design with the largest order are summed once;
every smaller order is a sub-matrix, so the AIC search and the refit are dense
algebra on one small matrix. The recursion is a fold over the forecast steps.
The lag order is chosen over p = 0..maxlags on a common sample (p = 0 falls
back to 1), then refit on its full sample: the few rows before the common
sample come along as they are. No clipping.
"""

from __future__ import annotations

from typing import Optional

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripcast.functions.columns import lit_ntz
from tripcast.operators.forecast import STATUS_SCHEMA
from tripcast.params import DEMAND, PERIOD, REGION
from tripcast.session import written


def vectors(train: DataFrame, value_col: str = DEMAND) -> DataFrame:
    """(t, y): per day its number from 0 and the regions' values in order of their names."""
    first = train.agg(F.min(PERIOD)).first()[0]  # one scalar
    rows = train.where(F.col(REGION).isNotNull() & F.col(PERIOD).isNotNull()).groupBy(PERIOD, REGION).agg(
        F.sum(value_col).cast("double").alias("y"))
    t = F.datediff(F.col(PERIOD).cast("date"), lit_ntz(first).cast("date"))
    return rows.groupBy(t.alias("t")).agg(F.transform(F.array_sort(F.collect_list(F.struct(REGION, "y"))),
                                                      lambda r: r["y"]).alias("y"))


def design(days: DataFrame, order: int, k: int) -> DataFrame:
    """(t, z): z = 1, the vectors 1..order days before (0 where there is none), the day's own."""
    shifted = days.select("t", "y", F.explode(F.sequence(F.lit(0), F.lit(order))).alias("lag")).select(
        (F.col("t") + F.col("lag")).alias("t"), "lag", "y")
    by_lag = shifted.groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("lag", "y"))).alias("m"))
    none = F.array_repeat(F.lit(0.0), k)
    lagged = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(order)),
                                   lambda j: F.coalesce(F.try_element_at(F.col("m"), j), none)))
    own = F.try_element_at(F.col("m"), F.lit(0))
    return by_lag.where(own.isNotNull()).select("t", F.concat(F.array(F.lit(1.0)), lagged, own).alias("z"))


def gram(rows: DataFrame) -> DataFrame:
    """(i, j, v): cross products of the design's columns, summed over its rows."""
    pairs = rows.select(F.posexplode("z").alias("i", "zi"), "z").select("i", F.posexplode("z").alias("j", "zj"), "zi")
    return pairs.groupBy("i", "j").agg(F.sum(F.col("zi") * F.col("zj")).alias("v"))


def choose_and_fit(full: np.ndarray, head: np.ndarray, n: int, k: int, order: int) -> tuple[int, np.ndarray]:
    """(p, coefficients (k, 1 + k p)) from the cross products of the common sample and the rows before it."""
    at = 1 + k * order

    def solve(g, p):
        x, y = np.arange(1 + k * p), np.arange(at, at + k)
        xx, xy, yy = g[np.ix_(x, x)], g[np.ix_(x, y)], g[np.ix_(y, y)]
        beta = np.linalg.lstsq(xx, xy, rcond=None)[0]
        return beta, yy - beta.T @ xy
    best, best_aic, common = 1, np.inf, n - order
    for p in range(order + 1):
        sign, logdet = np.linalg.slogdet(solve(full, p)[1] / common)
        if sign > 0 and (aic := logdet + 2.0 / common * p * k * k) < best_aic:
            best, best_aic = p, aic
    p = max(1, best)
    rows = head[p:order]  # row t has t lags
    return p, solve(full + rows.T @ rows, p)[0].T


def var_fit_forecast(train: DataFrame, horizon: int, maxlags: Optional[int] = None,
                     model: str = "VAR", value_col: str = DEMAND):
    """(forecasts, a one-row frame with the lag order ``p``). ValueError: fewer
    than 2 regions, too few periods, or a region without a value on some day."""
    days = written(vectors(train, value_col), "var-days")
    seen = days.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("y")).alias("least"), F.max(F.size("y")).alias("k"),
                    F.max("t").alias("last")).first()  # four scalars
    n, k = seen["n"], seen["k"] or 0
    if k < 2:
        raise ValueError(f"VAR needs at least 2 regions; got {k}")
    order = max(1, int(maxlags)) if maxlags is not None else max(1, min(7, (n - 1) // (k + 1)))
    if n <= order + 1:
        raise ValueError(f"{n} periods are too few for {k} regions with lag order up to {order}")
    if seen["least"] != k or seen["last"] != n - 1:
        raise ValueError("every region needs a value in every period")
    rows = design(days, order, k)
    size = 1 + k * order + k
    small = [  # one row each: the matrix, the rows before the common sample, the last vectors, the regions
        gram(rows.where(F.col("t") >= order)).agg(F.transform(
            F.array_sort(F.collect_list(F.struct("i", "j", "v"))), lambda r: r["v"]).alias("gram")),
        rows.where(F.col("t") < order).agg(F.flatten(F.transform(
            F.array_sort(F.collect_list(F.struct("t", "z"))), lambda r: r["z"])).alias("head")),
        days.where(F.col("t") >= n - order).agg(F.flatten(F.transform(
            F.sort_array(F.collect_list(F.struct("t", "y")), asc=False), lambda r: r["y"])).alias("hist")),
        train.where(F.col(REGION).isNotNull()).select(REGION).distinct().agg(
            F.array_sort(F.collect_list(REGION)).alias("regions")),
    ]
    one = small[0].withColumn("__k", F.lit(1))
    for part in small[1:]:
        one = one.join(part.withColumn("__k", F.lit(1)), "__k")

    @F.pandas_udf("p int, coef array<array<double>>")
    def fit(grams: pd.Series, heads: pd.Series) -> pd.DataFrame:
        found = [choose_and_fit(np.asarray(g, float).reshape(size, size), np.asarray(h, float).reshape(-1, size), n, k, order)
                 for g, h in zip(grams, heads)]
        return pd.DataFrame({"p": pd.Series([p for p, _ in found], dtype="int32"),
                             "coef": [[list(map(float, c)) for c in b] for _, b in found]})
    one = written(one.select("hist", "regions", fit("gram", "head").alias("fit")).select("hist", "regions", "fit.*"), "var-fit")

    def step(state, _):
        past = F.slice(state["hist"], 1, F.col("p") * k)
        new = F.transform("coef", lambda c: c[0] + F.aggregate(F.zip_with(
            F.slice(c, 2, F.col("p") * k), past, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
        # the new vector is computed once and read as the last of the forecasts
        return F.transform(F.array(F.concat(state["out"], F.array(new))), lambda out: F.struct(
            F.slice(F.concat(F.element_at(out, -1), state["hist"]), 1, F.lit(order * k)).alias("hist"), out.alias("out")))[0]
    start = F.struct(F.col("hist").alias("hist"), F.array().cast("array<array<double>>").alias("out"))
    steps = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step, lambda s: s["out"])
    ahead = one.select("regions", F.posexplode(steps).alias("h", "v")).select(
        "h", F.inline(F.arrays_zip(F.col("regions").alias("region"), F.col("v").alias("yhat"))))
    last = train.agg(F.max(PERIOD)).first()[0]
    forecasts = ahead.toDF("h", REGION, "yhat").select(
        F.lit(model).alias("model"), (lit_ntz(last) + F.expr("make_dt_interval(h + 1, 0, 0, 0)")).alias(PERIOD), REGION, "yhat")
    return forecasts, one.select("p")


def forecast_var(train: DataFrame, horizon: int, model: str = "VAR", maxlags: Optional[int] = None):
    """F9 wrapper returning ``(forecasts, status)``; a failure becomes an exclusion."""
    spark = train.sparkSession
    try:
        fc, order = var_fit_forecast(train, horizon, maxlags, model)
        st = order.select(F.lit(model).alias("model"), F.lit(None).cast("string").alias("region"),
                          F.lit(False).alias("excluded"), F.format_string("lag order %d", "p").alias("reason"))
        return fc, st
    except (ValueError, np.linalg.LinAlgError) as e:
        st = spark.createDataFrame([(model, None, True, f"{type(e).__name__}: {e}")], STATUS_SCHEMA)
        return spark.createDataFrame([], "model string, period timestamp_ntz, region string, yhat double"), st
