"""Window-sequence forecaster.

One global model maps the previous ``w`` standardised values of a region to
the next one (W8 + W9).  The reference trains recurrent networks for this map;
here it is a ``pyspark.ml`` linear regression on the window vector.  The
multi-step recursion is a single ``aggregate()`` fold over the horizon inside
one plan: the state carries the window, every step appends its prediction.
Short histories are left-padded with their earliest value (W10); outputs are
de-standardised and clipped at 0.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripcast.operators.features import effective_window, seed_window, window_sequences
from tripcast.params import DEMAND, PERIOD, REGION


def forecast_windowed(train: DataFrame, horizon: int, window: int = 7, model: str = "Windowed-LR",
                      reg_param: float = 0.0):
    base = train.select(REGION, PERIOD, F.col(DEMAND).cast("double").alias("v"))
    stats = base.agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd")).first()  # two scalars
    mu = stats["mu"] or 0.0
    sd = stats["sd"] if stats["sd"] and stats["sd"] > 1e-12 else 1.0
    z = base.select(REGION, PERIOD, ((F.col("v") - mu) / sd).alias("y"))
    w = effective_window(z, window)
    seqs = window_sequences(z, w).select(array_to_vector("x").alias("features"), "y")
    lr = LinearRegression(featuresCol="features", labelCol="y", regParam=reg_param, maxIter=100)
    fitted = lr.fit(seqs)
    coef = [float(c) for c in fitted.coefficients]
    b0 = float(fitted.intercept)
    ww = Window.partitionBy(REGION).orderBy(PERIOD).rowsBetween(-(w - 1), 0)
    last = (z.withColumn("__hist", F.collect_list("y").over(ww))
             .withColumn("__rd", F.row_number().over(Window.partitionBy(REGION).orderBy(F.desc(PERIOD))))
             .where("__rd = 1").select(REGION, F.col(PERIOD).alias("__last"),
                                       seed_window(F.col("__hist"), w).alias("__win")))
    coef_arr = F.array(*[F.lit(c) for c in coef])

    def step(acc, _i):
        nxt = F.lit(b0) + F.aggregate(F.zip_with(acc["win"], coef_arr, lambda a, c: a * c),
                                      F.lit(0.0), lambda s, x: s + x)
        return F.struct(F.slice(F.concat(acc["win"], F.array(nxt)), 2, w).alias("win"),
                        F.concat(acc["out"], F.array(nxt)).alias("out"))
    init = F.struct(F.col("__win").alias("win"), F.array().cast("array<double>").alias("out"))
    folded = last.select(REGION, "__last", F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), init, step)["out"]
                         .alias("__out"))
    return folded.select(F.lit(model).alias("model"), REGION, "__last",
                         F.posexplode("__out").alias("__h", "__z")).select(
        "model", (F.col("__last") + F.expr("make_dt_interval(__h + 1, 0, 0, 0)")).alias(PERIOD), REGION,
        F.greatest(F.col("__z") * sd + mu, F.lit(0.0)).alias("yhat"))
