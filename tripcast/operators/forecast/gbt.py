"""Gradient-boosted trees over lags + calendar + region.

One global ``GBTRegressor`` learns from every region.  Lags missing at the
start of a series are imputed with 0 plus an indicator column (a NaN in the
vector is an error in Spark ML).  Forecasting is recursive and looks lags up
**by date** (F12), as one fold over the horizon per region: the fitted trees are
read back as arrays of nodes, and every step reads the last days' values,
actual or predicted, walks the trees and puts its value in front.
"""

from __future__ import annotations

import uuid
from typing import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripcast.functions.columns import is_weekend, lit_ntz, weekday0
from tripcast.operators.explore import region_list
from tripcast.operators.features import calendar_features, region_one_hot
from tripcast.operators.prepare import add_lag_features
from tripcast.params import DEMAND, PERIOD, REGION
from tripcast.session import ensure_checkpoint_dir, materialize, scratch_path, written

# Fixed values that must equal the reference's model settings.
GBT_PARAMS = dict(maxIter=300, maxDepth=4, stepSize=0.05, subsamplingRate=0.9,
                  featureSubsetStrategy="0.9", seed=0)


def _features(df: DataFrame, lags: Sequence[int], regions: Sequence[str]) -> tuple[DataFrame, list[str]]:
    cols = []
    for k in lags:
        cols += [F.coalesce(F.col(f"lag_{k}"), F.lit(0.0)).alias(f"f_lag_{k}"),
                 F.col(f"lag_{k}").isNull().cast("double").alias(f"f_lag_{k}_missing")]
    out = calendar_features(df.select("*", *cols), extended=True)
    out = out.select("*", *region_one_hot(regions))
    names = [c for c in out.columns if c.startswith("f_lag_")] + \
        ["cal_dayofweek", "cal_day", "cal_month", "cal_dayofyear", "cal_is_weekend"] + \
        [f"region_{r}" for r in sorted(regions)]
    return out, names


def recursive_features(history: DataFrame, step: DataFrame, lags: Sequence[int]) -> DataFrame:
    """F12, one step: lag_k of each (region, period) row of ``step`` is the
    value at ``period - k days`` in ``history`` (actuals or predictions), else NULL."""
    ahead = F.array(*[F.struct((F.col(PERIOD) + F.expr(f"INTERVAL {k} DAYS")).alias(PERIOD), F.lit(k).alias("__k"),
                               F.col("value").alias("__v")) for k in lags])
    lagged = history.select(REGION, F.inline(ahead)).groupBy(REGION, PERIOD).agg(
        *[F.max(F.when(F.col("__k") == k, F.col("__v"))).alias(f"lag_{k}") for k in lags])
    return step.join(lagged, [REGION, PERIOD], "left")


def forecast_gbt(train: DataFrame, horizon: int, lags: Sequence[int] = (1, 7, 14),
                 model: str = "Boosted-Trees", params: dict | None = None):
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    lags = sorted(set(lags))
    regions = region_list(train)
    # the series is small (periods x regions); cut its lineage once
    base = materialize(train.select(PERIOD, REGION, F.col(DEMAND).cast("double").alias(DEMAND)))
    lagged = add_lag_features(base, lags)
    feats, names = _features(lagged, lags, regions)
    va = VectorAssembler(inputCols=names, outputCol="features")
    gbt = GBTRegressor(featuresCol="features", labelCol=DEMAND, **(params or GBT_PARAMS))
    # partitions by size: a round is several jobs, and a small series needs few tasks
    data = written(va.transform(feats).select("features", DEMAND), "gbt-train").cache()
    fitted = gbt.fit(data)
    data.unpersist()
    path = scratch_path(spark, f"gbt-model-{uuid.uuid4().hex}")
    fitted.write().save(path)
    last = base.agg(F.max(PERIOD)).first()[0]  # one scalar
    span, depth = max(lags), gbt.getMaxDepth()
    back = F.datediff(lit_ntz(last).cast("date"), F.col(PERIOD).cast("date"))
    recent = base.where(back < span).groupBy(REGION).agg(F.map_from_entries(F.collect_list(F.struct(back, DEMAND))).alias("m"))
    series = base.select(REGION).distinct().join(recent, REGION, "left").select(
        REGION, F.transform(F.sequence(F.lit(0), F.lit(span - 1)), lambda i: F.try_element_at("m", i)).alias("hist"))
    ensemble = stored_trees(spark, path, fitted.treeWeights).withColumn("__k", F.lit(1))
    rows = series.withColumn("__k", F.lit(1)).join(ensemble, "__k")

    def step(state, h):
        day = F.date_add(lit_ntz(last).cast("date"), h)
        x = [v for k in lags for v in (F.coalesce(state["hist"][k - 1], F.lit(0.0)), state["hist"][k - 1].isNull().cast("double"))]
        x += [c.cast("double") for c in (weekday0(day), F.dayofmonth(day), F.month(day), F.dayofyear(day), is_weekend(day))]
        x += [(F.col(REGION) == r).cast("double") for r in regions]
        value = F.greatest(predicted(F.col("trees"), F.array(*x), depth), F.lit(0.0))
        # computed once, read as the newest of the history
        return F.transform(F.array(value), lambda v: F.struct(
            F.slice(F.concat(F.array(v), state["hist"]), 1, span).alias("hist"), F.concat(state["out"], F.array(v)).alias("out")))[0]
    start = F.struct(F.col("hist").alias("hist"), F.array().cast("array<double>").alias("out"))
    folded = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step, lambda s: s["out"])
    return rows.select(REGION, F.posexplode(folded).alias("h", "yhat")).select(
        F.lit(model).alias("model"), (lit_ntz(last) + F.expr("make_dt_interval(h + 1, 0, 0, 0)")).alias(PERIOD), REGION, "yhat")


def stored_trees(spark, path: str, tree_weights: Sequence[float]) -> DataFrame:
    """One row: a saved ensemble's trees, each with its weight and its nodes' arrays."""
    node = F.col("nodeData")
    nodes = spark.read.parquet(f"{path}/data").groupBy("treeID").agg(F.array_sort(F.collect_list(F.struct(
        node["id"].alias("id"), node["split"]["featureIndex"].alias("feature"),
        F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"), node["leftChild"].alias("left"),
        node["rightChild"].alias("right"), node["prediction"].alias("value")))).alias("n"))
    weights = spark.createDataFrame(list(enumerate(map(float, tree_weights))), "treeID int, weight double")  # a row a tree
    each = lambda f: F.transform("n", lambda n: n[f]).alias(f)
    trees = nodes.join(weights, "treeID").select("treeID", F.struct("weight", *[each(f) for f in (
        "feature", "threshold", "left", "right", "value")]).alias("tree"))
    return trees.agg(F.transform(F.array_sort(F.collect_list(F.struct("treeID", "tree"))), lambda t: t["tree"]).alias("trees"))


def predicted(trees, x, depth: int):
    """The ensemble's prediction for an array of (continuous) features; no tree is deeper than ``depth``."""
    def leaf(t):
        down = lambda n, _: F.when(t["left"][n] < 0, n).when(
            x[t["feature"][n]] <= t["threshold"][n], t["left"][n]).otherwise(t["right"][n])
        return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), down)
    return F.aggregate(trees, F.lit(0.0), lambda s, t: s + t["weight"] * t["value"][leaf(t)])
