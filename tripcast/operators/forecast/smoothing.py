"""Holt-Winters per region (F5): additive trend + additive weekly season.

A series is one array ordered by period (bounded by the analysis window); the
smoothing recursion is a fold over it, in the JVM. Parameter sets are exploded
per series and dealt over the tasks, each folded to its one-step squared error;
``min_by`` keeps the best, around which two finer grids are searched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripcast.functions.columns import lit_ntz
from tripcast.params import DEMAND, PERIOD, REGION

SEASON = 7
ALPHAS = (0.05, 0.15, 0.3, 0.5, 0.7, 0.9)
BETAS = (0.0, 0.01, 0.05, 0.1, 0.3)
GAMMAS = (0.0, 0.01, 0.05, 0.1, 0.2, 0.4, 0.7)
#: Half-widths of the finer grids around the best point.
FINER = ((0.08, 0.02, 0.05), (0.02, 0.005, 0.0125))
FALLBACK = "non-seasonal fallback (fewer than two seasons)"


def ordered_series(train: DataFrame, value_col: str = DEMAND, season: int = SEASON) -> DataFrame:
    """One row per region: its values by period (``ys``) and which parts of the model it can carry."""
    one = train.groupBy(REGION).agg(F.array_sort(F.collect_list(F.struct(
        PERIOD, F.col(value_col).cast("double").alias("y")))).alias("s"))
    ys = F.transform("s", lambda r: r["y"])
    return one.select(REGION, ys.alias("ys"), (F.size("s") >= 3).alias("trended"),
                      (F.lit(season >= 2) & (F.size("s") >= 2 * season)).alias("seasonal"))


def _mean(ys, start: int, n: int):
    return F.aggregate(F.slice(ys, start, n), F.lit(0.0), lambda s, y: s + y) / n


def smoothed(ys, trended, seasonal, alpha, beta, gamma, season: int = SEASON):
    """The fold over ``ys``: a struct of level, trend, the season's indices from
    the next period on, and the sum of squared one-step errors (sse)."""
    first = _mean(ys, 1, season)
    level = F.when(seasonal, first).otherwise(ys[0])
    trend = F.when(seasonal, (_mean(ys, season + 1, season) - first) / season).when(
        trended, F.get(ys, F.lit(1)) - ys[0]).otherwise(F.lit(0.0))
    index = F.when(seasonal, F.transform(F.slice(ys, 1, season), lambda y: y - first)).otherwise(F.array(F.lit(0.0)))
    start = F.struct(level.alias("level"), trend.alias("trend"), index.alias("season"), F.lit(0.0).alias("sse"))

    def step(s, y):
        now = s["season"][0]
        error = y - (s["level"] + s["trend"] + now)
        new = alpha * (y - now) + (1 - alpha) * (s["level"] + s["trend"])
        slope = F.when(trended, beta * (new - s["level"]) + (1 - beta) * s["trend"]).otherwise(F.lit(0.0))
        again = F.when(seasonal, gamma * (y - new) + (1 - gamma) * now).otherwise(F.lit(0.0))
        rest = F.slice(s["season"], 2, F.size(s["season"]) - 1)
        return F.struct(new.alias("level"), slope.alias("trend"), F.concat(rest, F.array(again)).alias("season"),
                        (s["sse"] + error * error).alias("sse"))
    return F.aggregate(ys, start, step)


def fit_fixed(series: DataFrame, alpha: float, beta: float, gamma: float, season: int = SEASON) -> DataFrame:
    """``series`` (of :func:`ordered_series`) with its smoothed ``state`` under given parameters."""
    state = smoothed(F.col("ys"), F.col("trended"), F.col("seasonal"), F.lit(alpha), F.lit(beta), F.lit(gamma), season)
    return series.withColumn("state", state)


def _best(series: DataFrame, season: int) -> DataFrame:
    """``series`` (columns a, b, g: arrays of candidates) with its best (a, b, g)."""
    keep = ["ys", "trended", "seasonal"]
    sets = (series.select(REGION, *keep, F.explode("a").alias("a"), "b", "g")
            .select(REGION, *keep, "a", F.explode("b").alias("b"), "g")
            .repartition(REGION, "a", "b")  # so that one series' parameter sets are dealt over the tasks
            .select(REGION, *keep, "a", "b", F.explode("g").alias("g")))
    state = smoothed(F.col("ys"), F.col("trended"), F.col("seasonal"), F.col("a"), F.col("b"), F.col("g"), season)
    scored = sets.select(REGION, "a", "b", "g", state["sse"].alias("sse"))
    best = scored.groupBy(REGION).agg(F.min_by(F.struct("a", "b", "g"), F.struct("sse", "a", "b", "g")).alias("p"))
    return series.select(REGION, *keep).join(best.where("p is not null"), REGION)


def _around(value, width: float, low: float, high: float = 0.999):
    points = [F.least(F.greatest(value + F.lit(width * k / 2), F.lit(low)), F.lit(high)) for k in range(-2, 3)]
    return F.array_distinct(F.array(*points))


def fitted_series(train: DataFrame, value_col: str = DEMAND, season: int = SEASON) -> DataFrame:
    """One row per region: values, best parameters ``p`` (a, b, g) and ``state``."""
    series = ordered_series(train, value_col, season)
    usable = series.where(F.forall("ys", lambda y: y.isNotNull() & ~F.isnan(y)))
    none = F.array(F.lit(0.0))
    grid = lambda points: F.array(*[F.lit(x) for x in points])
    found = _best(usable.select("*", grid(ALPHAS).alias("a"), F.when(F.col("trended"), grid(BETAS)).otherwise(none).alias("b"),
                                F.when(F.col("seasonal"), grid(GAMMAS)).otherwise(none).alias("g")), season)
    for wa, wb, wg in FINER:
        found = _best(found.select(
            REGION, "ys", "trended", "seasonal", _around(F.col("p.a"), wa, 0.001).alias("a"),
            F.when(F.col("trended"), _around(F.col("p.b"), wb, 0.0)).otherwise(none).alias("b"),
            F.when(F.col("seasonal"), _around(F.col("p.g"), wg, 0.0)).otherwise(none).alias("g")), season)
    state = smoothed(F.col("ys"), F.col("trended"), F.col("seasonal"), F.col("p.a"), F.col("p.b"), F.col("p.g"), season)
    return found.withColumn("state", state)


def forecast_rows(fitted: DataFrame, horizon: int, last, model: str) -> DataFrame:
    """(model, period, region, yhat) for the ``horizon`` days after ``last``."""
    ahead = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")
    rows = fitted.select(REGION, "state", ahead)
    season = F.element_at(F.col("state.season"), (F.pmod(F.col("h") - 1, F.size("state.season")) + 1).cast("int"))
    return rows.select(F.lit(model).alias("model"), (lit_ntz(last) + F.expr("make_dt_interval(h, 0, 0, 0)")).alias(PERIOD),
                       REGION, (F.col("state.level") + F.col("h") * F.col("state.trend") + season).alias("yhat"))


def forecast_holt_winters(train: DataFrame, horizon: int, model: str = "Holt-Winters",
                          value_col: str = DEMAND):
    """per region, future axis after the global last training period; no
    clipping. A region with a missing value is excluded with the reason."""
    from tripcast.session import written
    last = train.agg(F.max(PERIOD)).first()[0]  # one scalar
    fitted = written(fitted_series(train, value_col), "holt-winters").where(F.col("state.sse").isNotNull())
    regions = train.groupBy(REGION).agg(F.count(F.lit(1)).alias("n"))
    status = regions.join(fitted.select(REGION, "seasonal"), REGION, "left").select(
        F.lit(model).alias("model"), REGION, F.col("seasonal").isNull().alias("excluded"),
        F.when(F.col("seasonal").isNull(), F.lit("ValueError: the series has missing values"))
        .when(~F.col("seasonal"), F.lit(FALLBACK)).alias("reason"))
    return forecast_rows(fitted, horizon, last, model), status
