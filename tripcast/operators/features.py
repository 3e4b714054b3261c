"""Calendar, lag-window and rolling features.

Every series operator takes ``by`` - the columns that identify one series
(e.g. ``["region"]``).  Windows are ``partitionBy(*by)``, so many series spread
over the cluster.  With ``by=[]`` the frame is one series (the daily total):
its size is bounded by the analysis window (<= 731 days), so the single-task
window is deliberate and cheap.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripcast.functions.columns import (dow_dummy_cols, epoch_seconds, iso_week, is_weekend, lit_ntz,
                                        to_ts, weekday0)
from tripcast.params import PERIOD, REGION

DEFAULT_STEP_SECONDS = 86400


def _w(by: Sequence[str], period_col: str = PERIOD):
    return Window.partitionBy(*by).orderBy(period_col)


# --------------------------------------------------------------------------- W2/W3
def calendar_features(df: DataFrame, period_col: str = PERIOD, extended: bool = False) -> DataFrame:
    """day_of_week (Mon=0), is_weekend, month, day_of_month.
    W3 (``extended``): the model's cal_* set including day of year."""
    p = to_ts(F.col(period_col)).cast("date")
    if extended:
        return df.select("*", weekday0(p).alias("cal_dayofweek"), F.dayofmonth(p).alias("cal_day"),
                         F.month(p).alias("cal_month"), F.dayofyear(p).alias("cal_dayofyear"),
                         is_weekend(p).alias("cal_is_weekend"))
    return df.select("*", weekday0(p).alias("day_of_week"), is_weekend(p).alias("is_weekend"),
                     F.month(p).alias("month"), F.dayofmonth(p).alias("day_of_month"))


# --------------------------------------------------------------------------- W4
def dow_dummies(df: DataFrame, period_col: str = PERIOD) -> DataFrame:
    return df.select("*", *dow_dummy_cols(F.col(period_col)))


# --------------------------------------------------------------------------- W5
def region_one_hot(regions: Sequence[str], region_col: str = REGION) -> list[Column]:
    return [F.when(F.col(region_col) == r, 1.0).otherwise(0.0).alias(f"region_{r}")
            for r in sorted(regions)]


def feature_matrix(df: DataFrame, lags: Sequence[int], regions: Sequence[str],
                   period_col: str = PERIOD) -> DataFrame:
    """lag_k + cal_* + region_* columns in a fixed order (+ the input)."""
    with_cal = calendar_features(df, period_col, extended=True)
    return with_cal.select("*", *region_one_hot(regions))


def feature_names(lags: Sequence[int], regions: Sequence[str]) -> list[str]:
    return ([f"lag_{k}" for k in sorted(set(lags))] +
            ["cal_dayofweek", "cal_day", "cal_month", "cal_dayofyear", "cal_is_weekend"] +
            [f"region_{r}" for r in sorted(regions)])


# --------------------------------------------------------------------------- W6
STEP_BLOCK = 1 << 18  # seconds


def infer_step(df: DataFrame, period_col: str = PERIOD) -> DataFrame:
    """Modal positive gap (seconds) between distinct sorted periods, the
    least on a tie; 1 day fallback.

    The time axis is cut into blocks of ``STEP_BLOCK`` seconds, which hold at
    most so many distinct stamps. Gaps inside a block come from a window over
    it; each block then hands its first and last stamp on, and the gaps between
    neighbouring blocks come from that short list. Nothing is sorted as a whole.
    """
    stamp = epoch_seconds(F.col(period_col))
    p = df.select(stamp.alias("s")).where("s IS NOT NULL").distinct().withColumn(
        "block", F.floor(F.col("s") / STEP_BLOCK))
    inner = p.select((F.col("s") - F.lag("s").over(Window.partitionBy("block").orderBy("s"))).alias("gap")).where("gap > 0")
    edges = p.groupBy("block").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    line = edges.agg(F.array_sort(F.collect_list(F.struct("block", "lo", "hi"))).alias("e"))
    between = line.select(F.explode(F.zip_with(
        F.slice("e", 1, F.greatest(F.size("e") - 1, F.lit(0))), F.slice("e", 2, F.greatest(F.size("e") - 1, F.lit(0))),
        lambda a, b: b["lo"] - a["hi"])).alias("gap"))
    modal = (inner.unionByName(between).groupBy("gap").count()
             .agg(F.min_by("gap", F.struct(-F.col("count"), F.col("gap"))).alias("g")))
    return modal.select(F.coalesce(F.col("g"), F.lit(DEFAULT_STEP_SECONDS)).cast("long").alias("step_seconds"))


# --------------------------------------------------------------------------- W7
def future_periods(history: DataFrame, horizon: int, step_seconds: int = DEFAULT_STEP_SECONDS,
                   by: Sequence[str] = (REGION,), per_region: bool = False,
                   period_col: str = PERIOD) -> DataFrame:
    """The ``horizon`` periods after the last one, for every series.

    ``per_region=False``: all series continue from the global last period
    (Holt-Winters style); ``True``: from each series' own last period.
    Output ``(*by, h, period)`` with h = 1..horizon.
    """
    step = F.expr(f"make_dt_interval(0, 0, 0, {int(step_seconds)})")
    if per_region:
        last = history.groupBy(*by).agg(F.max(period_col).alias("__last"))
    else:
        gl = history.agg(F.max(period_col).alias("__last"))
        last = history.select(*by).distinct()
        last_val = gl.first()["__last"]  # one scalar
        last = last.withColumn("__last", lit_ntz(last_val))
    return last.select(*by, F.posexplode(F.sequence(F.col("__last") + step,
                                                     F.col("__last") + step * F.lit(horizon), step))
                       .alias("h", period_col)).withColumn("h", F.col("h") + 1)


# --------------------------------------------------------------------------- W8
def window_sequences(df: DataFrame, window: int, by: Sequence[str] = (REGION,),
                     value_col: str = "y", period_col: str = PERIOD) -> DataFrame:
    """For each row, the previous ``window`` values -> the current value.

    Rows without a full window are dropped.  Output ``(*by, period, x ARRAY, y)``.
    """
    w = _w(by, period_col).rowsBetween(-window, -1)
    out = df.select(*by, period_col, F.collect_list(value_col).over(w).alias("x"),
                    F.col(value_col).alias("y"))
    return out.where(F.size("x") == window)


def effective_window(df: DataFrame, window: int, by: Sequence[str] = (REGION,)) -> int:
    """``min(window, longest series - 1)`` (>= 1)."""
    longest = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    return max(1, min(window, longest - 1))


# --------------------------------------------------------------------------- W9
def standardize(df: DataFrame, value_col: str, by: Sequence[str] = ()) -> DataFrame:
    """z = (v - mean) / population std (std <= 1e-12 -> 1).  Adds
    ``__mu``/``__sd`` so predictions can be inverted later."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(value_col).over(w)
    return df.select("*", F.avg(value_col).over(w).alias("__mu"),
                     F.when(F.coalesce(sd, F.lit(0.0)) <= 1e-12, F.lit(1.0)).otherwise(sd).alias("__sd")) \
             .withColumn("z", (F.col(value_col) - F.col("__mu")) / F.col("__sd"))


def destandardize(z: Column, mu: Column, sd: Column, clip: bool = True) -> Column:
    v = z * sd + mu
    return F.greatest(v, F.lit(0.0)) if clip else v


# --------------------------------------------------------------------------- W10
def seed_window(hist: Column, window: int) -> Column:
    """Left-pad a short history with its earliest value to ``window`` values."""
    n = F.size(hist)
    padded = F.concat(F.array_repeat(F.element_at(hist, 1), F.greatest(F.lit(window) - n, F.lit(0))), hist)
    return F.slice(padded, F.greatest(F.size(padded) - window + 1, F.lit(1)), window)


# ---------------------------------------------------------------------- W11/W12
def _centered(by, period_col, window):
    return _w(by, period_col).rowsBetween(-(window // 2), (window - 1) // 2)


def rolling_median(df: DataFrame, window: int, value_col: str = "y", by: Sequence[str] = (),
                   period_col: str = PERIOD, out: str = "local_median") -> DataFrame:
    """Centred rolling median, NULL where fewer than min(2, n) points."""
    w = _centered(by, period_col, window)
    n_all = F.count(F.lit(1)).over(Window.partitionBy(*by))
    minp = F.least(F.lit(2), n_all)
    cnt = F.count(value_col).over(w)
    return df.withColumn(out, F.when(cnt >= minp, F.percentile(value_col, 0.5).over(w)))


def rolling_mad(df: DataFrame, window: int, value_col: str = "y", by: Sequence[str] = (),
                period_col: str = PERIOD, median_col: str = "local_median") -> DataFrame:
    """Rolling median (and mean) of |y - own local median| (a second pass)."""
    df = df.withColumn("abs_dev", F.abs(F.col(value_col) - F.col(median_col)))
    w = _centered(by, period_col, window)
    n_all = F.count(F.lit(1)).over(Window.partitionBy(*by))
    minp = F.least(F.lit(2), n_all)
    cnt = F.count("abs_dev").over(w)
    return (df.withColumn("local_mad", F.when(cnt >= minp, F.percentile("abs_dev", 0.5).over(w)))
              .withColumn("local_mean_abs_dev", F.when(cnt >= minp, F.avg("abs_dev").over(w))))


# --------------------------------------------------------------------------- W13
def centered_moving_average(df: DataFrame, period: int, value_col: str = "y",
                            by: Sequence[str] = (), period_col: str = PERIOD,
                            out: str = "trend") -> DataFrame:
    """Two-sided MA as in classical decomposition.

    Odd period: equal weights over +-period//2.  Even period: a 2 x period MA
    (half weight on both ends).  NULL where the frame is incomplete.
    """
    h = period // 2
    w = _w(by, period_col).rowsBetween(-h, h)
    cnt = F.count(value_col).over(w)
    if period % 2:
        val = F.avg(value_col).over(w)
        full = cnt == period
    else:
        ow = _w(by, period_col)
        ends = F.lag(value_col, h).over(ow) + F.lead(value_col, h).over(ow)
        val = (F.sum(value_col).over(w) - 0.5 * ends) / period
        full = cnt == period + 1
    return df.withColumn(out, F.when(full, val))


# --------------------------------------------------------------------------- W14
def iso_week_bucket(df: DataFrame, period_col: str = PERIOD, out: str = "bucket") -> DataFrame:
    return df.withColumn(out, iso_week(F.col(period_col)).cast("string"))
