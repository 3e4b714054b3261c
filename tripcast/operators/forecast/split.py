"""Holdout split and single-series view (F1, F2)."""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripcast.params import DEMAND, PERIOD, REGION


KNOWN_SHOWN = 50  # regions named by an error


def holdout_periods(series: DataFrame, n: int, period_col: str = PERIOD) -> DataFrame:
    """The ``n`` most recent distinct periods (a top-n over distinct periods)."""
    if isinstance(n, bool) or not isinstance(n, int):
        raise ValueError(f"holdout_periods must be an int; got {n!r}")
    d = series.select(period_col).distinct()
    total = d.count()  # distinct periods: bounded by the window
    if not 1 <= n <= total - 1:
        raise ValueError(f"holdout_periods must be in [1, {total - 1}]; got {n}")
    return d.orderBy(F.desc(period_col)).limit(n)


def split_holdout(series: DataFrame, n: int, period_col: str = PERIOD):
    """``(train, holdout)``: rows in the ``n`` latest distinct periods form
    the holdout, for all regions together.  The period list has exactly ``n``
    rows, so it is broadcast (semi / anti join)."""
    hp = F.broadcast(holdout_periods(series, n, period_col))
    return series.join(hp, period_col, "left_anti"), series.join(hp, period_col, "left_semi")


def single_series(train: DataFrame, region: Optional[str] = None, value_col: str = DEMAND) -> DataFrame:
    """``(period, y)`` - the total over regions or one region; an unknown
    region raises listing the known ones."""
    df = train
    if region is not None:
        df = df.where(F.col(REGION) == region)
        if not df.take(1):
            known = sorted(r[0] for r in train.select(REGION).distinct().limit(KNOWN_SHOWN).collect())
            raise ValueError(f"region {region!r} not in the series; known regions: {known}")
    out = df.where(F.col(PERIOD).isNotNull()).groupBy(PERIOD).agg(F.sum(value_col).cast("double").alias("y"))
    return out
