"""Run a per-series numpy solver as a grouped map (one small series per group).

The Spark plan shuffles the training rows by series key; each task receives
the rows of whole series (a daily series is bounded by the analysis window,
<= 731 rows), fits, and emits the horizon's forecast rows plus a status.  A
failing series is caught inside its group and reported, never failing the job.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripcast.params import DEMAND, PERIOD, REGION

OUT_SCHEMA = ("model string, period timestamp_ntz, region string, yhat double, "
              "excluded boolean, reason string")


def run_grouped(train: DataFrame, solver: Callable[[np.ndarray, int, pd.DataFrame], tuple],
                horizon: int, model: str, *, value_col: str = DEMAND, by: str = REGION,
                global_last: bool = True, step_days: int = 1,
                extra_cols: tuple = ()) -> DataFrame:
    """``solver(values, horizon, frame) -> (yhat array, note or None)``.

    ``global_last``: the future axis starts after the latest period of the
    whole training set (as Holt-Winters does); otherwise after each series'
    own last period.
    """
    last_all = train.agg(F.max(PERIOD)).first()[0] if global_last else None  # one scalar
    cols = [by, PERIOD, F.col(value_col).cast("double").alias("__y"), *extra_cols]

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(PERIOD)
        key = pdf[by].iloc[0]
        last = pd.Timestamp(last_all) if last_all is not None else pd.Timestamp(pdf[PERIOD].max())
        periods = [last + pd.Timedelta(days=step_days * h) for h in range(1, horizon + 1)]
        try:
            yhat, note = solver(pdf["__y"].to_numpy(dtype=float), horizon, pdf)
            yhat = np.asarray(yhat, dtype=float)
            if yhat.shape != (horizon,) or not np.all(np.isfinite(yhat)):
                raise ValueError("solver returned a non-finite or misshaped forecast")
            return pd.DataFrame({"model": model, PERIOD: periods, REGION: str(key), "yhat": yhat,
                                 "excluded": False, "reason": note})
        except Exception as e:  # noqa: BLE001 - isolate the failing series
            return pd.DataFrame({"model": [model], PERIOD: [pd.NaT], REGION: [str(key)],
                                 "yhat": [np.nan], "excluded": [True],
                                 "reason": [f"{type(e).__name__}: {e}"]})
    return train.select(*cols).groupBy(by).applyInPandas(fn, OUT_SCHEMA)


def split_output(out: DataFrame):
    """``(forecasts, status)`` from a grouped-map result."""
    fc = out.where(~F.col("excluded")).select("model", PERIOD, REGION, "yhat")
    st = out.groupBy("model", REGION).agg(F.bool_or("excluded").alias("excluded"),
                                          F.max("reason").alias("reason"))
    return fc, st
