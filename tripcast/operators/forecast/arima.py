"""SARIMA (1,1,1)(1,1,1)7 and SARIMAX per region.

Conditional least squares on the doubly differenced series, minimised with a
small Nelder-Mead in numpy inside a grouped map; forecasts are recursed with
zero future shocks, un-differenced and clipped at 0.  A failing region falls
back to the seasonal-naive rule with a note.  SARIMAX regresses the
differenced series on the differenced exogenous columns first (day-of-week
dummies by default) and models the remainder as above.
"""

from __future__ import annotations

from typing import Optional, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripcast.functions.columns import dow_dummy_cols
from tripcast.operators.forecast.grouped import run_grouped, split_output
from tripcast.params import DEMAND, PERIOD

SEASON = 7
DOW_COLUMNS = tuple(f"dow_{d}" for d in range(1, 7))


def nelder_mead(f, x0, step=0.3, iters=300, tol=1e-8):
    n = len(x0)
    pts = [np.asarray(x0, float)] + [np.asarray(x0, float) + step * np.eye(n)[i] for i in range(n)]
    vals = [f(p) for p in pts]
    for _ in range(iters):
        order = np.argsort(vals)
        pts = [pts[i] for i in order]
        vals = [vals[i] for i in order]
        if abs(vals[-1] - vals[0]) < tol * (1 + abs(vals[0])):
            break
        c = np.mean(pts[:-1], axis=0)
        xr = c + (c - pts[-1])
        fr = f(xr)
        if fr < vals[0]:
            xe = c + 2 * (c - pts[-1])
            fe = f(xe)
            pts[-1], vals[-1] = (xe, fe) if fe < fr else (xr, fr)
        elif fr < vals[-2]:
            pts[-1], vals[-1] = xr, fr
        else:
            xc = c + 0.5 * (pts[-1] - c)
            fc = f(xc)
            if fc < vals[-1]:
                pts[-1], vals[-1] = xc, fc
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                vals = [vals[0]] + [f(p) for p in pts[1:]]
    i = int(np.argmin(vals))
    return pts[i], vals[i]


def _residuals(w, phi, theta, Phi, Theta, s):
    n = len(w)
    e = np.zeros(n)
    for t in range(n):
        ar = (phi * (w[t - 1] if t >= 1 else 0) + Phi * (w[t - s] if t >= s else 0)
              - phi * Phi * (w[t - s - 1] if t >= s + 1 else 0))
        ma = (theta * (e[t - 1] if t >= 1 else 0) + Theta * (e[t - s] if t >= s else 0)
              + theta * Theta * (e[t - s - 1] if t >= s + 1 else 0))
        e[t] = w[t] - ar - ma
    return e


def _difference(y, s):
    return (y[s + 1:] - y[s:-1]) - (y[1:-s] - y[:-s - 1])


def sarima_numpy(y: np.ndarray, horizon: int, exog: Optional[np.ndarray] = None,
                 exog_future: Optional[np.ndarray] = None, s: int = SEASON):
    y = np.asarray(y, float)
    n = len(y)
    if n < 2 * s + 4:
        raise ValueError(f"series too short for seasonal differencing ({n} points)")
    w = _difference(y, s)
    beta = None
    if exog is not None and exog.shape[1]:
        X = np.vstack([_difference(exog[:, j], s) for j in range(exog.shape[1])]).T
        beta, *_ = np.linalg.lstsq(X, w, rcond=None)
        w = w - X @ beta
    sd = w.std() or 1.0  # no mean is taken off: a drift of the twice differenced series is a quadratic trend
    wz = w / sd

    def obj(p):
        phi, theta, Phi, Theta = np.tanh(p)
        e = _residuals(wz, phi, theta, Phi, Theta, s)
        return float(e @ e)
    p, _ = nelder_mead(obj, np.zeros(4))
    phi, theta, Phi, Theta = np.tanh(p)
    e = list(_residuals(wz, phi, theta, Phi, Theta, s))
    ww = list(wz)
    for _ in range(horizon):
        t = len(ww)
        nxt = (phi * ww[t - 1] + Phi * ww[t - s] - phi * Phi * ww[t - s - 1]
               + theta * e[t - 1] + Theta * e[t - s] + theta * Theta * e[t - s - 1])
        ww.append(nxt)
        e.append(0.0)
    wf = np.array(ww[-horizon:]) * sd
    if beta is not None and exog_future is not None:
        full = np.vstack([exog, exog_future])
        Xf = np.vstack([_difference(full[:, j], s) for j in range(full.shape[1])]).T[-horizon:]
        wf = wf + Xf @ beta
    hist = list(y)
    for v in wf:
        t = len(hist)
        hist.append(v + hist[t - 1] + hist[t - s] - hist[t - s - 1])
    return np.clip(np.array(hist[-horizon:]), 0, None)


def _seasonal_naive_np(y, horizon, s=SEASON):
    y = np.asarray(y, float)
    if len(y) == 0:
        return np.zeros(horizon)
    if len(y) < s:
        return np.full(horizon, y[-1])
    last = y[-s:]
    return np.array([last[(h - 1) % s] for h in range(1, horizon + 1)])


def _with_fallback(fit):
    def solver(values, horizon, frame):
        try:
            return fit(values, horizon, frame), None
        except Exception as e:  # noqa: BLE001
            return np.clip(_seasonal_naive_np(values, horizon), 0, None), \
                f"fell back to seasonal naive: {type(e).__name__}: {e}"
    return solver


def forecast_sarima(train: DataFrame, horizon: int, model: str = "SARIMA", value_col: str = DEMAND):
    """each region from its own last period."""
    out = run_grouped(train, _with_fallback(lambda v, h, _: sarima_numpy(v, h)), horizon, model,
                      value_col=value_col, global_last=False)
    return split_output(out)


def forecast_sarimax(train: DataFrame, horizon: int, model: str = "SARIMAX",
                     exog_columns: Optional[Sequence[str]] = None, value_col: str = DEMAND):
    """exogenous regressors; default day-of-week dummies (W4) whose future
    values follow from the calendar; named columns (NULL -> 0) are extended by
    the seasonal-naive rule (F8)."""
    if exog_columns is None:
        t = train.select("*", *dow_dummy_cols(F.col(PERIOD)))
        cols = list(DOW_COLUMNS)
        calendar = True
    else:
        missing = [c for c in exog_columns if c not in train.columns]
        if missing:
            raise KeyError(f"exogenous column(s) {missing} not in the training series")
        t = train.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"__x_{c}")
                                for c in exog_columns]).drop(*exog_columns)
        t = t.select("*", *[F.col(f"__x_{c}").alias(c) for c in exog_columns]).drop(
            *[f"__x_{c}" for c in exog_columns])
        cols = list(exog_columns)
        calendar = False

    def fit(values, horizon, frame):
        X = frame[cols].to_numpy(float)
        if calendar:
            last = pd.Timestamp(frame[PERIOD].max())
            fut = pd.DatetimeIndex([last + pd.Timedelta(days=h) for h in range(1, horizon + 1)])
            Xf = np.array([[1.0 if d.dayofweek == k else 0.0 for k in range(1, 7)] for d in fut])
        else:
            Xf = np.vstack([_seasonal_naive_np(X[:, j], horizon) for j in range(X.shape[1])]).T
        return sarima_numpy(values, horizon, X, Xf)
    out = run_grouped(t, _with_fallback(fit), horizon, model, value_col=value_col,
                      global_last=False, extra_cols=tuple(cols))
    return split_output(out)
