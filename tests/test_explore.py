import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripcast.operators import explore as X
from tripcast.operators import features as W
from tripcast.operators.kendall import tau_b


def _series(spark, values, start=datetime(2025, 5, 1)):
    rows = [(start + timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "period timestamp_ntz, y double")


def _fixture_i(n=120, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return 1000 + 5 * t + 200 * np.sin(2 * np.pi * t / 7) + rng.normal(0, 25, n)


def test_decompose_recovers_weekly_season(spark):
    y = _series(spark, _fixture_i())
    dec = X.seasonal_decompose(y, 7)
    s = dec.select("seasonal").distinct().count()
    assert s == 7
    st = X.decomposition_strength(dec).first()
    assert st["seasonal_strength"] > 0.8 and st["trend_direction"] == "rising"
    with pytest.raises(ValueError):
        X.seasonal_decompose(_series(spark, range(10)), 7)


def test_spike_is_flagged(spark):
    v = _fixture_i()
    v[60] = 5 * v.max()
    a = X.detect_anomalies(_series(spark, v)).collect()
    assert any(r["period"] == datetime(2025, 5, 1) + timedelta(days=60) and r["direction"] == "spike" for r in a)
    with pytest.raises(ValueError):
        X.detect_anomalies(_series(spark, v), window=1)


def test_rolling_median_edges_match_pandas(spark):
    import pandas as pd
    v = [5.0, 1.0, 9.0, 3.0, 7.0, 2.0]
    for w in (3, 4):
        got = [r["local_median"] for r in W.rolling_median(_series(spark, v), w).orderBy("period").collect()]
        exp = pd.Series(v).rolling(w, center=True, min_periods=2).median().tolist()
        assert np.allclose(got, exp, equal_nan=True), (w, got, exp)


def test_moving_average_even_period_matches_two_by_ma(spark):
    v = np.arange(20, dtype=float) ** 1.5
    got = [r["trend"] for r in W.centered_moving_average(_series(spark, v), 4).orderBy("period").collect()]
    w = np.array([0.5, 1, 1, 1, 0.5]) / 4
    exp = [None, None] + list(np.convolve(v, w, mode="valid")) + [None, None]
    for g, e in zip(got, exp):
        assert (g is None and e is None) or abs(g - e) < 1e-9


def test_acf_and_pacf_against_numpy(spark):
    v = _fixture_i(80, 3)
    rows = X.acf(_series(spark, v), nlags=10).orderBy("lag").collect()
    x = v - v.mean()
    exp = [float(np.sum(x[: len(x) - k] * x[k:]) / np.sum(x * x)) for k in range(11)]
    assert np.allclose([r["acf"] for r in rows], exp)
    assert abs(rows[0]["band"] - 1.96 / math.sqrt(80)) < 1e-12
    r = np.array(exp)
    p = [q["pacf"] for q in X.pacf(X.acf(_series(spark, v), nlags=10)).orderBy("lag").collect()]
    assert len(p) == 11 and p[0] == 1.0
    for k in range(1, 11):  # Yule-Walker solve for AR(k): last coefficient
        R = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        phi = np.linalg.solve(R, r[1:k + 1])
        assert abs(phi[-1] - p[k]) < 1e-9


def _adf_by_least_squares(x):
    """The regression on whole design matrices: (statistic, lag)."""
    x, dx = np.asarray(x, float), np.diff(x)
    n = len(x)
    maxlag = min(n // 2 - 2, math.ceil(12 * (n / 100) ** 0.25))

    def regress(lag, rows):
        z = np.column_stack([np.ones(rows), x[-rows - 1:-1], *[dx[-rows - j:-j] for j in range(1, lag + 1)]])
        beta, *_ = np.linalg.lstsq(z, dx[-rows:], rcond=None)
        return z, beta, float(((dx[-rows:] - z @ beta) ** 2).sum())
    rows = n - 1 - maxlag
    aic = [rows * math.log(regress(lag, rows)[2] / rows) + 2 * lag for lag in range(maxlag + 1)]
    lag = int(np.argmin(aic))
    z, beta, ssr = regress(lag, n - 1 - lag)
    return beta[1] / math.sqrt(ssr / (len(z) - z.shape[1]) * np.linalg.inv(z.T @ z)[1, 1]), lag


def test_adf_against_least_squares_and_odd_series(spark):
    rng = np.random.default_rng(1)
    series = {"walk": np.cumsum(rng.normal(size=300)) + 1000, "noise": rng.normal(size=300), "short": rng.normal(size=30),
              "tiny": rng.normal(size=9), "flat": np.full(50, 7.0), "three": np.array([1.0, 2.0, 4.0]),
              "line": np.arange(40.0), "ar": np.convolve(rng.normal(size=420), 0.9 ** np.arange(20))[20:400]}
    rows = [(k, datetime(2025, 1, 1) + timedelta(days=i), float(x)) for k, v in series.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "region string, period timestamp_ntz, y double")
    got = {r.region: r for r in X.adf_test(df, by=["region"]).collect()}
    for k in ("walk", "noise", "short", "tiny", "ar"):
        stat, lag = _adf_by_least_squares(series[k])
        assert got[k].used_lag == lag and abs(got[k].adf_stat - stat) < 1e-6 * max(1, abs(stat)), k
    assert got["noise"].p_value < 0.01 < got["walk"].p_value
    assert got["flat"].status == "constant series" and got["three"].status == "too few observations"
    assert got["line"].adf_stat is None and got["line"].status != "ok"
    assert 0.0 <= X.adf_pvalue(-2.0) <= 1.0
    one = X.adf_test(df.where("region = 'noise'").drop("region")).collect()
    assert len(one) == 1 and abs(one[0].adf_stat - got["noise"].adf_stat) < 1e-9
    assert X.adf_lag0(df, by=["region"]).where("region = 'flat'").first().adf_stat is None


def test_decomposition_keeps_short_and_zero_series(spark):
    rows = [("long", datetime(2025, 1, 1) + timedelta(days=i), float(i % 7)) for i in range(40)]
    rows += [("short", datetime(2025, 1, 1) + timedelta(days=i), 1.0) for i in range(5)]
    rows += [("zero", datetime(2025, 1, 1) + timedelta(days=i), 0.0) for i in range(30)]
    df = spark.createDataFrame(rows, "region string, period timestamp_ntz, y double")
    for model in ("additive", "multiplicative"):
        got = X.seasonal_decompose(df, model=model, by=["region"])
        assert got.count() == 75 and got.where("region = 'short' and trend is not null").count() == 0
        assert got.where("region = 'long' and trend is not null").count() > 20
    with pytest.raises(ValueError):
        X.seasonal_decompose(df.where("region = 'short'"), by=["region"])


def _tau_by_pairs(x, y):
    ok = ~(np.isnan(x) | np.isnan(y))
    x, y = x[ok], y[ok]
    sx, sy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    return (sx * sy).sum() / math.sqrt((sx != 0).sum() * (sy != 0).sum())


def test_kendall_matches_bruteforce(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for k, n in enumerate((2, 3, 10, 40, 200, 700)):
        for kind in ("ties", "hot", "free", "gaps"):
            x = rng.integers(0, 5, n).astype(float) if kind == "ties" else rng.normal(size=n)
            if kind == "hot":
                x[: n // 3] = 0.25
            y = x + (rng.integers(0, 3, n) if kind == "ties" else rng.normal(size=n))
            if kind == "gaps" and n > 3:
                x[::5], y[1::7] = np.nan, np.nan
            if len(set(x)) > 1 and len(set(y)) > 1:
                want[f"{kind}-{k}"] = _tau_by_pairs(x, y)
            rows += [(f"{kind}-{k}", None if np.isnan(a) else float(a), float(b)) for a, b in zip(x, y)]
    rows += [("flat", 1.0, float(i)) for i in range(9)] + [("one", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "k string, a double, b double")
    got = {r.k: r.r for r in tau_b(df, ["k"], "a", "b").collect()}
    assert got.pop("flat") is None and got.pop("one") is None
    for k, r in want.items():
        assert abs(got[k] - r) < 1e-12, k


def test_kendall_of_demand_is_symmetric(spark):
    y = _series(spark, _fixture_i(60))
    got = {(r["x"], r["y"]): r["r"] for r in X.demand_correlations(y, method="kendall").collect()}
    assert len(got) == 25 and all(got[(b, a)] == r for (a, b), r in got.items()) and got[("demand", "demand")] == 1.0


def test_correlations_constant_column_is_null(spark):
    y = _series(spark, _fixture_i(28))
    ex = y.select("period", (F.col("y") + 1).alias("close"), F.lit(3.0).alias("flat"))
    got = {(r["x"], r["y"]): r["r"] for r in X.demand_correlations(y, exog=ex).collect()}
    assert abs(got[("demand", "close")] - 1.0) < 1e-9 and got[("demand", "flat")] is None
    rank = X.correlation_ranking(X.demand_correlations(y)).orderBy("rank").collect()
    assert rank[0]["variable"] in ("day_of_week", "is_weekend", "day_of_month", "month")
