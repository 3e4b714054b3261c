"""Integration: every model family on 3 regions x 90 days, horizon 14."""
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripcast.operators.forecast import train as TR
from tripcast.operators.forecast.var import forecast_var

H = 14


@pytest.fixture(scope="module")
def fixture_h(spark):
    rng = np.random.default_rng(0)
    rows = []
    for level, reg in ((200, "A"), (260, "B"), (320, "C")):
        for t in range(90):
            v = level + 0.5 * t + 30 * np.sin(2 * np.pi * t / 7) + rng.normal(0, 5)
            rows.append((datetime(2025, 1, 1) + timedelta(days=t), reg, int(round(v))))
    return spark.createDataFrame(rows, "period timestamp_ntz, region string, demand long").cache()


def test_all_models_aligned_finite(spark, fixture_h):
    cands = TR.default_candidates(dict(maxIter=10, maxDepth=3, stepSize=0.3, seed=0))
    fc, st = TR.train_all(cands, fixture_h, H)
    bad = st.where("excluded").collect()
    assert not bad, bad
    per = {r["model"]: r["n"] for r in fc.groupBy("model").agg(F.count_distinct("period").alias("n")).collect()}
    assert set(per) == set(cands) and all(v == H for v in per.values())
    vals = [r["yhat"] for r in fc.collect()]
    assert all(np.isfinite(v) for v in vals)
    first = datetime(2025, 1, 1) + timedelta(days=90)
    assert fc.agg(F.min("period")).first()[0] == first
    clipped = fc.where(F.col("model").isin("SARIMA", "Boosted-Trees", "Windowed-LR"))
    assert clipped.where("yhat < 0").count() == 0
    hw = fc.where("model = 'Holt-Winters' AND region = 'A'").orderBy("period").collect()
    assert 180 < np.mean([r["yhat"] for r in hw]) < 320


def test_var_single_region_excluded(spark, fixture_h):
    fc, st = forecast_var(fixture_h.where("region = 'A'"), H)
    r = st.first()
    assert r["excluded"] and "2 regions" in r["reason"] and fc.count() == 0


def test_failure_isolated(spark, fixture_h):
    def boom(t, h):
        raise RuntimeError("boom")
    fc, st = TR.train_all({"Bad": boom, "Seasonal-Naive": TR.default_candidates()["Seasonal-Naive"]},
                          fixture_h, H)
    got = {r["model"]: r["excluded"] for r in st.collect()}
    assert got["Bad"] and not got["Seasonal-Naive"]
    assert fc.select("model").distinct().count() == 1


def _least_squares_var(y, horizon, order):
    """AIC over whole design matrices, refit, recursion."""
    n, k = y.shape

    def regress(p, first):
        z = np.column_stack([np.ones(n - first)] + [y[first - j:n - j] for j in range(1, p + 1)])
        return np.linalg.lstsq(z, y[first:], rcond=None)[0], z

    def aic(p):
        b, z = regress(p, order)
        e = y[order:] - z @ b
        return np.linalg.slogdet(e.T @ e / (n - order))[1] + 2 / (n - order) * p * k * k
    p = max(1, int(np.argmin([aic(q) for q in range(order + 1)])))
    b, _ = regress(p, p)
    past = list(y)
    for _ in range(horizon):
        past.append(np.concatenate([[1.0], *[past[-j] for j in range(1, p + 1)]]) @ b)
    return p, np.array(past[n:])


def test_var_equals_least_squares(spark, fixture_h):
    y = np.array([[r[c] for c in "ABC"] for r in fixture_h.groupBy("period").pivot("region").sum("demand")
                  .orderBy("period").collect()], float)
    for maxlags in (None, 2):
        fc, st = forecast_var(fixture_h, H, maxlags=maxlags)
        p, want = _least_squares_var(y, H, maxlags or 7)
        got = np.array([[r[c] for c in "ABC"] for r in fc.groupBy("period").pivot("region").sum("yhat")
                        .orderBy("period").collect()])
        assert st.first().reason == f"lag order {p}" and np.abs(got - want).max() < 1e-5
    plan = fc._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    gap = fixture_h.where("not (region = 'B' and period = timestamp'2025-01-20 00:00:00')")
    assert forecast_var(gap, H)[1].first().excluded


def _holt_winters_loop(y, a, b, g, season=7):
    n = len(y)
    seasonal, trended = n >= 2 * season, n >= 3
    level = y[:season].mean() if seasonal else y[0]
    trend = (y[season:2 * season].mean() - level) / season if seasonal else (y[1] - y[0] if trended else 0.0)
    s = list(y[:season] - level) if seasonal else [0.0]
    sse = 0.0
    for v in y:
        now = s.pop(0)
        sse += (v - level - trend - now) ** 2
        new = a * (v - now) + (1 - a) * (level + trend)
        trend = b * (new - level) + (1 - b) * trend if trended else 0.0
        s.append(g * (v - new) + (1 - g) * now if seasonal else 0.0)
        level = new
    return sse, [level + h * trend + s[(h - 1) % len(s)] for h in range(1, H + 1)]


def test_holt_winters_fold(spark, fixture_h):
    from tripcast.operators.forecast import smoothing as HW
    short = [(datetime(2025, 3, 25) + timedelta(days=t), r, v) for r, vs in
             (("S", [5, 7, 6, 9, 8]), ("T", [4, 6]), ("U", [3])) for t, v in enumerate(vs)]
    gone = [(datetime(2025, 3, 25) + timedelta(days=t), "N", None) for t in range(20)]
    df = fixture_h.unionByName(spark.createDataFrame(short + gone, "period timestamp_ntz, region string, demand long"))
    series = {r.region: [q.demand for q in df.where(F.col("region") == r.region).orderBy("period").collect()]
              for r in df.select("region").distinct().collect()}
    fitted = {r.region: r for r in HW.fitted_series(df).collect()}
    assert set(fitted) == set(series) - {"N"}
    for region, r in fitted.items():
        sse, want = _holt_winters_loop(np.array(series[region], float), r.p.a, r.p.b, r.p.g)
        assert abs(r.state.sse - sse) < 1e-6 * max(1, sse)
        for a in (0.05, 0.3, 0.9):  # no set of the first grid is better
            for b in HW.BETAS:
                for g in HW.GAMMAS:
                    assert r.state.sse <= _holt_winters_loop(np.array(series[region], float), a, b, g)[0] + 1e-6
    fc, st = HW.forecast_holt_winters(df, H)
    got = {r.region: r for r in st.collect()}
    assert got["N"].excluded and not got["A"].excluded and got["S"].reason == HW.FALLBACK
    a = [r.yhat for r in fc.where("region = 'A'").orderBy("period").collect()]
    assert np.allclose(a, _holt_winters_loop(np.array(series["A"], float), *fitted["A"].p)[1])
    assert fc.where("region = 'N'").count() == 0 and fc.groupBy("region").count().where(f"count <> {H}").count() == 0


def test_boosted_recursion_equals_the_model(spark, fixture_h):
    """The fold over stored trees against Spark ML's own predictions, step by step."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    from tripcast.operators.forecast import gbt as G
    from tripcast.operators.prepare import add_lag_features
    params = dict(maxIter=8, maxDepth=3, stepSize=0.3, seed=0)
    got = {(r.region, r.period): r.yhat for r in G.forecast_gbt(fixture_h, 9, params=params).collect()}
    base = fixture_h.select("period", "region", F.col("demand").cast("double").alias("demand")).coalesce(1)
    feats, names = G._features(add_lag_features(base, [1, 7, 14]), [1, 7, 14], ["A", "B", "C"])
    va = VectorAssembler(inputCols=names, outputCol="features")
    model = GBTRegressor(featuresCol="features", labelCol="demand", **params).fit(va.transform(feats).select("features", "demand"))
    history = base.select("region", "period", F.col("demand").alias("value"))
    close = 0
    for h in range(9):
        day = datetime(2025, 1, 1) + timedelta(days=90 + h)
        step = spark.createDataFrame([(r, day) for r in "ABC"], "region string, period timestamp_ntz")
        pred = model.transform(va.transform(G._features(G.recursive_features(history, step, [1, 7, 14]), [1, 7, 14], ["A", "B", "C"])[0]))
        rows = [(r.region, r.period, max(r.prediction, 0.0)) for r in pred.collect()]
        close += sum(abs(got[(r, p)] - v) < 0.05 * abs(v) for r, p, v in rows)
        history = history.unionByName(spark.createDataFrame([(r, p, got[(r, p)]) for r, p, _ in rows],
                                                            "region string, period timestamp_ntz, value double"))
    assert close == 27


def test_region_lists_are_bounded(spark):
    from tripcast.operators.explore import region_list
    many = spark.range(1200).select(F.col("id").cast("string").alias("region"))
    with pytest.raises(ValueError):
        region_list(many)
    assert region_list(many.limit(3).unionByName(spark.createDataFrame([(None,)], "region string"))) == ["0", "1", "2"]
