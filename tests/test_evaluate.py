from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tripcast.operators import evaluate as E
from tripcast.operators import position as B
from tripcast.operators.forecast import naive as NV
from tripcast.operators.forecast import split as SP


def _long(spark, days=10, regions=("A", "B")):
    rows = [(datetime(2025, 5, 1) + timedelta(days=d), r, d * 10 + i) for d in range(days)
            for i, r in enumerate(regions)]
    return spark.createDataFrame(rows, "period timestamp_ntz, region string, demand long")


def test_split_disjoint_exhaustive_chronological(spark):
    s = _long(spark)
    train, hold = SP.split_holdout(s, 3)
    assert train.count() + hold.count() == s.count()
    assert train.agg(F.max("period")).first()[0] < hold.agg(F.min("period")).first()[0]
    assert hold.select("period").distinct().count() == 3
    for bad in (0, 10, True, 2.0):
        with pytest.raises(ValueError):
            SP.split_holdout(s, bad)


def test_seasonal_naive_rules(spark):
    s = _long(spark, days=9)
    fc = NV.seasonal_naive(s, 9, season=7)
    a = [r["yhat"] for r in fc.where("region = 'A'").orderBy("period").collect()]
    assert a == [20.0, 30.0, 40.0, 50.0, 60.0, 70.0, 80.0, 20.0, 30.0]
    short = NV.seasonal_naive(_long(spark, days=3), 2, season=7)
    assert [r["yhat"] for r in short.where("region = 'A'").collect()] == [20.0, 20.0]


def test_metrics_perfect_and_ordering(spark):
    rows = [(datetime(2025, 5, 1) + timedelta(days=i), float(v), float(v)) for i, v in enumerate([0, 5, 7])]
    df = spark.createDataFrame(rows, "period timestamp_ntz, actual double, yhat double")
    m = E.error_metrics(df).first()
    assert (m["mae"], m["rmse"], m["mape"]) == (0.0, 0.0, 0.0)
    m2 = E.error_metrics(df.withColumn("yhat", F.col("yhat") + F.col("actual") * 0.5 + 1)).first()
    assert m2["rmse"] >= m2["mae"] > 0


def _table(spark, rows):
    return spark.createDataFrame(rows, "ordinal int, model_name string, mae double, rmse double, mape double, "
                                       "excluded boolean, excluded_reason string")


def test_carry_forward_bounds(spark):
    rows = [(i, f"m{i}", float(10 - i), 1.0, 1.0, False, None) for i in range(7)]
    sel = E.select_carry_forward(_table(spark, rows)).orderBy("cf_rank").collect()
    assert [r["model_name"] for r in sel] == ["m6", "m5", "m4", "m3", "m2"]
    rows2 = [(0, "a", 1.0, 1.0, 1.0, False, None), (1, "b", None, None, None, True, "x"),
             (2, "c", None, None, None, True, "y"), (3, "d", None, None, None, True, "z")]
    sel2 = [r["model_name"] for r in E.select_carry_forward(_table(spark, rows2)).orderBy("cf_rank").collect()]
    assert sel2 == ["a", "b", "c"]
    rows3 = [(0, "a", 2.0, 1.0, 1.0, False, None), (1, "a", 1.0, 1.0, 1.0, False, None)]
    assert E.select_carry_forward(_table(spark, rows3)).count() == 1


def test_error_by_period_first_appearance(spark):
    rows = [(datetime(2025, 5, 1) + timedelta(days=i), float(i), float(i + 1), b)
            for i, b in enumerate(["weekend", "weekday", "weekend", "holiday"])]
    df = spark.createDataFrame(rows, "period timestamp_ntz, actual double, yhat double, bucket string")
    out = E.error_by_period(df).orderBy("bucket_order").collect()
    assert [r["bucket"] for r in out] == ["weekend", "weekday", "holiday"]
    assert sum(r["n_periods"] for r in out) == 4


def test_score_models_keeps_exclusions(spark):
    act = spark.createDataFrame([(datetime(2025, 5, 1), 10.0), (datetime(2025, 5, 2), 20.0)],
                                "period timestamp_ntz, actual double")
    fc = spark.createDataFrame([("m", datetime(2025, 5, 1), 11.0), ("m", datetime(2025, 5, 2), 19.0),
                                ("half", datetime(2025, 5, 1), 10.0)], "model string, period timestamp_ntz, yhat double")
    st = spark.createDataFrame([("VAR", True, "needs 2 regions")], "model string, excluded boolean, reason string")
    t = {r["model_name"]: r for r in E.score_models(fc, act, st).collect()}
    assert t["m"]["mae"] == 1.0 and not t["m"]["excluded"]
    assert t["half"]["excluded"] and t["half"]["mae"] is None
    assert t["VAR"]["excluded"] and t["VAR"]["excluded_reason"] == "needs 2 regions"


def test_placements_and_peak(spark):
    rows = [("m", datetime(2025, 5, 1), "A", 100.0), ("m", datetime(2025, 5, 1), "B", 50.0),
            ("m", datetime(2025, 5, 2), "A", 80.0), ("m", datetime(2025, 5, 2), "B", 200.0),
            ("m", datetime(2025, 5, 3), "B", 7.0), ("m", datetime(2025, 5, 3), "A", 7.0)]
    fc = spark.createDataFrame(rows, "model string, period timestamp_ntz, region string, yhat double")
    pl = {r["period"].day: r["region"] for r in B.placements(fc).collect()}
    assert pl == {1: "A", 2: "B", 3: "A"}
    rec = B.positioning_recommendation(fc).first()
    assert rec["region"] == "B" and rec["predicted_demand"] == 200.0 and "B" in rec["action"]
    empty = spark.createDataFrame([], "period timestamp_ntz, region string, yhat double")
    e = B.positioning_recommendation(empty, by=()).first()
    assert e["predicted_demand"] == 0.0 and e["region"] is None


def test_impact_formula(spark):
    df = spark.createDataFrame([(0.0,), (1000.0,), (1e6,)], "predicted_demand double")
    imp = B.quantify_impact(df, {"trips_per_driver": 10.0, "wait_reduction_pct": 0.5})
    for r in imp.collect():
        d = r["predicted_demand"]
        exp = d * 6.0 * 0.5 + d / 10.0 * 12.0 * 0.25
        assert abs(r["total_minutes_saved"] - exp) < 1e-6
    assert B.check_impact(B.quantify_impact(df)).first()["mismatches"] == 0
    with pytest.raises(ValueError):
        B.quantify_impact(df, {"trips_per_driver": 0})


def test_forecast_without_a_region_is_not_scored(spark):
    from datetime import datetime, timedelta
    days = [datetime(2025, 1, 1) + timedelta(days=d) for d in range(4)]
    hold = spark.createDataFrame([(d, r, 5) for d in days for r in "AB"], "period timestamp_ntz, region string, demand long")
    rows = [("whole", d, r, 5.0) for d in days for r in "AB"] + [("half", d, "A", 10.0) for d in days]
    rows += [("total", d, None, 9.0) for d in days] + [("hole", d, r, None if d == days[0] else 5.0) for d in days for r in "AB"]
    fc = spark.createDataFrame(rows, "model string, period timestamp_ntz, region string, yhat double")
    cover = {r.model: (r.covered, r.expected) for r in E.forecast_coverage(fc, hold).collect()}
    assert cover == {"whole": (8, 8), "half": (4, 8), "total": (4, 4), "hole": (6, 8)}
    table = E.score_models(E.forecast_total(fc, hold.select("period")), E.actual_total(hold),
                           coverage=E.forecast_coverage(fc, hold))
    got = {r.model_name: r for r in table.collect()}
    assert got["half"].excluded and got["half"].mae is None and "4 of 8" in got["half"].excluded_reason
    assert got["hole"].excluded and not got["whole"].excluded and not got["total"].excluded and got["total"].mae == 1.0
