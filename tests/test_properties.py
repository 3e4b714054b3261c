"""Hypothesis properties of the core operators.

Where the operator takes grouping keys (metrics), a whole batch of generated
cases is tagged with ``case_id`` and checked in one grouped job; the others
run one small job per case.
"""
from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tripcast.operators import evaluate as E
from tripcast.operators import position as B
from tripcast.operators import prepare as P
from tripcast.params import TEST_SCOPE

SETTINGS = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))

case = st.lists(st.tuples(st.integers(0, 364), st.sampled_from(["A", "B"]), st.integers(1, 5000)),
                min_size=0, max_size=40)


@SETTINGS
@given(st.lists(case, min_size=1, max_size=6))
def test_zero_fill_grid_property(spark, cases):
    """Property 4: exactly one row per (period, region) in the window; 0 where unobserved."""
    start = datetime(1997, 1, 1)
    rows = [(cid, start + timedelta(days=d), r, v) for cid, c in enumerate(cases) for d, r, v in c]
    df = spark.createDataFrame(rows, "case_id int, period timestamp_ntz, region string, demand long")
    for cid, c in enumerate(cases):
        sub = df.where(F.col("case_id") == cid).drop("case_id")
        filled = P.fill_missing_periods(sub, TEST_SCOPE, regions=["A", "B"])
        got = {(r["period"], r["region"]): r["demand"] for r in filled.collect()}
        assert len(got) == 365 * 2
        exp = {}
        for d, r, v in c:
            k = (start + timedelta(days=d), r)
            exp[k] = exp.get(k, 0) + v
        assert all(got[k] == exp.get(k, 0) for k in got)


vals = st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=60)


@SETTINGS
@given(st.lists(st.tuples(vals, st.floats(-1e3, 1e3, allow_nan=False)), min_size=1, max_size=8))
def test_metrics_property(spark, cases):
    """Property 8: metrics >= 0, zero on a perfect forecast, RMSE >= MAE (whole batch in one job)."""
    rows = []
    for cid, (actual, shift) in enumerate(cases):
        for i, a in enumerate(actual):
            rows.append((cid, datetime(2025, 1, 1) + timedelta(days=i), a, a + shift * (i % 3), a))
    df = spark.createDataFrame(rows, "case_id int, period timestamp_ntz, actual double, yhat double, perfect double")
    m = E.error_metrics(df, by=["case_id"]).collect()
    p = E.error_metrics(df.withColumn("yhat", F.col("perfect")), by=["case_id"]).collect()
    for r in m:
        assert r["mae"] >= 0 and r["mape"] >= 0 and r["rmse"] + 1e-9 >= r["mae"]
    assert all(r["mae"] == 0 and r["rmse"] == 0 and r["mape"] == 0 for r in p)


@SETTINGS
@given(st.lists(st.tuples(st.floats(0, 1e6), st.floats(0.1, 50), st.floats(0, 1)), min_size=1, max_size=20))
def test_impact_property(spark, cases):
    """Property 12: the impact equals the recomputed formula."""
    df = spark.createDataFrame([(d,) for d, _, _ in cases], "predicted_demand double")
    tpd, pct = cases[0][1], cases[0][2]
    imp = B.quantify_impact(df, {"trips_per_driver": tpd, "idle_reduction_pct": pct})
    for r in imp.collect():
        d = r["predicted_demand"]
        exp = d * 6.0 * 0.30 + d / tpd * 12.0 * pct
        assert abs(r["total_minutes_saved"] - exp) <= 1e-6 * max(1.0, abs(exp))


names = st.lists(st.sampled_from(list("abcdefgh")), min_size=3, max_size=8, unique=True)


@SETTINGS
@given(names, st.data())
def test_carry_forward_property(spark, ns, data):
    """Property 11: 3-5 names, all present, scored before unscored."""
    rows = []
    for i, n in enumerate(ns):
        scored = data.draw(st.booleans())
        mae = data.draw(st.floats(0, 100)) if scored else None
        rows.append((i, n, mae, mae, mae, not scored, None if scored else "x"))
    t = spark.createDataFrame(rows, "ordinal int, model_name string, mae double, rmse double, mape double, "
                                    "excluded boolean, excluded_reason string")
    sel = E.select_carry_forward(t).orderBy("cf_rank").collect()
    assert 3 <= len(sel) <= 5 and all(r["model_name"] in ns for r in sel)
    flags = [r["mae"] is not None for r in sel]
    assert flags == sorted(flags, reverse=True)


trip = st.tuples(st.one_of(st.none(), st.integers(0, 90)), st.one_of(st.none(), st.sampled_from(["A", "B", "C"])))


@SETTINGS
@given(st.lists(trip, min_size=0, max_size=80))
def test_aggregation_property(spark, trips):
    """Property 3: per-bucket counts equal a direct count; total = rows with both keys."""
    from tripcast.operators import prepare as PP
    base = datetime(2025, 5, 1, 7, 30)
    rows = [(None if d is None else base + timedelta(days=d, hours=d % 5), r) for d, r in trips]
    df = spark.createDataFrame(rows, "pickup_datetime timestamp_ntz, region string")
    got = {(r["period"], r["region"]): r["demand"] for r in PP.aggregate_demand(df).collect()}
    exp = {}
    for d, r in trips:
        if d is not None and r is not None:
            k = (datetime(2025, 5, 1) + timedelta(days=d), r)
            exp[k] = exp.get(k, 0) + 1
    assert got == exp


violation = st.sampled_from(["ok", "outside", "negative", "both"])


@SETTINGS
@given(st.lists(violation, min_size=0, max_size=40))
def test_validity_property(spark, kinds):
    """Property 5: nothing invalid remains; handled count = injected invalid rows."""
    from tripcast.operators import quality as QQ
    rows = []
    for i, k in enumerate(kinds):
        ts = datetime(2026, 3, 28) if k in ("outside", "both") else datetime(2026, 4, 1 + i % 28)
        fare = -1.0 if k in ("negative", "both") else 10.0
        rows.append((i, ts, fare))
    df = spark.createDataFrame(rows, "row_id long, pickup_datetime timestamp_ntz, base_passenger_fare double")
    clean, log = QQ.apply_validity_rules(df, stated_month=(2026, 4))
    lg = log.first()
    assert lg["total_invalid_handled"] == sum(k != "ok" for k in kinds)
    assert lg["output_row_count"] == kinds.count("ok") == clean.count()
    assert QQ.flag_domain_violations(clean, stated_month=(2026, 4)).count() == 0


@SETTINGS
@given(st.integers(2, 25), st.integers(1, 4), st.data())
def test_split_property(spark, days, regions, data):
    """Property 7: disjoint, exhaustive, chronological, n distinct holdout periods."""
    from tripcast.operators.forecast.split import split_holdout
    n = data.draw(st.integers(1, days - 1))
    rows = [(datetime(2025, 5, 1) + timedelta(days=d), f"R{r}", d) for d in range(days) for r in range(regions)]
    df = spark.createDataFrame(rows, "period timestamp_ntz, region string, demand long")
    train, hold = split_holdout(df, n)
    tr, ho = train.collect(), hold.collect()
    assert len(tr) + len(ho) == len(rows)
    assert len({r["period"] for r in ho}) == n
    assert max(r["period"] for r in tr) < min(r["period"] for r in ho)


@SETTINGS
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-5, 5)),
                          st.one_of(st.none(), st.floats(-1e3, 1e3), st.just(float("nan"))),
                          st.one_of(st.none(), st.text(max_size=3))), min_size=0, max_size=12))
def test_profiling_property(spark, rows):
    """Property 1: null counts / percentages equal the ground truth (NaN = missing)."""
    from tripcast.operators import quality as QQ
    df = spark.createDataFrame(rows, "a long, b double, c string")
    got = {r["column"]: (r["null_count"], r["null_pct"]) for r in QQ.profile_nulls(df).collect()}
    n = len(rows)
    exp = {"a": sum(r[0] is None for r in rows),
           "b": sum(r[1] is None or r[1] != r[1] for r in rows),
           "c": sum(r[2] is None for r in rows)}
    for c, k in exp.items():
        assert got[c][0] == k and abs(got[c][1] - (100.0 * k / n if n else 0.0)) < 1e-9


@SETTINGS
@given(st.dictionaries(st.sampled_from(["A", "B", "C", "D"]), st.integers(1, 20), min_size=1),
       st.sampled_from([[1], [1, 7], [2, 3], [1, 2, 3, 7]]), st.randoms())
def test_lag_property(spark, lengths, lags, rnd):
    """Property 6: lag within region, NULL for the first k, shuffled input, rows kept."""
    from tripcast.operators import prepare as PP
    rows = [(datetime(2025, 5, 1) + timedelta(days=d), r, 1000 * i + d)
            for i, (r, n) in enumerate(sorted(lengths.items())) for d in range(n)]
    rnd.shuffle(rows)
    out = PP.add_lag_features(spark.createDataFrame(rows, "period timestamp_ntz, region string, demand long"), lags)
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        d = (r["period"] - datetime(2025, 5, 1)).days
        for k in lags:
            exp = None if d < k else float(r["demand"] - k)
            assert r[f"lag_{k}"] == exp


@SETTINGS
@given(st.integers(1, 20), st.sampled_from([None, "period", "region", "demand"]),
       st.sampled_from(["drop", "corrupt"]))
def test_contract_property(spark, n, column, how):
    """Property 13: conforming data passes; the missing / corrupted column is named."""
    from tripcast.operators import quality as QQ
    rows = [(f"2025-05-{1 + i % 28:02d}", f"R{i % 3}", str(i)) for i in range(n)]
    if column and how == "corrupt":
        bad = {"period": "not-a-date", "region": None, "demand": "3.5"}[column]
        idx = {"period": 0, "region": 1, "demand": 2}[column]
        r = list(rows[-1])
        r[idx] = bad
        rows[-1] = tuple(r)
    df = spark.createDataFrame(rows, "period string, region string, demand string")
    if column == "region" and how == "corrupt":
        df = df.withColumn("region", F.length("region"))  # numbers where text is expected
    if column and how == "drop":
        df = df.drop(column)
    got = QQ.check_contract(df).first()
    assert got["ok"] == (column is None) and got["offending_column"] == column
