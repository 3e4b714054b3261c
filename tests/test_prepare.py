import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tripcast.operators import prepare as P
from tripcast.operators import quality as Q
from tripcast.params import TEST_SCOPE, Scope
from tripcast.sources import tables as T

from conftest import SF


def test_lookup_join_no_fanout_and_unmatched(spark):
    trips = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, None)], "row_id long, PULocationID long")
    lookup = spark.createDataFrame([(10, "B"), (10, "A"), (20, "C")], "LocationID long, Borough string")
    out = {r["row_id"]: r["region"] for r in P.map_zones_to_regions(trips, lookup).collect()}
    assert out == {1: "A", 2: "C", 3: None, 4: None}


def test_counts_equal_direct_groupby_both_plans(spark):
    trips = T.trips_orders(spark, SF)
    lookup = T.zone_lookup_customers(spark, SF)
    small = P.aggregate_demand_by_zone(trips, lookup, TEST_SCOPE)
    big = P.aggregate_demand(P.map_zones_to_regions(trips, lookup), TEST_SCOPE)
    mapped = P.map_zones_to_regions(trips, lookup)
    direct = P.aggregate_demand(mapped, TEST_SCOPE)
    a, b, c = (sorted(map(tuple, d.collect())) for d in (small, big, direct))
    assert a == b == c
    assert sum(r[2] for r in a) == trips.where("pickup_datetime IS NOT NULL").count()


def test_zero_fill_one_row_per_key(spark):
    rng = random.Random(0)
    start = TEST_SCOPE.window_start
    rows = [(datetime.combine(start, datetime.min.time()) + timedelta(days=rng.randrange(365)),
             rng.choice(["A", "B"]), rng.randint(1, 5000)) for _ in range(40)]
    rows.append((datetime(1990, 1, 1), "A", 7))  # outside the window: vanishes
    s = spark.createDataFrame(rows, "period timestamp_ntz, region string, demand long")
    filled = P.fill_missing_periods(s, TEST_SCOPE)
    chk = Q.check_grid(filled).first()
    assert chk["rows"] == 365 * 2 and chk["complete"]
    inside = sum(r[2] for r in rows[:-1])
    assert filled.agg(F.sum("demand")).first()[0] == inside


def test_lags_within_region_shuffled(spark):
    rows = []
    for reg, n in (("A", 10), ("B", 4)):
        for i in range(n):
            rows.append((datetime(2025, 5, 1) + timedelta(days=i), reg, i * 10 + (reg == "B")))
    random.Random(1).shuffle(rows)
    s = spark.createDataFrame(rows, "period timestamp_ntz, region string, demand long")
    out = P.add_lag_features(s, [7, 1, 1])
    assert [c for c in out.columns if c.startswith("lag_")] == ["lag_1", "lag_7"]
    got = {(r["region"], r["period"]): (r["lag_1"], r["lag_7"]) for r in out.collect()}
    assert got[("A", datetime(2025, 5, 1))] == (None, None)
    assert got[("A", datetime(2025, 5, 9))] == (70.0, 10.0)
    assert got[("B", datetime(2025, 5, 4))] == (21.0, None)
    assert Q.check_lags(out, [1, 7]).where("mismatches > 0").count() == 0


def test_lag_validation(spark):
    s = spark.createDataFrame([], "period timestamp_ntz, region string, demand long")
    import pytest
    for bad in ([0], [True], [1.5]):
        with pytest.raises(ValueError):
            P.add_lag_features(s, bad)
    assert "lag_3" in P.add_lag_features(s, [3]).columns


def test_truncate_rejects_other_grains():
    import pytest
    with pytest.raises(ValueError):
        P.truncate_to_grain(F.col("x"), "hourly")


def test_prepare_reconciles(spark):
    trips = T.trips_orders(spark, SF)
    lookup = T.zone_lookup_customers(spark, SF)
    series, log, audit = P.prepare(trips, lookup, TEST_SCOPE, regions=T.region_names(spark, SF),
                                   stated_month=None, audit=True)
    stages = {r["stage"]: r["rows"] for r in audit.collect()}
    assert stages["raw"] == trips.count() and stages["series"] == 365 * 5
    in_window = trips.where(F.col("pickup_datetime").cast("date").between(date(1997, 1, 1), date(1997, 12, 31)))
    rec = Q.reconcile(series, in_window).first()
    assert rec["reconciled"], rec
    samples = [r["sample"] for r in audit.collect()]
    assert all(s is not None and 0 < len(s) <= 5 for s in samples)


def test_observed_stage_counts_single_job(spark):
    trips = T.trips_orders(spark, SF)
    lookup = T.zone_lookup_customers(spark, SF)
    series, _, obs = P.prepare(trips, lookup, TEST_SCOPE, regions=T.region_names(spark, SF),
                               stated_month=None, observe=True)
    series.write.format("noop").mode("overwrite").save()
    got = P.observed_counts(obs)
    assert got["raw"] == trips.count() and got["series"] == 365 * 5
    assert got["clean"] <= got["raw"] and got["counted"] <= 365 * 5
