from pyspark.sql import functions as F

from tripcast.params import TEST_SCOPE
from tripcast.plans import jobs as J
from tripcast.sources import tables as T

from conftest import SF


def test_adaptive_sizes():
    assert J.adaptive_sizes(3) is None
    assert J.adaptive_sizes(100) == (25, 14)
    assert J.adaptive_sizes(20) == (5, 7)
    assert J.adaptive_sizes(400) == (30, 14)


def test_refresh_job_ok_and_failed(spark):
    trips = T.trips_orders(spark, SF)
    ok = J.refresh_job(trips, T.zone_lookup_customers(spark, SF), TEST_SCOPE,
                       regions=T.region_names(spark, SF)).first()
    assert ok["status"] == "ok" and ok["rows"] == 365 * 5 and ok["trained"] == 5
    empty_lookup = T.zone_lookup_customers(spark, SF).where("false")
    bad = J.refresh_job(trips, empty_lookup, TEST_SCOPE).first()
    assert bad["status"] == "failed" and bad["trained"] == 0 and bad["rows"] == 0


def test_user_series_forecast(spark):
    from tripcast.operators import prepare as P
    s, _, _ = P.prepare(trips=T.trips_orders(spark, SF), lookup=T.zone_lookup_customers(spark, SF),
                        scope=TEST_SCOPE, regions=T.region_names(spark, SF), stated_month=None)
    out = J.forecast_user_series(s.select("period", "region", "demand"), TEST_SCOPE)
    assert out["wide"].count() == 14 and out["wide"].columns[:2] == ["period", "TOTAL"]
    assert out["metrics"].where("mae IS NOT NULL").count() == 1


def test_models_read_the_series_once(spark):
    """However many candidates there are, what is under the series is worked out once."""
    from tripcast.operators.forecast.naive import seasonal_naive
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x
    demand = F.udf(counted, "long").asNondeterministic()
    series = spark.range(120).select(F.expr("timestamp_ntz'1997-01-01 00:00:00' + make_dt_interval(int(id / 2))").alias("period"),
                                     F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("region"), demand("id").alias("demand"))
    cands = {f"m{k}": lambda t, h: seasonal_naive(t, h, 7) for k in range(3)}
    out = J.train_and_evaluate(series, TEST_SCOPE, candidates=cands)
    assert out["comparison"].count() == 3 and out["actual"].count() == TEST_SCOPE.holdout_periods
    assert seen.value == 120
