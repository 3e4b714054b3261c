import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tripcast.params import TEST_SCOPE
from tripcast.sources import files as S
from tripcast.sources import results as R
from tripcast.sources import tables as T
from tripcast.plans.jobs import build_series
from tripcast.streaming import incremental as X

from conftest import SF


def _write_months(spark, base):
    """Orders split into monthly files named like the trip feed (1997-01..03)."""
    trips = T.trips_orders(spark, SF).drop("row_id")
    for m in (1, 2, 3):
        part = trips.where((F.year("pickup_datetime") == 1997) & (F.month("pickup_datetime") == m))
        # one stray row from another month in each file
        stray = trips.where((F.year("pickup_datetime") == 1996) & (F.month("pickup_datetime") == 12)).limit(1)
        part.unionByName(stray).coalesce(1).write.mode("overwrite").parquet(os.path.join(base, f"tmp_{m}"))
        src = [f for f in os.listdir(os.path.join(base, f"tmp_{m}")) if f.endswith(".parquet")][0]
        os.link(os.path.join(base, f"tmp_{m}", src), os.path.join(base, "feed", f"fhvhv_tripdata_1997-0{m}.parquet"))
    open(os.path.join(base, "feed", "README.txt"), "w").write("not data")


def test_read_month_files_and_build(spark, tmp_dir):
    os.makedirs(os.path.join(tmp_dir, "feed"))
    _write_months(spark, tmp_dir)
    df = S.read_month_files(spark, os.path.join(tmp_dir, "feed"))
    months = sorted(r[0] for r in df.select("stated_month").distinct().collect())
    assert months == [date(1997, 1, 1), date(1997, 2, 1), date(1997, 3, 1)]
    series = build_series(df, T.zone_lookup_customers(spark, SF), TEST_SCOPE, month_col="stated_month")
    total = series.agg(F.sum("demand")).first()[0]
    expected = df.where(F.trunc(F.col("pickup_datetime").cast("date"), "MM") == F.col("stated_month")).count()
    assert total == expected
    from tripcast.plans.jobs import build_report
    rep = {r["month"]: r for r in build_report(df, T.zone_lookup_customers(spark, SF)).collect()}
    assert set(rep) == set(months) and all(r["dropped"] == 1 for r in rep.values())
    assert sum(r["counted"] for r in rep.values()) == total
    latest = S.read_month_files(spark, os.path.join(tmp_dir, "feed"), latest_only=True)
    assert latest.select("stated_month").distinct().first()[0] == date(1997, 3, 1)
    with pytest.raises(FileNotFoundError):
        S.read_trips(spark, os.path.join(tmp_dir, "missing.parquet"))


def test_stated_month_from_name(spark):
    df = spark.createDataFrame([("fhvhv_tripdata_2026-04.parquet",), ("FHVHV_2025-05.parquet",), ("x.parquet",)],
                               "n string")
    got = [r[0] for r in df.select(S.stated_month_from_name("n")).collect()]
    assert got == [date(2026, 4, 1), date(2025, 5, 1), None]


def test_partials_resume_and_gate(spark, tmp_dir):
    part = spark.createDataFrame([(date(1997, 1, 1), datetime(1997, 1, 2), "A", 3)],
                                 "month date, period timestamp_ntz, region string, demand long")
    path = os.path.join(tmp_dir, "partials")
    S.write_partials(part, path)
    wanted = S.window_months_frame(spark, TEST_SCOPE)
    assert S.months_to_build(spark, wanted, path).count() == 11
    with pytest.raises(RuntimeError):
        S.assert_months_complete(spark.read.parquet(path), TEST_SCOPE)


def test_merge_forecasts(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "model string, yhat double")
    new = spark.createDataFrame([("b", 5.0)], "model string, yhat double")
    assert sorted(map(tuple, S.merge_forecasts(old, new).collect())) == [("a", 1.0), ("b", 5.0)]


def test_results_roundtrip(spark, tmp_dir):
    act = spark.createDataFrame([(datetime(2025, 5, 1), 10.0), (datetime(2025, 5, 2), 12.0)],
                                "period timestamp_ntz, actual double")
    ftot = spark.createDataFrame([("m", datetime(2025, 5, 1), 9.0), ("m", datetime(2025, 5, 2), 13.0)],
                                 "model string, period timestamp_ntz, yhat double")
    table = spark.createDataFrame([(0, "m", None), (1, "x", "failed")], "ordinal int, model_name string, excluded_reason string")
    cf = spark.createDataFrame([(1, "m")], "cf_rank int, model_name string")
    doc = R.results_document(act, ftot, table, cf)
    path = os.path.join(tmp_dir, "results")
    R.write_results(doc, path)
    a, f = R.read_results(spark, path)
    assert sorted((r.kind, r.ordinal, r.name, len(r.values), r.excluded_reason) for r in doc.collect()) == [
        ("actual", 0, "actual", 2, None), ("carry_forward", 1, "m", 0, None), ("model", 0, "m", 2, None),
        ("model", 1, "x", 0, "failed")]
    assert [r["actual"] for r in a.orderBy("pos").collect()] == [10.0, 12.0]
    assert [r["yhat"] for r in f.where("model = 'm'").orderBy("pos").collect()] == [9.0, 13.0]


def test_stream_counts_and_merge(spark, tmp_dir):
    feed = os.path.join(tmp_dir, "feed")
    os.makedirs(feed)
    _write_months(spark, tmp_dir)
    schema = spark.read.parquet(os.path.join(feed, "fhvhv_tripdata_1997-01.parquet")).schema
    lookup = T.zone_lookup_customers(spark, SF)
    s = X.in_stated_month(X.stream_trips(spark, feed, schema))
    s = s.join(lookup.select(F.col("LocationID").alias("PULocationID"), F.col("Borough").alias("region")),
               "PULocationID", "left")
    out = os.path.join(tmp_dir, "series")
    X.run_available(X.daily_counts(s), os.path.join(tmp_dir, "ck"), output_mode="update",
                    foreach_batch=X.merge_stream_batch(out))
    got = X.read_merged(spark, out).agg(F.sum("demand")).first()[0]
    batch = S.read_month_files(spark, feed)
    exp = batch.where(F.trunc(F.col("pickup_datetime").cast("date"), "MM") == F.col("stated_month")).count()
    assert got == exp


def test_csv_lookup_and_series_reads(spark, tmp_dir):
    lk = os.path.join(tmp_dir, "zones.csv")
    with open(lk, "w") as f:
        f.write("LocationID,Borough,service_zone\n1,Bronx,Boro\n2,Queens,Boro\nx,Bad,Boro\n")
    got = sorted((r[0], r[1]) for r in S.read_zone_lookup(spark, lk).collect() if r[0] is not None)
    assert got == [(1, "Bronx"), (2, "Queens")]
    csv = os.path.join(tmp_dir, "upload.csv")
    with open(csv, "w") as f:
        f.write("period,region,demand\n2025-05-01,A,3\nnot-a-date,B,4\n")
    s = S.read_series(spark, csv)
    assert [r["period"] for r in s.orderBy("demand").collect()][1] is None
    pq = os.path.join(tmp_dir, "series.parquet")
    S.write_series(s.where("period IS NOT NULL"), pq)
    assert S.read_series(spark, pq).count() == 1
    assert S.read_first_series(spark, [os.path.join(tmp_dir, "none"), lk, csv]).count() == 2
    with pytest.raises(FileNotFoundError, match="none"):
        S.read_first_series(spark, [os.path.join(tmp_dir, "none")])
    with pytest.raises(FileNotFoundError):
        S.read_zone_lookup(spark, os.path.join(tmp_dir, "none.csv"))
    with pytest.raises(ValueError):
        bad = os.path.join(tmp_dir, "bad.csv")
        open(bad, "w").write("a,b\n1,2\n")
        S.read_series(spark, bad)


def test_stream_watermark_update_mode(spark, tmp_dir):
    """X1 with a watermark (state bounded): update output still ends at the
    exact per-day counts; the NTZ stamps are cast for the watermark."""
    src = os.path.join(tmp_dir, "events")
    ev = T.table(spark, SF, "events").select("ts", "event_type")
    ev.coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    s = X.stream_trips(spark, src, schema, monthly_names=False)
    s = s.select(F.col("ts").alias("pickup_datetime"), F.col("event_type").alias("region"))
    X.run_available(X.daily_counts(s, watermark="2 days"), os.path.join(tmp_dir, "ck"),
                    name="wm_counts", output_mode="update")
    got = spark.table("wm_counts").groupBy("period", "region").agg(F.max("demand").alias("d"))
    exp = ev.groupBy(F.col("ts").cast("date").cast("timestamp_ntz").alias("period"),
                     F.col("event_type").alias("region")).count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))
