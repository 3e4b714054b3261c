import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from tripcast.operators import copies as C
from tripcast.operators import quality as Q
from tripcast.sources import files as S
from tripcast.sources import month_files as M
from tripcast.sources import tables as T
from tripcast.streaming import incremental as X

from conftest import SF

LOOKUP = [(1, "A"), (2, "B")]


def one_file(df, folder, name):
    """``df`` as a plain file ``name`` (no folder of its own)."""
    made = os.path.join(folder, f"made-{name}")
    df.coalesce(1).write.parquet(made)
    part = next(f for f in os.listdir(made) if f.endswith(".parquet"))
    os.makedirs(os.path.join(folder, "feed"), exist_ok=True)
    os.link(os.path.join(made, part), os.path.join(folder, "feed", name))


def trips(spark, rows):
    return spark.createDataFrame(rows, "pickup_datetime timestamp_ntz, PULocationID long")


@pytest.fixture()
def feed(spark, tmp_dir):
    old = spark.createDataFrame([(date(2020, 1, 5), 1), (date(2020, 1, 6), None), (date(2020, 2, 1), 2)],
                                "Pickup_DateTime date, PULocationID int")
    one_file(old, tmp_dir, "fhvhv_2020-01.parquet")
    one_file(trips(spark, [(datetime(2020, 2, 3, 7), 1), (datetime(2020, 2, 3, 9), 2)]).withColumn("tips", F.lit(-1.5)),
             tmp_dir, "FHVHV_tripdata_2020-02.parquet")
    path = os.path.join(tmp_dir, "feed")
    trips(spark, [(datetime(2020, 3, 9), 1)] * 3).repartition(2).write.parquet(f"{path}/fhvhv_tripdata_2020-03.parquet")
    one_file(trips(spark, [(datetime(2020, 3, 9), 1)]), tmp_dir, "fhvhv_tripdata_2020-13.parquet")
    one_file(trips(spark, [(datetime(2020, 3, 9), 1)]), tmp_dir, "yellow_2020-03.parquet")
    return path


def test_drifting_types_are_widened(spark, feed):
    listed = M.list_month_files(spark, feed)
    assert {r.file_name for r in listed.collect()} == {
        "fhvhv_2020-01.parquet", "FHVHV_tripdata_2020-02.parquet", "fhvhv_tripdata_2020-03.parquet"}
    scan = M.scan_month_files(spark, feed)
    assert scan.rows.dtypes[:3] == [("pickup_datetime", "timestamp_ntz"), ("PULocationID", "bigint"), ("tips", "double")]
    assert scan.rows.groupBy("stated_month").count().orderBy("stated_month").collect() == [
        (date(2020, 1, 1), 3), (date(2020, 2, 1), 2), (date(2020, 3, 1), 3)]
    own = {(r.file_name, r.column): r.dtype for r in scan.schemas.collect()}
    assert own[("fhvhv_2020-01.parquet", "Pickup_DateTime")] == "date" and len(own) == 7
    assert S.read_month_files(spark, feed, latest_only=True).count() == 3
    two = M.scan_month_files(spark, feed, ["PULocationID", "pickup_datetime"]).rows
    assert "tips" not in two.columns and two.count() == 8
    plan = two._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 3  # a scan a schema group
    with pytest.raises(KeyError):
        M.scan_month_files(spark, feed, ["nothing"])


def test_schema_groups_share_scans(spark, tmp_dir):
    for m in range(1, 7):
        kind = "int" if m < 3 else "long"
        one_file(spark.range(2).select(F.col("id").cast(kind).alias("PULocationID")), tmp_dir, f"fhvhv_2021-0{m}.parquet")
    listed = M.list_month_files(spark, os.path.join(tmp_dir, "feed")).select("file_name", "path").collect()
    groups = M.schema_groups(spark, [tuple(r) for r in listed])
    assert [len(g.files) for g in groups] == [2, 4]


def test_common_types():
    t = M.common_type
    assert t(Ty.IntegerType(), Ty.LongType()) == Ty.LongType()
    assert t(Ty.LongType(), Ty.FloatType()) == Ty.DoubleType()
    assert t(Ty.DateType(), Ty.TimestampType()) == Ty.TimestampNTZType()
    assert t(Ty.DecimalType(10, 2), Ty.IntegerType()) == Ty.DecimalType(12, 2)
    assert t(Ty.DecimalType(38, 2), Ty.DecimalType(30, 20)) == Ty.DoubleType()
    assert t(Ty.StringType(), Ty.LongType()) == Ty.StringType()


def test_unreadable_and_missing_files(spark, feed, tmp_dir):
    with open(f"{feed}/fhvhv_2020-04.parquet", "w") as f:
        f.write("junk")
    with pytest.raises(ValueError, match="fhvhv_2020-04.parquet"):
        M.scan_month_files(spark, feed)
    with pytest.raises(ValueError):
        S.read_trips(spark, f"{feed}/fhvhv_2020-04.parquet")
    with pytest.raises(FileNotFoundError):
        M.list_month_files(spark, os.path.join(tmp_dir, "nowhere")).count()
    empty = os.path.join(tmp_dir, "empty")
    os.makedirs(empty)
    with pytest.raises(ValueError, match="no monthly"):
        M.scan_month_files(spark, empty)


def test_report_by_file_has_everything(spark, feed):
    scan = M.scan_month_files(spark, feed)
    order = ["fhvhv_tripdata_2020-03.parquet", "fhvhv_2020-01.parquet", "FHVHV_tripdata_2020-02.parquet"]
    rows = Q.full_report_by_file(scan.rows.drop("stated_month"), "file_name", schemas=scan.schemas, files=order,
                                 stated_months={order[2]: (2020, 1)}).collect()
    got = {(r.file, r.section, r.key, r.metric): r for r in rows}
    assert {r.file: r.file_ordinal for r in rows} == {f: i for i, f in enumerate(order)}
    assert got[(order[0], "duplicates", "all_columns", "duplicate_count")].value == 2
    assert got[(order[1], "schema", "PULocationID", "dtype")].text == "int"
    assert got[(order[1], "nulls", "PULocationID", "null_count")].value == 1
    assert (order[1], "nulls", "tips", "null_count") not in got  # the file has no such column
    out = got[(order[1], "violations", Q.OUTSIDE_MONTH, "count")]
    assert out.value == 1 and '"2020-02-01' in out.text
    assert got[(order[2], "violations", Q.OUTSIDE_MONTH, "count")].value == 2
    assert got[(order[2], "violations", "negative_tips", "count")].value == 2
    assert '"tips":-1.5' in got[(order[2], "violations", "negative_tips", "count")].text
    assert got[(order[2], "date_range", "pickup_datetime", "max")].text == "2020-02-03 09:00:00"


def test_report_of_nothing_and_its_scans(spark):
    empty = trips(spark, []).withColumn("tips", F.lit(1.0))
    rows = {(r.section, r.key, r.metric): r for r in Q.validation_report(empty).collect()}
    assert rows[("schema", "tips", "dtype")].text == "double" and rows[("nulls", "tips", "null_pct")].value == 0
    assert rows[("date_range", "pickup_datetime", "min")].text is None and len(rows) == 3 + 6 + 2 + 1
    report = Q.validation_report(T.trips_orders(spark, SF), order_key="row_id")
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    # one scan for the examples, one for the rows that share a hash; counts and hashes have been gathered before
    assert sum("o_orderkey" in line and "Relation" in line for line in plan.splitlines()) <= 2


def test_resume_after_changes_and_a_crash(spark, feed, tmp_dir):
    lookup = spark.createDataFrame(LOOKUP, "LocationID long, Borough string")
    root = os.path.join(tmp_dir, "partials")
    read = lambda: sorted(map(tuple, M.read_partials(spark, feed, root).collect()))
    with pytest.raises(RuntimeError):
        read()
    first = {r.file_name: r for r in M.build_partials(spark, feed, root, lookup).collect()}
    assert len(first) == 3 and first["fhvhv_2020-01.parquet"].rows == 2 and first["fhvhv_2020-01.parquet"].counted == 1
    before = read()
    assert (date(2020, 2, 1), datetime(2020, 2, 3), "B", 1) in before and len(before) == 4
    assert M.build_partials(spark, feed, root, lookup).count() == 0 and read() == before

    # counts without a ledger row, as a lost driver leaves them
    orphan = spark.read.schema(M.PARTIAL_SCHEMA).parquet(f"{root}/counts").withColumn("build", F.lit("lost"))
    orphan.write.mode("append").partitionBy("build").parquet(f"{root}/counts")
    assert read() == before
    # one file changes, one comes, one goes
    trips(spark, [(datetime(2020, 3, 9), 2)]).write.mode("overwrite").parquet(f"{feed}/fhvhv_tripdata_2020-03.parquet")
    one_file(trips(spark, [(datetime(2020, 5, 1), 1)]), tmp_dir, "fhvhv_2020-05.parquet")
    os.unlink(f"{feed}/FHVHV_tripdata_2020-02.parquet")
    with pytest.raises(RuntimeError, match="2020-05"):
        read()
    second = M.build_partials(spark, feed, root, lookup)
    assert {r.file_name for r in second.collect()} == {"fhvhv_tripdata_2020-03.parquet", "fhvhv_2020-05.parquet"}
    assert read() == [(date(2020, 1, 1), datetime(2020, 1, 5), "A", 1), (date(2020, 3, 1), datetime(2020, 3, 9), "B", 1),
                      (date(2020, 5, 1), datetime(2020, 5, 1), "A", 1)]


# ------------------------------------------------------------------ copies by hash
def test_copies_are_exact(spark):
    rows = [(1, None, 0.0), (1, None, -0.0), (None, 1, 0.0), (2, 2, float("nan")), (2, 2, float("nan")), (3, 3, None),
            (3, 3, None), (3, 3, None), (4, 4, 1.0)]
    df = spark.createDataFrame(rows, "a int, b int, c double")
    assert Q.count_duplicates(df).first()[0] == 4
    assert sorted(r.copies for r in C.copy_groups(df).collect()) == [2, 2, 3]
    assert C.distinct_rows(df).count() == 5
    assert Q.count_duplicates(df.limit(0)).first()[0] == 0
    maybe, single = C.parted(df)
    assert maybe.count() == 7 and single.count() == 2


def test_rows_that_share_a_hash_but_differ_stay(spark, monkeypatch):
    monkeypatch.setattr(C, "_hashed", lambda df, names: df.withColumns({h: F.lit(1).cast("long") for h in C.HASHES}))
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (None, None)], "a int, b string")
    assert Q.count_duplicates(df).first()[0] == 1 and C.distinct_rows(df).count() == 3


def test_clean_rows_and_log_agree(spark):
    jan, feb = date(2020, 1, 1), date(2020, 2, 1)
    row = (datetime(2020, 1, 5), 1.0)
    rows = [(*row, jan), (*row, jan), (*row, feb), (datetime(2020, 1, 6), -1.0, jan), (datetime(2020, 1, 6), -1.0, jan),
            (datetime(2020, 1, 7), None, jan)]
    df = spark.createDataFrame(rows, "pickup_datetime timestamp_ntz, tips double, stated_month date")
    clean, log = Q.apply_validity_rules(df, stated_month=None, month_col="stated_month", check_duplicates=True,
                                        null_columns=["tips"])
    assert clean.collect() == [(*row, jan)]
    r = log.first()
    assert r.counts_by_type == {Q.OUTSIDE_MONTH: 1, "negative_tips": 2, "null_tips": 1, "duplicate": 2}
    assert (r.input_row_count, r.output_row_count, r.total_invalid_handled) == (6, 1, 5)


# ------------------------------------------------------------------ streams
def test_merge_is_idempotent(spark, tmp_dir):
    out = os.path.join(tmp_dir, "series")
    batch = lambda *rows: spark.createDataFrame(
        [(datetime(2020, 1, d), r, n) for d, r, n in rows], "period timestamp_ntz, region string, demand long")
    read = lambda: {(r.period.day, r.region): r.demand for r in X.read_merged(spark, out).collect()}
    merge = X.merge_stream_batch(out)
    assert read() == {}
    X.stage_batch(batch((1, "A", 99), (9, "Z", 1)), 0, out)     # an attempt that crashed before its commit
    assert read() == {}
    merge(batch((1, "A", 5), (2, "A", 1)), 0)
    merge(batch((1, "A", 77)), 0)                               # replayed after its commit
    assert read() == {(1, "A"): 5, (2, "A"): 1}
    merge(batch((2, "A", 4), (2, "B", 1)), 1)
    X.stage_batch(batch((2, "A", 50)), 2, out)
    X.compact(spark, out)
    assert read() == {(1, "A"): 5, (2, "A"): 4, (2, "B"): 1}
    merge(batch((2, "A", 6)), 2)
    assert read() == {(1, "A"): 5, (2, "A"): 6, (2, "B"): 1}


def test_append_stream_resumes_and_is_whole(spark, feed, tmp_dir):
    out, ck = os.path.join(tmp_dir, "days"), os.path.join(tmp_dir, "ck")
    schema = "pickup_datetime timestamp_ntz, PULocationID long"

    def run():
        s = X.in_stated_month(X.stream_trips(spark, feed, schema)).withColumn("region", F.col("PULocationID").cast("string"))
        X.append_daily_counts(X.daily_counts(s, watermark="2 days"), out, ck)
        closed, opened = X.closed_days(spark, out), X.open_days(spark, ck)
        return sorted(map(tuple, closed.collect())), sorted(map(tuple, opened.collect()))
    closed, opened = run()
    assert opened == [(datetime(2020, 3, 9), "1", 3)]
    assert closed == [(datetime(2020, 1, 5), "1", 1), (datetime(2020, 2, 3), "1", 1), (datetime(2020, 2, 3), "2", 1)]
    one_file(trips(spark, [(datetime(2020, 6, 1), 2)]), tmp_dir, "fhvhv_2020-06.parquet")
    again, opened = run()
    assert opened == [(datetime(2020, 6, 1), "2", 1)] and len(again) == 4 and set(closed) < set(again)


def test_labels_of_paths(spark):
    """The last two parts of a path say which month file it is, as the whole path does."""
    from tripcast.sources.files import MONTH_LABEL_PATTERN, month_label, stated_month_from_name
    n = "fhvhv_tripdata_1997-05.parquet"
    paths = [n, f"/{n}", f"s3://a/b/{n}", f"file:/a/file={n}/part-0.snappy.parquet", f"/a/{n}/x/y.parquet", f"/a/{n}/", "/a/x.parquet",
             "/A/FHVHV_1997-05.PARQUET", f"/a/x{n}", f"/a={n}", f"{n}/p.parquet", "", None, "/fhvhv_1997-13.parquet", "/fhvhv_0000-01.parquet"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select(
        month_label(F.col("path")).alias("label"), F.regexp_extract("path", MONTH_LABEL_PATTERN, 1).alias("whole"))
    got = rows.withColumn("month", stated_month_from_name("label").cast("string")).collect()
    assert [r.label for r in got] == [r.whole for r in got] and sum(bool(r.label) for r in got) == 9
    assert [str(r.month) for r in got if r.label] == ["1997-05-01"] * 7 + ["None", "0000-01-01"]


def test_replayed_merge_reads_its_files_once(spark, monkeypatch):
    """One feed, and one reading of a micro-batch's files for all its attempts."""
    from tripcast.plans import catalog_files as C
    feeds, seen = [], spark.sparkContext.accumulator(0)
    month_feed, in_month = C.month_feed, X.in_stated_month

    def counted(day):
        seen.add(1)
        return day
    monkeypatch.setattr(C, "month_feed", lambda *a: feeds.append(month_feed(*a)) or feeds[-1])
    monkeypatch.setattr(X, "in_stated_month", lambda df: in_month(df).withColumn(
        "pickup_datetime", F.udf(counted, "timestamp_ntz").asNondeterministic()("pickup_datetime")))
    total = C.merge_stream_replayed_q(spark, SF).agg(F.sum("demand")).first()[0]
    assert len(feeds) == 1 and 0 < total <= seen.value < 2 * total
