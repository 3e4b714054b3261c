from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tripcast.operators import quality as Q
from tripcast.params import Scope

ROWS = "row_id long, pickup_datetime timestamp_ntz, base_passenger_fare double, driver_pay double, trip_miles double"


def test_scope_window_bounds():
    Scope(window_start=date(2025, 5, 1), window_end=date(2026, 4, 30))
    Scope(window_start=date(2024, 5, 1), window_end=date(2026, 4, 30))
    with pytest.raises(ValueError):
        Scope(window_start=date(2025, 6, 1), window_end=date(2026, 4, 30))
    with pytest.raises(ValueError):
        Scope(window_start=date(2023, 1, 1), window_end=date(2026, 4, 30))
    with pytest.raises(ValueError):
        Scope(time_grain="hourly")


def test_profile_nulls_counts_nan_and_empty(spark):
    df = spark.createDataFrame([(1, float("nan"), None), (2, 1.0, "a"), (None, None, "b")],
                               "a long, b double, c string")
    got = {r["column"]: (r["null_count"], r["null_pct"]) for r in Q.profile_nulls(df).collect()}
    assert got["a"][0] == 1 and got["b"][0] == 2 and got["c"][0] == 1
    assert abs(got["b"][1] - 200 / 3) < 1e-9
    empty = spark.createDataFrame([], "a long")
    assert Q.profile_nulls(empty).first()["null_pct"] == 0.0


def test_schema_profile(spark):
    df = spark.createDataFrame([(1, "x")], "a long, b string")
    rows = Q.profile_schema(df).orderBy("ordinal").collect()
    assert [(r["column"], r["dtype"], r["row_count"]) for r in rows] == [("a", "bigint", 1), ("b", "string", 1)]


def test_duplicates_treat_nulls_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "x")], "a long, b string")
    assert Q.count_duplicates(df).first()[0] == 2


def test_resolve_timestamp_variants(spark):
    df = spark.createDataFrame([(datetime(2026, 4, 1),)], "tpep_pickup_datetime timestamp_ntz")
    assert Q.resolve_timestamp_column(df) == "tpep_pickup_datetime"
    df2 = spark.createDataFrame([(datetime(2026, 4, 1),)], "PICKUP_DATETIME timestamp_ntz")
    assert Q.resolve_timestamp_column(df2) == "PICKUP_DATETIME"
    assert Q.resolve_timestamp_column(spark.createDataFrame([(1,)], "x long")) is None


def _violating_frame(spark):
    rows = [(1, datetime(2026, 4, 3), 10.0, 5.0, 1.0),
            (2, datetime(2026, 4, 4), -5.0, 5.0, 1.0),      # negative fare
            (3, datetime(2026, 3, 30), 10.0, 5.0, 1.0),     # outside month
            (4, datetime(2026, 3, 31), -1.0, -2.0, 1.0),    # three violations
            (5, None, 10.0, 5.0, None),                     # null stamp is no violation
            (6, datetime(2026, 4, 5), 10.0, 5.0, float("nan"))]
    return spark.createDataFrame(rows, ROWS)


def test_flag_domain_violations_counts_and_examples(spark):
    v = Q.flag_domain_violations(_violating_frame(spark), stated_month=(2026, 4), order_key="row_id")
    got = {r["violation_type"]: (r["count"], r["example_key"]) for r in v.collect()}
    assert got == {"pickup_outside_stated_month": (2, "3"), "negative_base_passenger_fare": (2, "2"),
                   "negative_driver_pay": (1, "4")}


def test_infer_stated_month_lowest_on_tie(spark):
    df = spark.createDataFrame([(datetime(2026, 5, 1),), (datetime(2026, 4, 2),)], "pickup_datetime timestamp_ntz")
    assert Q.infer_stated_month(df) == date(2026, 4, 1)


def test_apply_validity_rules_drop_and_log(spark):
    df = _violating_frame(spark)
    clean, log = Q.apply_validity_rules(df, stated_month=(2026, 4))
    assert sorted(r["row_id"] for r in clean.collect()) == [1, 5, 6]
    lg = log.first()
    assert lg["total_invalid_handled"] == 3 and lg["input_row_count"] == 6 and lg["output_row_count"] == 3
    assert lg["counts_by_type"] == {"pickup_outside_stated_month": 2, "negative_base_passenger_fare": 2,
                                    "negative_driver_pay": 1}
    with pytest.raises(ValueError):
        Q.apply_validity_rules(df, rule="impute")


def test_apply_validity_rules_duplicates_and_nulls(spark):
    rows = [(datetime(2026, 4, 1), 1.0), (datetime(2026, 4, 1), 1.0), (datetime(2026, 4, 1), 1.0),
            (datetime(2026, 4, 2), -1.0), (datetime(2026, 4, 2), -1.0), (datetime(2026, 4, 3), None)]
    df = spark.createDataFrame(rows, "pickup_datetime timestamp_ntz, tips double")
    clean, log = Q.apply_validity_rules(df, stated_month=None, check_duplicates=True, null_columns=["tips"])
    assert clean.count() == 1
    lg = log.first()
    assert lg["counts_by_type"] == {"negative_tips": 2, "duplicate": 3, "null_tips": 1}
    assert lg["total_invalid_handled"] == 5 and lg["output_row_count"] == 1


@pytest.mark.parametrize("drop,corrupt,expect", [
    ("region", None, "region"), (None, ("period", "not-a-date"), "period"),
    (None, ("demand", "many"), "demand"), (None, ("demand", "3.5"), "demand"), (None, ("demand", "-1"), "demand"),
    (None, None, None)])
def test_check_contract_names_offender(spark, drop, corrupt, expect):
    rows = [("2025-05-01", "A", "3"), ("2025-05-02", "B", "4")]
    if corrupt:
        col = {"period": 0, "region": 1, "demand": 2}[corrupt[0]]
        r = list(rows[1])
        r[col] = corrupt[1]
        rows[1] = tuple(r)
    df = spark.createDataFrame(rows, "period string, region string, demand string")
    if drop:
        df = df.drop(drop)
    got = Q.check_contract(df).first()
    assert got["offending_column"] == expect and got["ok"] == (expect is None)
    if expect:
        assert expect in got["error"]


def test_contract_numeric_region_fails(spark):
    df = spark.createDataFrame([(datetime(2025, 5, 1), 3, 4)], "period timestamp_ntz, region long, demand long")
    assert Q.check_contract(df).first()["offending_column"] == "region"


def test_empty_contract_passes(spark):
    df = spark.createDataFrame([], "period string, region string, demand string")
    assert Q.check_contract(df).first()["ok"]


def test_report_by_file_uses_each_files_modal_month(spark):
    rows = [("f1", datetime(2026, 4, 1), 1.0), ("f1", datetime(2026, 4, 2), 1.0), ("f1", datetime(2026, 3, 30), 1.0),
            ("f2", datetime(2026, 5, 3), -2.0), ("f2", datetime(2026, 5, 4), 1.0)]
    df = spark.createDataFrame(rows, "file string, pickup_datetime timestamp_ntz, base_passenger_fare double")
    got = {(r["file"], r["metric"]): r["value"] for r in Q.validation_report_by_file(df, "file").collect()}
    assert got[("f1", "rows")] == 3 and got[("f1", "pickup_outside_stated_month")] == 1
    assert ("f2", "pickup_outside_stated_month") not in got
    assert got[("f2", "negative_base_passenger_fare")] == 1


def test_report_lines_percentages(spark):
    df = _violating_frame(spark)
    lines = Q.report_lines(Q.validation_report(df, stated_month=(2026, 4), order_key="row_id")).collect()
    viol = [r for r in lines if r["section"] == "violations"]
    assert viol and all(abs(r["pct_of_rows"] - 100.0 * int(r["line"].split(": ")[1].split(" ")[0]) / 6) < 1e-9
                        for r in viol)


def test_alignment_and_reconcile_partials(spark):
    hp = spark.createDataFrame([(datetime(2025, 5, 1),), (datetime(2025, 5, 2),)], "period timestamp_ntz")
    fc = spark.createDataFrame([("a", datetime(2025, 5, 1)), ("a", datetime(2025, 5, 2)), ("b", datetime(2025, 5, 1))],
                               "model string, period timestamp_ntz")
    got = {r["model"]: r["aligned"] for r in Q.check_alignment(fc, hp).collect()}
    assert got == {"a": True, "b": False}
    s = spark.createDataFrame([(1,), (2,)], "demand long")
    r = Q.reconcile_partials(s, spark.createDataFrame([(3,)], "demand long")).first()
    assert r["reconciled"] and r["difference"] == 0
