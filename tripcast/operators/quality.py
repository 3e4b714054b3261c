"""Profiling, data-quality checks and the drop-rule cleaner (Q1-Q22).

Design notes for scale:

* a report is **one hash aggregate** over the input, grouped by file and pickup
  month with numbers alone in its buffers, and one filtered scan for the example
  rows it names; duplicates are counted by hash (:mod:`.copies`);
* "first offending row" is made deterministic with an explicit order key
  (``min_by(.., key)``), since a distributed table has no row order;
* small parameters (a stated month) are computed once and used as literals.
"""

from __future__ import annotations

from datetime import date
from functools import reduce
from typing import Iterable, Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, TimestampNTZType, TimestampType, DateType

from tripcast.functions.columns import as_double, epoch_seconds, is_float_type, month_start, to_ts
from tripcast.operators.copies import copy_groups, distinct_rows
from tripcast.params import DEMAND, PERIOD, PICKUP, REGION
from tripcast.session import written

# Fixed values that must equal the reference's behaviour.
PICKUP_COLUMN_VARIANTS = (
    "pickup_datetime",
    "Pickup_datetime",
    "Pickup_DateTime",
    "pickup_date_time",
    "tpep_pickup_datetime",
    "lpep_pickup_datetime",
    "request_datetime",
)
DEFAULT_NON_NEGATIVE_COLUMNS = (
    "trip_miles", "trip_time", "base_passenger_fare", "tolls", "bcf",
    "sales_tax", "congestion_surcharge", "airport_fee", "tips", "driver_pay",
    "demand", "trip_count",
)
OUTSIDE_MONTH = "pickup_outside_stated_month"
HANDLING_RULE_DROP = "drop"
# Fixed values that must equal the reference's behaviour: the input-contract
# messages (callers match on them), in rule order.
CONTRACT_MISSING = "is required but missing from the uploaded data. Expected long-format columns {cols}."
CONTRACT_BAD_PERIOD = "must contain datetime values but has entries that cannot be parsed as dates."
CONTRACT_BAD_REGION = "must contain text (borough) values but has non-text entries."
CONTRACT_NON_NUMERIC = "must contain integer trip counts but has non-numeric entries."
CONTRACT_FRACTIONAL = "must contain whole-number trip counts but has fractional values."
CONTRACT_NEGATIVE = "must be non-negative (>= 0) but has negative values."

DROP_RULE_DESCRIPTION = (
    "drop: a row is removed when its pickup falls outside the stated month or a "
    "measure that cannot be negative is negative (plus, when enabled, later copies "
    "of a row and NULLs in required columns); the log reports every removal by type."
)
CONTRACT_COLUMNS = (PERIOD, REGION, DEMAND)


def _spark(df: DataFrame) -> SparkSession:
    return df.sparkSession


def require_columns(df: DataFrame, cols: Iterable[str], what: str = "input") -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"{what} is missing required column(s) {missing}; "
                       f"available: {df.columns}")


def _null_pred(df: DataFrame, c: str):
    col = F.col(f"`{c}`")
    dt = df.schema[c].dataType
    return (col.isNull() | F.isnan(col)) if is_float_type(dt) else col.isNull()


# --------------------------------------------------------------------------- Q1
def profile_schema(df: DataFrame) -> DataFrame:
    """Rows ``(ordinal, column, dtype, row_count)`` in column order."""
    fields = [F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("column"),
                       F.lit(t).alias("dtype"))
              for i, (n, t) in enumerate(df.dtypes)]
    counted = df.agg(F.count(F.lit(1)).alias("row_count"))
    if not fields:
        return counted.select(F.lit(None).cast("int").alias("ordinal"),
                              F.lit(None).cast("string").alias("column"),
                              F.lit(None).cast("string").alias("dtype"),
                              "row_count").where("false")
    return counted.select(F.inline(F.array(*fields)), "row_count")


# --------------------------------------------------------------------------- Q2
def profile_nulls(df: DataFrame) -> DataFrame:
    """Rows ``(ordinal, column, null_count, null_pct)``; pct 0.0 when empty.

    NaN counts as missing in float columns.  One aggregate pass.
    """
    aggs = [F.count(F.lit(1)).alias("__n")] + [
        F.count_if(_null_pred(df, c)).alias(f"__c{i}") for i, c in enumerate(df.columns)]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"),
                              F.col(f"__c{i}").alias("null_count"))
                     for i, c in enumerate(df.columns)])
    return wide.select("__n", F.inline(rows)).select(
        "ordinal", "column", F.col("null_count").cast("long").alias("null_count"),
        F.coalesce(F.try_divide(F.col("null_count") * 100.0, F.col("__n")),
                   F.lit(0.0)).alias("null_pct"))


# --------------------------------------------------------------------------- Q3
def resolve_timestamp_column(df: DataFrame, ts_col: str = PICKUP) -> Optional[str]:
    """Exact name, then case-insensitive, then the known variants, else None."""
    return resolve_timestamp_name(df.columns, ts_col)


def resolve_timestamp_name(cols: list[str], ts_col: str = PICKUP) -> Optional[str]:
    if ts_col in cols:
        return ts_col
    lower = {c.lower(): c for c in reversed(cols)}
    if ts_col.lower() in lower:
        return lower[ts_col.lower()]
    for v in PICKUP_COLUMN_VARIANTS:
        if v in cols:
            return v
        if v.lower() in lower:
            return lower[v.lower()]
    return None


def with_pickup(df: DataFrame, ts_col: str = PICKUP) -> DataFrame:
    """Expose the resolved timestamp column as ``pickup_datetime``."""
    name = resolve_timestamp_column(df, ts_col)
    if name is None:
        raise KeyError(f"no pickup timestamp column {ts_col!r} (also tried the "
                       f"variants {list(PICKUP_COLUMN_VARIANTS)}); columns: {df.columns}")
    if name == PICKUP:
        return df
    return df.withColumnRenamed(name, PICKUP)


# --------------------------------------------------------------------------- Q4
def date_range(df: DataFrame, ts_col: str = PICKUP) -> DataFrame:
    """One row ``(min_pickup, max_pickup, span_days)`` over usable stamps."""
    name = resolve_timestamp_column(df, ts_col)
    if name is None:
        raise KeyError(f"no pickup timestamp column {ts_col!r}")
    ts = to_ts(F.col(f"`{name}`"))
    return df.agg(F.min(ts).alias("min_pickup"), F.max(ts).alias("max_pickup")) \
             .withColumn("span_days", F.datediff(F.col("max_pickup").cast("date"),
                                                 F.col("min_pickup").cast("date")))


def date_range_values(df: DataFrame, ts_col: str = PICKUP):
    """Driver-side (min, max); ValueError when no usable timestamp exists."""
    r = date_range(df, ts_col).first()
    if r is None or r["min_pickup"] is None:
        raise ValueError(f"column {ts_col!r} has no usable timestamps")
    return r["min_pickup"], r["max_pickup"]


# --------------------------------------------------------------------------- Q5
def count_duplicates(df: DataFrame) -> DataFrame:
    """One row ``(duplicate_count)``: copies after the first, NULLs compare equal."""
    return copy_groups(df).agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("long").alias("duplicate_count"))


# --------------------------------------------------------------------------- Q6
def modal_month(df: DataFrame, ts_col: str = PICKUP) -> DataFrame:
    """One row ``(stated_month DATE, n)``: most common month, earliest on a tie."""
    m = month_start(F.col(f"`{ts_col}`"))
    return (df.select(m.alias("stated_month")).where("stated_month IS NOT NULL")
              .groupBy("stated_month").agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.desc("n"), "stated_month").limit(1))


def infer_stated_month(df: DataFrame, ts_col: str = PICKUP) -> Optional[date]:
    r = modal_month(df, ts_col).first()
    return None if r is None else r["stated_month"]


def _resolve_month(df, ts_col, stated_month):
    """stated_month: date / (year, month) / 'infer' / None (= skip)."""
    if stated_month is None:
        return None
    if isinstance(stated_month, str):
        if stated_month != "infer":
            raise ValueError(f"stated_month must be a date, (y, m), 'infer' or None")
        return infer_stated_month(df, ts_col)
    if isinstance(stated_month, tuple):
        return date(stated_month[0], stated_month[1], 1)
    return date(stated_month.year, stated_month.month, 1)


# ------------------------------------------------------------------ Q7, Q8, Q16, Q17
def violation_masks(df: DataFrame, *, ts_col: str = PICKUP, stated_month="infer",
                    non_negative_columns: Optional[Iterable[str]] = None,
                    null_columns: Optional[Iterable[str]] = None,
                    month_col: Optional[str] = None):
    """Ordered list of ``(violation_type, boolean Column)``.

    ``month_col`` names a DATE column holding a per-row stated month (the
    month of the row's source file); it overrides ``stated_month``.
    """
    masks = []
    if ts_col in df.columns:
        month = None if month_col else _resolve_month(df, ts_col, stated_month)
        rec = month_start(F.col(f"`{ts_col}`"))
        if month_col:
            masks.append((OUTSIDE_MONTH, F.coalesce(
                rec.isNotNull() & F.col(month_col).isNotNull() & (rec != F.col(month_col)),
                F.lit(False))))
        elif month is not None:
            masks.append((OUTSIDE_MONTH,
                          F.coalesce(rec.isNotNull() & (rec != F.lit(month)), F.lit(False))))
    cols = DEFAULT_NON_NEGATIVE_COLUMNS if non_negative_columns is None else non_negative_columns
    for c in [c for c in cols if c in df.columns]:
        masks.append((f"negative_{c}",
                      F.coalesce(as_double(F.col(f"`{c}`")) < 0, F.lit(False))))
    for c in [c for c in (null_columns or []) if c in df.columns]:
        masks.append((f"null_{c}", _null_pred(df, c)))
    return masks


def flag_domain_violations(df: DataFrame, *, ts_col: str = PICKUP, stated_month="infer",
                           non_negative_columns=None, order_key: Optional[str] = None,
                           month_col: Optional[str] = None) -> DataFrame:
    """Rows ``(ordinal, violation_type, count, example_key, example)`` for each
    violation that occurs.  ``example`` is the JSON of the first offending row
    by ``order_key`` (or the smallest JSON text when no key is given)."""
    masks = violation_masks(df, ts_col=ts_col, stated_month=stated_month,
                            non_negative_columns=non_negative_columns, month_col=month_col)
    payload = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != month_col]))
    key = F.col(order_key) if order_key else payload
    aggs, rows = [], []
    for i, (name, m) in enumerate(masks):
        aggs += [F.count_if(m).alias(f"n{i}"),
                 F.min_by(F.when(m, F.struct(key.alias("k"), payload.alias("j"))),
                          F.when(m, key)).alias(f"e{i}")]
        rows.append(F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("violation_type"),
                             F.col(f"n{i}").cast("long").alias("count"),
                             F.col(f"e{i}.k").cast("string").alias("example_key"),
                             F.col(f"e{i}.j").alias("example")))
    if not masks:
        return _spark(df).createDataFrame(
            [], "ordinal int, violation_type string, count long, example_key string, example string")
    return df.agg(*aggs).select(F.inline(F.array(*rows))).where("count >= 1")


# ---------------------------------------------------------------------- Q10, Q11
REPORT_COLUMNS = ("file_ordinal", "file", "section", "ordinal", "key", "metric", "value", "text")


def _domain_masks(df: DataFrame, non_negative_columns) -> list:
    return violation_masks(df, stated_month=None, ts_col="", non_negative_columns=non_negative_columns)


def _given_month(file, given) -> "F.Column":
    """The month stated for a file in ``given`` (file -> date or (year, month))."""
    months = {k: v if isinstance(v, date) else date(v[0], v[1], 1) for k, v in (given or {}).items()}
    if not months:
        return F.lit(None).cast("date")
    pairs = [x for k, v in months.items() for x in (F.lit(k), F.lit(v.replace(day=1)))]
    return F.try_element_at(F.create_map(*pairs), file)


def file_statistics(df: DataFrame, file_col: str, *, ts_col: str = PICKUP, stated_months=None,
                    month_col: Optional[str] = None, infer: bool = True, non_negative_columns=None,
                    order_key: Optional[str] = None) -> DataFrame:
    """One row per file: rows, null counts (c0..), first and last pickup, the
    stated month, and per violation its count (v0..) and the least order key
    among its rows (k0..; v0 is the month rule).

    One aggregate by (file, pickup month); its few rows then give each file's
    month: the one given, else the one in ``month_col``, else (``infer``) the
    commonest, the earliest on a tie.
    """
    names = [c for c in df.columns if c not in (file_col, month_col)]
    masks = _domain_masks(df, non_negative_columns)
    ts = to_ts(F.col(f"`{ts_col}`")) if ts_col in df.columns else F.lit(None).cast("timestamp_ntz")
    key = F.col(f"`{order_key}`") if order_key else F.xxhash64(*[F.col(f"`{c}`") for c in names])
    stated = F.col(f"`{month_col}`").cast("date") if month_col else F.lit(None).cast("date")
    aggs = [F.count(F.lit(1)).alias("n"), F.min(ts).alias("lo"), F.max(ts).alias("hi"), F.min(key).alias("k")]
    aggs += [F.count_if(_null_pred(df, c)).alias(f"c{i}") for i, c in enumerate(names)]
    aggs += [x for i, (_, m) in enumerate(masks, 1)
             for x in (F.count_if(m).alias(f"v{i}"), F.min(F.when(m, key)).alias(f"k{i}"))]
    by_month = written(df.groupBy(F.col(f"`{file_col}`").alias("file"), F.trunc(ts.cast("date"), "MM").alias("month"),
                                  stated.alias("named")).agg(*aggs), "report-months")

    seen = F.col("month").isNotNull()
    modal = F.min_by(F.when(seen, F.col("month")), F.when(seen, F.struct(-F.col("n"), F.col("month"))))
    months = by_month.groupBy(F.col("file").alias("__f")).agg(modal.alias("modal"), F.max("named").alias("named_"))
    chosen = [_given_month(F.col("__f"), stated_months), F.col("named_")] + ([F.col("modal")] if infer else [])
    months = months.select("__f", F.coalesce(*chosen).alias("stated"))
    both = by_month.join(months, F.col("file").eqNullSafe(F.col("__f")))
    outside = F.coalesce(seen & (F.col("month") != F.col("stated")), F.lit(False))
    folds = [F.sum("n").alias("rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("stated").alias("stated")]
    folds += [F.sum(f"c{i}").alias(f"c{i}") for i in range(len(names))]
    folds += [F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0)).alias("v0"),
              F.min(F.when(outside, F.col("k"))).alias("k0")]
    folds += [x for i in range(1, len(masks) + 1) for x in (F.sum(f"v{i}").alias(f"v{i}"), F.min(f"k{i}").alias(f"k{i}"))]
    return written(both.groupBy("file").agg(*folds), "report-files")


def _examples(df: DataFrame, stats: DataFrame, file_col: str, names: list, masks: list, month_col,
              ts_col: str, order_key: Optional[str]) -> DataFrame:
    """(file, ordinal, example): the JSON of the rows that the statistics name
    (of rows that share a key, the smallest text). One scan, joined to few keys."""
    key = F.col(f"`{order_key}`") if order_key else F.xxhash64(*[F.col(f"`{c}`") for c in names])
    wanted = stats.select(F.col("file").alias("__f"), F.col("stated").alias("__stated"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.col(f"k{i}").alias("k")) for i in range(len(masks) + 1)])).alias("w"))
    wanted = wanted.where("w.k is not null").select("__f", "__stated", F.col("w.ordinal").alias("__o"), F.col("w.k").alias("__k"))
    rows = df.withColumn("__key", key).join(
        wanted, F.col(f"`{file_col}`").eqNullSafe(F.col("__f")) & (F.col("__key") == F.col("__k")))
    rec = month_start(F.col(f"`{ts_col}`")) if ts_col in df.columns else F.lit(None).cast("date")
    holds = F.when(F.col("__o") == 0, F.coalesce(rec != F.col("__stated"), F.lit(False)))
    for i, (_, m) in enumerate(masks, 1):
        holds = holds.when(F.col("__o") == i, m)
    payload = F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]))
    return rows.where(holds).groupBy(F.col("__f").alias("file"), F.col("__o").alias("ordinal")).agg(
        F.min(payload).alias("example"))


def full_report_by_file(df: DataFrame, file_col: str, *, ts_col: str = PICKUP, stated_months=None,
                        month_col: Optional[str] = None, infer: bool = True, non_negative_columns=None,
                        order_key: Optional[str] = None, schemas: Optional[DataFrame] = None,
                        files: Optional[list] = None, stats: Optional[DataFrame] = None) -> DataFrame:
    """Q11: the whole report of every file (Q1, Q2, Q4, Q5, Q7-Q9) as rows
    ``REPORT_COLUMNS``; sections schema, nulls, date_range, duplicates, violations.

    ``stated_months`` maps files to months (others: the file's month column or
    its commonest month); ``schemas`` gives each file's own (file_name, ordinal,
    column, dtype), else all have the frame's; ``files`` is the order of the
    input (else by name). Files without rows are not in the frame, hence not in
    the report. Duplicates are counted within a file. ``stats`` may be passed
    where :func:`file_statistics` has been run already.
    """
    names = [c for c in df.columns if c not in (file_col, month_col)]
    masks = _domain_masks(df, non_negative_columns)
    kinds = [OUTSIDE_MONTH] + [n for n, _ in masks]
    if stats is None:
        stats = file_statistics(df, file_col, ts_col=ts_col, stated_months=stated_months, month_col=month_col,
                                infer=infer, non_negative_columns=non_negative_columns, order_key=order_key)
    if schemas is None:
        fields = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("column"), F.lit(t).alias("dtype"))
                           for i, (n, t) in enumerate(df.select(*[F.col(f"`{c}`") for c in names]).dtypes)])
        schema_rows = stats.select("file", "rows", F.inline(fields))
    else:
        schema_rows = stats.join(schemas.withColumnRenamed("file_name", "file"), "file").select(
            "file", "rows", "ordinal", "column", "dtype")

    def struct(section, ordinal, key, metric, value, text=None):
        return F.struct(F.lit(section).alias("section"), F.lit(ordinal).alias("ordinal"), F.lit(key).alias("key"),
                        F.lit(metric).alias("metric"), value.cast("double").alias("value"),
                        (F.lit(None) if text is None else text).cast("string").alias("text"))
    none = F.lit(None)
    entries = []
    if ts_col in df.columns:
        entries += [struct("date_range", 0, ts_col, "min", none, F.col("lo")),
                    struct("date_range", 1, ts_col, "max", none, F.col("hi"))]
    counted = stats.select("file", "rows", F.inline(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("key"), F.col(f"c{i}").alias("n")) for i, c in enumerate(names)])))
    if schemas is not None:  # only the columns a file has, under their places in it
        own = schema_rows.select(F.col("file").alias("__f"), F.col("ordinal").alias("__o"), F.lower(F.coalesce(
            own_name(F.col("column"), ts_col), F.col("column"))).alias("__c"))
        counted = counted.join(own, F.col("file").eqNullSafe(F.col("__f")) & (F.lower("key") == F.col("__c"))).select(
            "file", "rows", F.col("__o").alias("ordinal"), "key", "n")
    flat = counted.select("file", "ordinal", "key", F.inline(F.array(
        F.struct(F.lit("null_count").alias("metric"), F.col("n").cast("double").alias("value")),
        F.struct(F.lit("null_pct").alias("metric"), F.coalesce(F.try_divide(F.col("n") * 100.0, F.col("rows")), F.lit(0.0)).alias("value"))))
        ).withColumns({"section": F.lit("nulls"), "text": F.lit(None).cast("string")})
    if entries:
        flat = flat.unionByName(stats.select("file", F.inline(F.array(*entries))))
    flat = flat.unionByName(schema_rows.select("file", F.lit("schema").alias("section"), "ordinal", F.col("column").alias("key"),
                                               F.lit("dtype").alias("metric"), F.col("rows").cast("double").alias("value"),
                                               F.col("dtype").alias("text")))
    copies = copy_groups(df.select(*[F.col(f"`{c}`") for c in [file_col, *names]])).groupBy(
        F.col(f"`{file_col}`").alias("__f")).agg(F.sum(F.col("copies") - 1).alias("d"))
    flat = flat.unionByName(stats.join(copies, F.col("file").eqNullSafe(F.col("__f")), "left").select(
        "file", struct("duplicates", 0, "all_columns", "duplicate_count", F.coalesce("d", F.lit(0))).alias("s")).select("file", "s.*"))
    found = stats.select("file", F.inline(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(kind).alias("key"), F.col(f"v{i}").alias("n"))
        for i, kind in enumerate(kinds)]))).where("n > 0")
    shown = _examples(df, stats, file_col, names, masks, month_col, ts_col, order_key)
    shown = shown.select(F.col("file").alias("__f"), F.col("ordinal").alias("__o"), "example")
    flat = flat.unionByName(
        found.join(shown, F.col("file").eqNullSafe(F.col("__f")) & (F.col("ordinal") == F.col("__o")), "left").select(
            "file", F.lit("violations").alias("section"), "ordinal", "key", F.lit("count").alias("metric"),
            F.col("n").cast("double").alias("value"), F.col("example").alias("text")))
    if files is not None:
        place = F.array_position(F.array(*[F.lit(f) for f in files]), F.col("file")) - 1
        ordered = flat.withColumn("file_ordinal", place.cast("int"))
    else:
        from pyspark.sql import Window
        ranks = stats.select(F.col("file").alias("__f"), (F.row_number().over(  # a row a file
            Window.partitionBy(F.lit(0)).orderBy("file")) - 1).alias("file_ordinal"))
        ordered = flat.join(ranks, F.col("file").eqNullSafe(F.col("__f")))
    return ordered.select(*REPORT_COLUMNS)


def own_name(column, ts_col: str):
    """The pickup column's name for its known variants, else NULL."""
    variants = [v.lower() for v in (*PICKUP_COLUMN_VARIANTS, ts_col)]
    return F.when(F.lower(column).isin(*variants), F.lit(ts_col))


def validation_report(df: DataFrame, *, ts_col: str = PICKUP, stated_month="infer",
                      non_negative_columns=None, order_key: Optional[str] = None) -> DataFrame:
    """Q10: tidy report rows ``(section, ordinal, key, metric, value, text)``.

    Sections: schema, nulls, date_range, duplicates, violations (``text`` is the
    example). An absent or empty timestamp column gives NULL range values
    instead of an error; an empty frame has its schema, zero counts and no
    violation.
    """
    if isinstance(stated_month, str) and stated_month != "infer":
        raise ValueError("stated_month must be a date, (y, m), 'infer' or None")
    one = df.withColumn("__file", F.lit("all"))
    given = None if stated_month is None or isinstance(stated_month, str) else {"all": stated_month}
    how = dict(ts_col=ts_col, stated_months=given, infer=stated_month == "infer",
               non_negative_columns=non_negative_columns, order_key=order_key)
    stats = file_statistics(one, "__file", **how)
    rows = (full_report_by_file(one, "__file", files=["all"], stats=stats, **how) if stats.take(1)
            else _empty_report(one, ts_col))
    return rows.select("section", "ordinal", "key", "metric", "value", "text")


def _empty_report(df: DataFrame, ts_col: str) -> DataFrame:
    """What the report of a frame without rows says."""
    names = [(n, t) for n, t in df.dtypes if n != "__file"]
    rows = [("schema", i, n, "dtype", 0.0, t) for i, (n, t) in enumerate(names)]
    rows += [("nulls", i, n, m, 0.0, None) for i, (n, _) in enumerate(names) for m in ("null_count", "null_pct")]
    rows += [("duplicates", 0, "all_columns", "duplicate_count", 0.0, None)]
    if ts_col in df.columns:
        rows += [("date_range", i, ts_col, m, None, None) for i, m in enumerate(("min", "max"))]
    return df.sparkSession.createDataFrame(
        rows, "section string, ordinal int, key string, metric string, value double, text string")


def validation_report_by_file(df: DataFrame, file_col: str, *, ts_col: str = PICKUP,
                              non_negative_columns=None) -> DataFrame:
    """The numbers of :func:`full_report_by_file` alone, as ``(file, ordinal,
    metric, value)``: rows, duplicate_count, min_pickup / max_pickup (epoch
    seconds) and one per violation type; each file's commonest month is its own."""
    stats = file_statistics(df, file_col, ts_col=ts_col, non_negative_columns=non_negative_columns)
    dups = copy_groups(df).groupBy(F.col(f"`{file_col}`").alias("__f")).agg(F.sum(F.col("copies") - 1).alias("__d"))
    wide = stats.join(dups, F.col("file").eqNullSafe(F.col("__f")), "left")
    values = [("rows", F.col("rows")), ("duplicate_count", F.coalesce("__d", F.lit(0))),
              ("min_pickup", epoch_seconds(F.col("lo"))), ("max_pickup", epoch_seconds(F.col("hi"))),
              (OUTSIDE_MONTH, F.col("v0"))]
    values += [(n, F.col(f"v{i}")) for i, (n, _) in enumerate(_domain_masks(df, non_negative_columns), 1)]
    long = wide.select("file", F.inline(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("metric"), v.cast("double").alias("value"))
        for i, (n, v) in enumerate(values)])))
    return long.where(~((F.col("ordinal") >= 4) & (F.col("value") == 0)))


# --------------------------------------------------------------------------- Q12
def check_contract(df: DataFrame) -> DataFrame:
    """One row ``(ok, error, offending_column)`` - the first failing rule.

    Rule order: columns present -> period parses -> region is text -> demand
    numeric -> whole -> non-negative.  An empty table with the columns passes.
    """
    spark = _spark(df)
    schema = "ok boolean, error string, offending_column string"
    for c in CONTRACT_COLUMNS:
        if c not in df.columns:
            msg = f"Column '{c}' " + CONTRACT_MISSING.format(cols=list(CONTRACT_COLUMNS))
            return spark.createDataFrame([(False, msg, c)], schema)
    p, r, d = F.col(PERIOD), F.col(REGION), F.col(DEMAND)
    pdt = df.schema[PERIOD].dataType
    if isinstance(pdt, (TimestampType, TimestampNTZType, DateType)):
        bad_period = F.lit(False)
    else:
        bad_period = p.isNotNull() & to_ts(p).isNull()
    region_is_text = isinstance(df.schema[REGION].dataType, StringType)
    dnum = d.try_cast("double")
    bad_num = d.isNotNull() & dnum.isNull()
    frac = dnum.isNotNull() & ~F.isnan(dnum) & (dnum != F.round(dnum))
    neg = dnum.isNotNull() & (dnum < 0)
    agg = df.agg(F.count_if(bad_period).alias("bp"),
                 (F.count_if(r.isNotNull()) if not region_is_text else F.lit(0)).alias("br"),
                 F.count_if(bad_num).alias("bn"), F.count_if(frac).alias("bf"),
                 F.count_if(neg).alias("bg"))
    rules = [
        ("bp", PERIOD, CONTRACT_BAD_PERIOD),
        ("br", REGION, CONTRACT_BAD_REGION),
        ("bn", DEMAND, CONTRACT_NON_NUMERIC),
        ("bf", DEMAND, CONTRACT_FRACTIONAL),
        ("bg", DEMAND, CONTRACT_NEGATIVE),
    ]
    offender = F.coalesce(*[F.when(F.col(k) > 0, F.lit(c)) for k, c, _ in rules])
    error = F.coalesce(*[F.when(F.col(k) > 0, F.lit(f"Column '{c}' {t}")) for k, c, t in rules])
    return agg.select(offender.isNull().alias("ok"), error.alias("error"),
                      offender.alias("offending_column"))


# --------------------------------------------------------------------------- Q13
def report_lines(report: DataFrame) -> DataFrame:
    """Printable lines over a :func:`validation_report`, with % of rows.

    Output ``(section, ordinal, line)`` ordered by section then ordinal.
    """
    from pyspark.sql import Window
    # the report holds one row per column / violation: a bounded, tiny table
    j = report.withColumn("__rows", F.max(F.when(F.col("section") == "schema", F.col("value")))
                          .over(Window.partitionBy()))
    pct = F.coalesce(F.try_divide(F.col("value") * 100.0, F.col("__rows")), F.lit(0.0))
    line = (F.when(F.col("section") == "schema",
                   F.format_string("column %s: %s", "key", "text"))
             .when(F.col("section") == "nulls",
                   F.format_string("nulls %s %s: %s", "key", "metric", F.format_number("value", 2)))
             .when(F.col("section") == "date_range",
                   F.format_string("pickup %s: %s", "metric", "text"))
             .when(F.col("section") == "duplicates",
                   F.format_string("duplicates: %s (%s%% of rows)",
                                   F.col("value").cast("long"), F.format_number(pct, 2)))
             .otherwise(F.format_string("violation %s: %s (%s%% of rows)", "key",
                                        F.col("value").cast("long"), F.format_number(pct, 2))))
    return j.select("section", "ordinal", line.alias("line"), pct.alias("pct_of_rows"))


# ------------------------------------------------------------- Q14, Q15, Q16, Q17
def apply_validity_rules(df: DataFrame, *, rule: str = HANDLING_RULE_DROP,
                         ts_col: str = PICKUP, stated_month="infer",
                         non_negative_columns=None, check_duplicates: bool = False,
                         null_columns=None, month_col: Optional[str] = None):
    """Drop every row failing at least one check; return ``(clean, log)``.

    ``log`` is one row ``(rule, rule_description, total_invalid_handled,
    counts_by_type MAP<STRING,BIGINT>, input_row_count, output_row_count)``;
    types with a zero count are left out of the map.

    With ``check_duplicates`` later copies of a row are invalid too.  Copies are
    identical (with ``month_col``: in the same month's file), so the survivors
    are the distinct rows that pass the other checks; only rows whose hash
    repeats are grouped in full.
    """
    if rule != HANDLING_RULE_DROP:
        raise ValueError(f"Unsupported handling rule '{rule}'. Supported rules: "
                         f"['{HANDLING_RULE_DROP}'].")
    masks = violation_masks(df, ts_col=ts_col, stated_month=stated_month,
                            non_negative_columns=non_negative_columns,
                            null_columns=null_columns, month_col=month_col)
    any_bad = reduce(lambda a, b: a | b, [m for _, m in masks], F.lit(False))
    clean = df.where(~any_bad)
    names = [n for n, _ in masks]
    aggs = [F.count(F.lit(1)).alias("input_row_count"), F.count_if(~any_bad).alias("__valid")]
    aggs += [F.count_if(m).alias(f"t{i}") for i, (_, m) in enumerate(masks)]
    stats = df.agg(*aggs)
    type_cols = [F.col(f"t{i}") for i in range(len(masks))]
    if check_duplicates:
        # equal rows (the month of their file included) fail the same checks
        clean = distinct_rows(clean)
        extra = copy_groups(df).withColumn("__ok", ~any_bad).agg(
            F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("__dup"),
            F.coalesce(F.sum(F.when(F.col("__ok"), F.col("copies") - 1)), F.lit(0)).alias("__dup_ok"))
        stats = (stats.withColumn("__one", F.lit(1)).join(extra.withColumn("__one", F.lit(1)), "__one")
                 .withColumn("__valid", F.col("__valid") - F.col("__dup_ok")))
        names.append("duplicate")
        type_cols.append(F.col("__dup"))
    out_rows = F.coalesce(F.col("__valid"), F.lit(0))
    stats = stats.withColumn("input_row_count", F.coalesce("input_row_count", F.lit(0)))
    if names:
        pairs = F.map_from_arrays(F.array(*[F.lit(n) for n in names]),
                                  F.array(*[c.cast("long") for c in type_cols]))
        counts = F.map_filter(pairs, lambda k, v: v > 0)
    else:
        counts = F.create_map().cast("map<string,bigint>")
    log = stats.select(
        F.lit(rule).alias("rule"), F.lit(DROP_RULE_DESCRIPTION).alias("rule_description"),
        (F.col("input_row_count") - out_rows).cast("long").alias("total_invalid_handled"),
        counts.alias("counts_by_type"),
        F.col("input_row_count").cast("long").alias("input_row_count"),
        out_rows.cast("long").alias("output_row_count"))
    return clean, log


def handling_log(df: DataFrame, **kw) -> DataFrame:
    return apply_validity_rules(df, **kw)[1]


# --------------------------------------------------------------------------- Q18
def reconcile(series: DataFrame, valid_trips: DataFrame, demand_col: str = DEMAND) -> DataFrame:
    """One row ``(total_demand, raw_valid_count, difference, reconciled)``.

    NULL / non-numeric demand counts as 0.
    """
    # one union + one aggregate instead of joining two one-row results
    d = F.coalesce(F.col(demand_col).try_cast("long"), F.lit(0))
    both = series.select(d.alias("__d"), F.lit(False).alias("__trip")).unionByName(
        valid_trips.select(F.lit(0).cast("long").alias("__d"), F.lit(True).alias("__trip")))
    return both.agg(F.coalesce(F.sum(F.when(~F.col("__trip"), F.col("__d"))), F.lit(0))
                    .cast("long").alias("total_demand"),
                    F.count_if("__trip").cast("long").alias("raw_valid_count")).select(
        "total_demand", "raw_valid_count",
        (F.col("total_demand") - F.col("raw_valid_count")).alias("difference"),
        (F.col("total_demand") == F.col("raw_valid_count")).alias("reconciled"))


# --------------------------------------------------------------------------- Q19
def reconcile_partials(partials: DataFrame, series: DataFrame,
                       demand_col: str = DEMAND) -> DataFrame:
    """Sum of the independent partial aggregates vs the prepared series."""
    both = partials.select(F.col(demand_col).cast("long").alias("__d"), F.lit(True).alias("__p")) \
        .unionByName(series.select(F.col(demand_col).cast("long").alias("__d"), F.lit(False).alias("__p")))
    return both.agg(
        F.coalesce(F.sum(F.when(F.col("__p"), F.col("__d"))), F.lit(0)).alias("partials_total"),
        F.coalesce(F.sum(F.when(~F.col("__p"), F.col("__d"))), F.lit(0)).alias("series_total"),
    ).select("partials_total", "series_total",
             (F.col("series_total") - F.col("partials_total")).alias("difference"),
             (F.col("series_total") == F.col("partials_total")).alias("reconciled"))


# --------------------------------------------------------------------------- Q20
def check_grid(series: DataFrame) -> DataFrame:
    """Grid completeness: rows = periods x regions, unique keys, demand >= 0."""
    return series.agg(
        F.count(F.lit(1)).cast("long").alias("rows"),
        F.count_distinct(PERIOD).cast("long").alias("periods"),
        F.count_distinct(REGION).cast("long").alias("regions"),
        F.count_distinct(F.struct(PERIOD, REGION)).cast("long").alias("distinct_keys"),
        F.min(DEMAND).cast("long").alias("min_demand"),
    ).withColumn("complete", (F.col("rows") == F.col("periods") * F.col("regions"))
                 & (F.col("distinct_keys") == F.col("rows"))
                 & F.coalesce(F.col("min_demand") >= 0, F.lit(True)))


# --------------------------------------------------------------------------- Q21
def check_lags(series: DataFrame, lags: Iterable[int]) -> DataFrame:
    """Independent re-computation of every ``lag_k`` via a self equi-join on
    ``(region, row_number - k)``; rows ``(lag, checked, mismatches)``."""
    from pyspark.sql import Window
    w = Window.partitionBy(REGION).orderBy(PERIOD)
    base = series.withColumn("__rn", F.row_number().over(w))
    out = []
    for k in sorted(set(int(x) for x in lags)):
        prev = base.select(F.col(REGION).alias("__r"), (F.col("__rn") + k).alias("__rn2"),
                           F.col(DEMAND).cast("double").alias("__expect"))
        j = base.join(prev, (base[REGION] == prev["__r"]) & (base["__rn"] == prev["__rn2"]), "left")
        out.append(j.agg(F.lit(k).alias("lag"), F.count(F.lit(1)).cast("long").alias("checked"),
                         F.count_if(~F.col(f"lag_{k}").eqNullSafe(F.col("__expect")))
                         .cast("long").alias("mismatches")))
    return reduce(lambda a, b: a.unionByName(b), out)


# --------------------------------------------------------------------------- Q22
def check_alignment(forecasts: DataFrame, holdout_periods: DataFrame) -> DataFrame:
    """Per model: distinct holdout periods covered vs expected; mismatches listed."""
    expected = holdout_periods.select(PERIOD).distinct().count()  # tiny parameter
    hp = holdout_periods.select(PERIOD).distinct()
    cov = (forecasts.join(hp, PERIOD, "left_semi").groupBy("model")
                    .agg(F.count_distinct(PERIOD).cast("long").alias("covered")))
    allm = forecasts.select("model").distinct()
    return (allm.join(cov, "model", "left")
                .select("model", F.coalesce("covered", F.lit(0)).cast("long").alias("covered"),
                        F.lit(expected).cast("long").alias("expected"))
                .withColumn("aligned", F.col("covered") == F.col("expected")))
