"""Column-level building blocks shared by the operators.

Everything here returns a ``Column`` made of built-in functions, so it stays
inside whole-stage codegen.  NaN is treated as missing (pandas semantics) and
every cast that may fail uses the ``try_`` family, because ANSI mode raises.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

__all__ = [
    "nan_to_null", "as_double", "to_ts", "day_period", "month_start",
    "weekday0", "is_weekend", "dow_dummy_cols", "iso_week", "clip_lower",
    "round6", "is_float_type", "is_numeric_type", "epoch_seconds", "lit_ntz",
]


def is_float_type(dtype) -> bool:
    return isinstance(dtype, (DoubleType, FloatType))


def is_numeric_type(dtype) -> bool:
    return isinstance(dtype, NumericType)


def nan_to_null(c) -> Column:
    """NaN -> NULL for a double column (trap: NaN is a value in Spark)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(c, F.lit(None).cast("double"))


def as_double(c) -> Column:
    """Numeric coercion: unparsable -> NULL, NaN -> NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return nan_to_null(c.try_cast("double"))


def to_ts(c) -> Column:
    """Coerce anything (timestamp, date, text) to TIMESTAMP_NTZ; bad -> NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.try_cast("timestamp_ntz"),
                      F.try_to_timestamp(c.cast("string")).cast("timestamp_ntz"))


def day_period(c) -> Column:
    """Wall-clock day start as TIMESTAMP_NTZ (zone free)."""
    return to_ts(c).cast("date").cast("timestamp_ntz")


def month_start(c) -> Column:
    """First day of the month (DATE) of a timestamp."""
    return F.trunc(to_ts(c).cast("date"), "MM")


def weekday0(c) -> Column:
    """Day of week with Monday = 0 .. Sunday = 6."""
    return F.weekday(to_ts(c).cast("date"))


def is_weekend(c) -> Column:
    return (weekday0(c) >= 5).cast("int")


def dow_dummy_cols(c, prefix: str = "dow_") -> list[Column]:
    """Six day-of-week indicators, Monday is the reference level."""
    wd = weekday0(c)
    return [F.when(wd == d, 1.0).otherwise(0.0).alias(f"{prefix}{d}")
            for d in range(1, 7)]


def iso_week(c) -> Column:
    return F.weekofyear(to_ts(c).cast("date"))


def clip_lower(c, lo: float = 0.0) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull(), c).otherwise(F.greatest(c, F.lit(lo)))


def round6(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


def epoch_seconds(c) -> Column:
    """Seconds since 1970-01-01 of a wall-clock stamp, independent of the
    session time zone (TIMESTAMP_NTZ semantics)."""
    c = to_ts(c)
    return (F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400
            + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)).cast("long")


def lit_ntz(value) -> Column:
    """A TIMESTAMP_NTZ literal from a Python date/datetime, built from its
    wall-clock text so neither the session nor the Python zone shifts it."""
    if value is None:
        return F.lit(None).cast("timestamp_ntz")
    text = value.isoformat(sep=" ") if hasattr(value, "hour") else value.isoformat()
    return F.lit(text).cast("timestamp_ntz")
