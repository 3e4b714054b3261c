"""Job parameters (the forecasting scope).

A small frozen dataclass handed to each job; its values become literals in the
plans.  The analysis window must span 12 to 24 calendar months.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date

# Fixed values that must equal the reference's behaviour.
DEFAULT_TIME_GRAIN = "daily"
DEFAULT_WINDOW_START = date(2025, 5, 1)
DEFAULT_WINDOW_END = date(2026, 4, 30)
DEFAULT_HOLDOUT_PERIODS = 30
DEFAULT_LAGS = (1, 7, 14)
MIN_WINDOW_MONTHS = 12
MAX_WINDOW_MONTHS = 24
SUPPORTED_TIME_GRAINS = ("daily",)

# Column names of the central DemandSeries table.
PERIOD = "period"
REGION = "region"
DEMAND = "demand"
PICKUP = "pickup_datetime"
LOCATION = "PULocationID"
LOOKUP_ID = "LocationID"
LOOKUP_BOROUGH = "Borough"


def window_months(start: date, end: date) -> int:
    """Calendar months that ``start..end`` touches, both ends included."""
    return 12 * (end.year - start.year) + end.month - start.month + 1


@dataclass(frozen=True)
class Scope:
    """What a job forecasts: a daily series over a window of whole days."""
    time_grain: str = DEFAULT_TIME_GRAIN
    window_start: date = DEFAULT_WINDOW_START
    window_end: date = DEFAULT_WINDOW_END
    holdout_periods: int = DEFAULT_HOLDOUT_PERIODS
    lags: tuple = DEFAULT_LAGS

    def __post_init__(self):
        if self.time_grain not in SUPPORTED_TIME_GRAINS:
            raise ValueError(f"time grain {self.time_grain!r} is not one of {SUPPORTED_TIME_GRAINS}")
        if not self.window_start <= self.window_end:
            raise ValueError("the window ends before it starts")
        if self.window_months not in range(MIN_WINDOW_MONTHS, MAX_WINDOW_MONTHS + 1):
            raise ValueError(f"a window covers {MIN_WINDOW_MONTHS} to {MAX_WINDOW_MONTHS} calendar months, "
                             f"not {self.window_months}")

    @property
    def window_months(self) -> int:
        return window_months(self.window_start, self.window_end)

    def with_changes(self, **kw) -> "Scope":
        return replace(self, **kw)


# Scope used with the driver's test tables.
TEST_SCOPE = Scope(window_start=date(1997, 1, 1), window_end=date(1997, 12, 31))
