"""Forecasting jobs.  Every model returns the one long schema
``(model, period, region [NULL = total], yhat)``."""

FORECAST_SCHEMA = "model string, period timestamp_ntz, region string, yhat double"
STATUS_SCHEMA = "model string, region string, excluded boolean, reason string"
