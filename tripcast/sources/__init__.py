"""Scans, sinks and the adapters that present the driver tables as trips."""
