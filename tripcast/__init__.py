"""tripcast: a Spark-native demand-series engine.

Raw timestamped, located event records become validated, gap-free demand
series (period x region), which are explored, split, forecast by several model
families, scored, ranked and turned into per-period placements with an impact
estimate.  Every step is a DataFrame -> DataFrame function that Catalyst plans.
"""

__version__ = "0.1.0"
