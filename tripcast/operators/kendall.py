"""Kendall's tau-b counted set-wise.

Concordant minus discordant pairs of a series of n points, without forming the
n^2 pairs and without one task that holds the series. Both axes are cut at
about sqrt(n) quantiles; a quantile's own value is a block of its own, so a
value that a third of the points share has no pairs to compare inside.

* Points in different blocks of both axes are counted by cells: a running sum
  over the grid, first along one axis and then along the other, says how many
  points lie below and left of a cell, and below and right.
* Points that share a block of one axis are compared inside it, in arrays of
  about sqrt(n) points.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripcast.session import written

def _zero():
    return F.lit(0).cast("long")


def _block(value, bounds):
    """Even: between two quantiles; odd: at one."""
    return 2 * F.size(F.filter(bounds, lambda q: q < value)) + F.array_contains(bounds, value).cast("int")


def _compared(points, earlier, sign):
    """Sum over ordered pairs (j, i) of an array with earlier(j, i) of the
    weights' product times sign(j, i)."""
    return F.aggregate(points, _zero(), lambda total, i: total + i["w"] * F.aggregate(
        points, _zero(), lambda s, j: s + F.when(earlier(j, i), j["w"] * sign(j, i)).otherwise(_zero())))


def _up(low, high):
    return F.when(low < high, F.lit(1).cast("long")).when(low > high, F.lit(-1).cast("long")).otherwise(_zero())


def tau_b(points: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """(*keys, r) over the rows with both values; NULL where an axis has one value."""
    keys = list(keys)
    real = F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(a) & ~F.isnan(b)
    pts = points.where(real).groupBy(*keys, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("w"))
    pts = written(pts, "kendall-points")
    sizes = pts.groupBy(*keys).agg(F.sum("w").alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    cuts = max(1, math.isqrt(most))
    shares = [i / (cuts + 1) for i in range(1, cuts + 1)]
    bounds = pts.groupBy(*keys).agg(*[F.array_distinct(F.percentile_approx(c, shares, 10_000)).alias(f"q{c}") for c in "ab"])
    pts = written(pts.join(bounds, keys).select(*keys, "a", "b", "w", _block(F.col("a"), F.col("qa")).alias("u"),
                                                _block(F.col("b"), F.col("qb")).alias("v")), "kendall-blocks")

    cells = pts.groupBy(*keys, "u", "v").agg(F.sum("w").alias("c"))
    grid = pts.groupBy(*keys).agg(F.max("u").alias("mu"), F.max("v").alias("mv"))
    grid = grid.select(*keys, F.explode(F.sequence(F.lit(0), "mu")).alias("u"), "mv").select(
        *keys, "u", F.explode(F.sequence(F.lit(0), "mv")).alias("v"))
    grid = grid.join(cells, [*keys, "u", "v"], "left").withColumn("c", F.coalesce("c", _zero()))
    left = F.coalesce(F.sum("c").over(Window.partitionBy(*keys, "v").orderBy("u").rowsBetween(
        Window.unboundedPreceding, -1)), _zero())
    row = Window.partitionBy(*keys, "u").orderBy("v")
    below = F.coalesce(F.sum("left").over(row.rowsBetween(Window.unboundedPreceding, -1)), _zero())
    over = F.coalesce(F.sum("left").over(row.rowsBetween(1, Window.unboundedFollowing)), _zero())
    apart = (grid.withColumn("left", left).withColumn("s", F.col("c") * (below - over))
             .groupBy(*keys).agg(F.sum("s").alias("s")))

    def inside(axis, columns, earlier, sign):
        blocks = pts.where(F.col(axis) % 2 == 0).groupBy(*keys, axis).agg(F.collect_list(F.struct(*columns, "w")).alias("p"))
        return blocks.groupBy(*keys).agg(F.sum(_compared(F.col("p"), earlier, sign)).alias("s"))
    same_u = inside("u", ["a", "b"], lambda j, i: j["a"] < i["a"], lambda j, i: _up(j["b"], i["b"]))
    same_v = inside("v", ["u", "b"], lambda j, i: j["u"] < i["u"], lambda j, i: _up(j["b"], i["b"]))

    def tied(axis):
        t = pts.groupBy(*keys, axis).agg(F.sum("w").alias("t"))
        return t.groupBy(*keys).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias("t"))
    parts = [apart.select(*keys, "s"), same_u, same_v]
    score = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*keys).agg(F.sum("s").alias("s"))
    both = (sizes.join(score, keys).join(tied("a").withColumnRenamed("t", "ta"), keys)
            .join(tied("b").withColumnRenamed("t", "tb"), keys))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return both.select(*keys, F.try_divide(F.col("s"), F.sqrt(pairs - F.col("ta")) * F.sqrt(pairs - F.col("tb"))).alias("r"))
