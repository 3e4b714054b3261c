"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripcast.session import written


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b); the
    component is its smallest node.

    Each round lets every node follow its smallest neighbour if that is
    smaller (pointers only ever go down, so they form a forest), follows the
    pointers to their end, and replaces both ends of every link by them.
    Links within a component vanish, so the table shrinks until it is empty.
    Minimum and distinct are partial aggregates; the joins have unique keys on
    one side, so a hub's rows can be split over tasks. An empty link table
    gives an empty result.
    """
    spark = links.sparkSession
    links = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = written(links, "links")
    found = None  # (node, component) so far
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy(F.col("a").alias("node")).agg(
            F.min("b").alias("up")).select("node", F.least("node", "up").alias("up")), "pointers")
        while True:  # halves the longest chain each time
            top = step.select(F.col("node").alias("up"), F.col("up").alias("over"))
            step = written(step.join(top, "up").select("node", F.col("over").alias("up"),
                                                       (F.col("over") != F.col("up")).alias("moved")), "pointers")
            moved = step.where("moved")
            step = step.select("node", "up")
            if moved.isEmpty():
                break
        if found is None:
            found = step.select("node", F.col("up").alias("component"))
        else:
            top = step.select(F.col("node").alias("component"), "up")
            found = found.join(top, "component", "left").select(
                "node", F.coalesce("up", "component").alias("component"))
        found = written(found, "components")
        links = (links.join(step.select(F.col("node").alias("a"), F.col("up").alias("a2")), "a")
                 .join(step.select(F.col("node").alias("b"), F.col("up").alias("b2")), "b")
                 .where("a2 <> b2")
                 .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
        links = written(links, "links")
    if found is None:
        found = spark.createDataFrame([], links.select(F.col("a").alias("node"), F.col("b").alias("component")).schema)
    return found
