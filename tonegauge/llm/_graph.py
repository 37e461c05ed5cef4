"""Connected components of links between numbers, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import compact, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: every node joins its larger neighbours to the least of itself and its neighbours.
    Small star: every node joins its smaller neighbours and itself to the least of them."""
    seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    if large:
        return seen.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
    joined = seen.join(least, "a")
    out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether nothing but stars is left: every node points to one other at most, and none that points is pointed to."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    degrees = ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return degrees.where("out > 1 OR (out = 1 AND in = 1)").isEmpty()


def components(links: DataFrame, most_rounds: int = 200) -> DataFrame:
    """id, component (the least id that links reach) for every id that a link (a, b) names.

    Each round is a few joins and partial aggregates over the links alone, with the
    lineage cut in the shared folder; the number of rounds grows with the logarithm
    of the longest path. It ends when only stars are left, which is looked up, not
    estimated; not to end is an error.
    """
    edges = links.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a > b").distinct()
    edges = compact(materialize(edges))
    rounds = 0
    while not _stars(edges):
        if rounds == most_rounds:
            raise RuntimeError(f"components are not complete after {rounds} rounds")
        edges = compact(materialize(_star(_star(edges, large=True), large=False)))
        rounds += 1
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
