"""Exact order statistics of groups of any size.

The value of a rank is found by histograms: each pass counts a group's values that are still possible in bins between
their least and largest, and goes on with the bin that the rank falls into, between that bin's own least and largest
value. Counts are added up where rows are read, so no task holds a group, however large; a pass leaves a ``BINS``-th of
the range, of values and of their logarithms by turns, and a group is done when one value is left.

Defined results: of n values the median is the one of rank n // 2 from 0 (the upper of the two in the middle); nulls
and values that aren't finite take no part, and a group of nothing else has no row; a null key is a group of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

#: Bins of a pass; rows of a group are joined with its state under so many salts.
BINS, SALTS = 512, 16


def _bin(v: Column, lo: Column, hi: Column, by_size: bool) -> Column:
    """Bins of even width, of values or of their logarithms. The least value is in the first bin, the largest in the
    last, whatever rounding does between."""
    scale = (lambda x: F.signum(x) * (F.coalesce(F.ln(F.abs(x)), F.lit(0.0)) + 750)) if by_size else (lambda x: x / 2)  # halves, so that no difference is too large
    share = F.try_divide(scale(v) - scale(lo), scale(hi) - scale(lo))
    return F.when(v == lo, 0).when(v == hi, BINS - 1).otherwise(F.least(F.lit(BINS - 1), F.coalesce(F.floor(share * BINS).cast("int"), F.lit(0))))


def upper_medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, median of each group."""
    d = rows.select(F.col(key).alias("key"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity')")
    state = stored(d.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("rank", F.floor(F.col("n") / 2).cast("long")))
    salted = d.withColumn("salt", F.pmod(F.xxhash64("v", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    passes = 0
    while not (left := state.where("lo < hi")).isEmpty():
        spread = left.select(F.col("key").alias("_key"), "n", "lo", "hi", "rank", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        open_ = salted.join(spread, F.col("key").eqNullSafe(F.col("_key")) & (F.col("salt") == F.col("_salt"))).where("v BETWEEN lo AND hi")
        counts = open_.groupBy("key", "n", "rank", _bin(F.col("v"), F.col("lo"), F.col("hi"), passes % 2 == 1).alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("c").over(Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))  # BINS rows a group at most
        found = counts.withColumn("upto", upto).where("upto > rank AND upto - c <= rank")
        passes += 1
        state = stored(state.where("lo = hi").unionByName(found.select("key", "n", "lo", "hi", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"))))
    return state.select("key", "n", F.col("lo").alias("median"))
