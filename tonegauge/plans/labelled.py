"""Precision and recall of the levels found against labels, with bootstrap intervals.

The bootstrap is a Poisson one: in each replicate a message counts as often as a Poisson number of mean 1 says, which a
hash of its key and the replicate's number gives. So all replicates come out of one pass and of one sum, whose groups are
replicates times pairs of levels, however many messages there are, and a run gives what the run before gave.

Defined results: a message without a request has level 0; labels of messages that aren't there, and messages without a
label, take no part; of several labels of a message each counts. A level that nothing was found of has no precision, one
without labels no recall (null); replicates in which that is so take no part in its interval.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPLICATES = 100
#: Hash values are hexadecimal numbers of so many digits.
DIGITS = 7


def poisson_bounds() -> list[int]:
    """A message counts once more for each of these numbers that its hash value isn't below."""
    upto, bounds = 0.0, []
    for k in range(9):
        upto += math.exp(-1) / math.factorial(k)
        bounds.append(math.floor(upto * 16**DIGITS))
    return bounds


def _weight(key: Column, replicate: Column) -> Column:
    value = F.conv(F.substring(F.md5(F.concat_ws(":", key, replicate.cast("string"))), 1, DIGITS), 16, 10).cast("long")
    return F.aggregate(F.array(*[F.lit(b) for b in poisson_bounds()]), F.lit(0), lambda n, b: n + (value >= b).cast("int"))


def _interval(shares: Column, low: bool) -> Column:
    """The share at rank floor(n / 40) from below, or from above."""
    known = F.sort_array(F.filter(shares, lambda x: x.isNotNull()))
    cut = F.floor(F.size(known) / 40).cast("int")
    return F.get(known, cut if low else F.size(known) - 1 - cut)


def level_metrics(results: DataFrame, labels: DataFrame, key: str = "msg_id", replicates: int = REPLICATES) -> DataFrame:
    """level, labelled, found, agreed, precision, recall and the bounds of their 95 % intervals.

    results: as of ``score_threads``; labels: key, label (0 to 9). Replicate 0 has every message once.
    """
    found = results.select(key, F.coalesce("head_act.level", F.lit(0)).cast("int").alias("level")).join(labels.select(key, F.col("label").cast("int").alias("label")).where("label IS NOT NULL"), key)
    number = F.col("replicate")
    rows = found.select(key, "level", "label", F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("replicate"))
    weighed = rows.withColumn("w", F.when(number == 0, 1).otherwise(_weight(F.col(key), number)))
    cells = weighed.groupBy("replicate", "level", "label").agg(F.sum("w").cast("long").alias("w"))
    sides = cells.select("replicate", "w", F.inline(F.array(
        F.struct(F.col("label").alias("of"), F.col("w").alias("labelled"), F.lit(0).cast("long").alias("found"), F.when(F.col("level") == F.col("label"), F.col("w")).otherwise(0).alias("agreed")),
        F.struct(F.col("level").alias("of"), F.lit(0).cast("long").alias("labelled"), F.col("w").alias("found"), F.lit(0).cast("long").alias("agreed")),
    )))
    counts = sides.groupBy("of", "replicate").agg(*[F.sum(c).alias(c) for c in ("labelled", "found", "agreed")])
    shares = counts.select("*", F.try_divide(F.col("agreed"), F.col("found")).alias("precision"), F.try_divide(F.col("agreed"), F.col("labelled")).alias("recall"))
    whole = number == 0
    # a list of as many shares as there are replicates
    per = shares.groupBy(F.col("of").alias("level")).agg(
        *[F.max(F.when(whole, F.col(c))).alias(c) for c in ("labelled", "found", "agreed", "precision", "recall")],
        *[F.collect_list(F.when(~whole, F.col(c))).alias(f"_{c}") for c in ("precision", "recall")],
    )
    bounds = [_interval(F.col(f"_{c}"), low).alias(f"{c}_{'low' if low else 'high'}") for c in ("precision", "recall") for low in (True, False)]
    return per.select("level", "labelled", "found", "agreed", "precision", "recall", *bounds)
