"""Filter interaction audit by lattice-edge aggregation.

Five filters, each a property of a document alone (``E``: of the whole table), give a document a set of filters
that it fails. Every order in which they can be applied is a path through the lattice of subsets of filters: a
step of an order is the edge (subset applied already, next filter), and what the step does depends on that edge
alone. So documents are counted once, by part and set of failed filters; each count goes to the 80 edges; and the
600 steps of the 120 orders pick up their edge by a join of at most 80 rows a part with a table of 600.

``E`` needs the smallest doc_id of each text. Equal texts fail the same other filters, so documents are counted by
(digest of the text, part, labels) with the smallest doc_id of each, and only these counts meet by digest: a text
that a third of all documents share is a few rows, whatever task they were read in.

Defined results: a null text is empty; a null lang is the empty string; a null doc_id has no labels and is never a
smaller one, nor has it a smaller one; rows that repeat a doc_id are documents of their own, of which none has a
smaller doc_id than another; labels that repeat a doc_id count if any of them says so; null labels are no labels;
words are found block by block, so a very long text costs memory for its distinct words only; an empty table gives
no rows; further columns are ignored. Digests are of 128 bits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import importable, pieces, record_batch, tidy

FILTERS = "ABCDE"
#: Fewest words; least share of distinct words and largest share of capitals, in percent.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
_MARKS = re.compile(rb"[#$%&*|]")
_CAPITALS = bytes(range(65, 91))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BLOCK = 1 << 20
_FAILS = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), ("fails", pa.int32())])


def _blocks(raw: bytes) -> Iterator[bytes]:
    """The text in blocks that end at white space."""
    at = 0
    while at < len(raw):
        border = _SPACE.search(raw, at + _BLOCK)
        stop = border.start() if border else len(raw)
        yield raw[at:stop]
        at = stop


def failed(text: str) -> int:
    """Of the filters A to D, those that a text fails, as bits."""
    raw = text.encode()
    words, distinct = 0, set()
    for block in _blocks(raw):
        found = block.split()  # the white space of bytes.split is the words' border
        words += len(found)
        distinct.update(found)
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    fails = (words < LEAST_WORDS, 100 * len(distinct) < LEAST_DISTINCT * words, 100 * capitals > MOST_CAPITALS * len(text), _MARKS.search(raw) is not None)
    return sum(bad << i for i, bad in enumerate(fails))


def with_fails(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, fails (bits of A to D) of every document."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in pieces(batch.column(2)):
                digests = [hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts]
                yield record_batch(_FAILS, [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), digests, [failed(t) for t in texts]])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return own.mapInArrow(tidy(run), "doc_id long, part string, digest binary, fails int")


def counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bits of all five), good, toxic, n: a row for each that occurs."""
    said = labels.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = with_fails(docs).groupBy("doc_id", "part", "digest", "fails").agg(F.count("*").alias("n"))
    rows = rows.join(said.where("_id IS NOT NULL"), F.col("doc_id") == F.col("_id"), "left")
    rows = rows.select("doc_id", "part", "digest", "fails", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    # of each digest a few rows are left: all its documents, and those of the smallest doc_id among them
    known = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    groups = rows.groupBy("digest", "part", "fails", "good", "toxic").agg(F.sum("n").alias("n"), F.min(known).alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    fresh = F.col("nameless") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0)
    both = groups.withColumn("fresh", fresh).select(
        "part", "good", "toxic", F.inline(F.array(F.struct("fails", F.col("fresh").alias("n")), F.struct((F.col("fails") + 16).alias("fails"), (F.col("n") - F.col("fresh")).alias("n"))))
    )
    return both.groupBy("part", "fails", "good", "toxic").agg(F.sum("n").alias("n")).where("n > 0")


def edges(found: DataFrame) -> DataFrame:
    """part, applied (bits), filter (number): what the filter does after those applied, in documents."""
    every = [(applied, f) for applied in range(1 << len(FILTERS)) for f in range(len(FILTERS)) if not applied >> f & 1]
    d = found.withColumn("e", F.explode(F.array(*[F.struct(F.lit(a).alias("applied"), F.lit(f).alias("filter"), F.lit(1 << f).alias("bit")) for a, f in every])))
    before, own = F.col("fails").bitwiseAND(F.col("e.applied")) != 0, F.col("fails").bitwiseAND(F.col("e.bit")) != 0
    removed = ~before & own
    total = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    return d.groupBy("part", F.col("e.applied").alias("applied"), F.col("e.filter").alias("filter")).agg(
        total(~before & ~own).alias("kept"), total(removed).alias("removed"), total(before & own).alias("redundant"), total(F.col("fails") == F.col("e.bit")).alias("unique_fails"),
        total(removed & F.col("good")).alias("good_lost"), total(removed & F.col("toxic")).alias("toxic_lost"),
    )


def paths() -> list[tuple[str, int, int, int]]:
    """(order, step, applied before it, filter) of all orders: 600 rows."""
    return [("".join(order), i + 1, sum(1 << FILTERS.index(x) for x in order[:i]), FILTERS.index(order[i])) for order in permutations(FILTERS) for i in range(len(order))]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    # an edge lies on |applied|! * (4 - |applied|)! of the orders
    weight = F.element_at(F.array(*[F.lit(factorial(k) * factorial(len(FILTERS) - 1 - k)) for k in range(len(FILTERS))]), F.bit_count("applied") + 1)
    share = F.sum(F.col("removed") * weight).over(Window.partitionBy("part", "filter"))
    steps = docs.sparkSession.createDataFrame(paths(), "filter_order string, step int, applied int, filter int")
    d = edges(counts(docs, labels)).withColumn("shapley", share).join(F.broadcast(steps), ["applied", "filter"])  # 600 rows, whatever the input
    return d.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
