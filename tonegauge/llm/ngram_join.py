"""Similarity join of documents by the Jaccard coefficient of word n-gram sets.

Vertical partitioning. One global order of n-grams (rising frequency rank, then
hash) is cut into fragments of about equal weight; a document's set falls into one
segment per fragment. A pair's overlap is counted fragment by fragment, each count
on its own, and summed per pair. Frequencies, which only order the n-grams, come
from a count-min sketch over all documents, whose size is a parameter and not the
data's.

Which pairs are counted: in the global order, two sets that are similar enough
share one of their first |x| - ceil(t |x|) + 1 n-grams, so an index of these
prefixes (the rare end of the order) names every possible partner.

1. Equal sets (copies) are one class; of its documents one stands in the index.
2. N-grams with the same documents name the same pairs: one of them stays. That,
   like every count by n-gram, is a partial aggregate, so a frequent n-gram is a
   row per task. A document that sizes or sketches dismiss against all others of an
   n-gram of few documents leaves it.
3. Each document meets two leaders of each entry that it stands in, never all of
   the entry; components of the links found are formed.
4. What an entry names and step 3 left in different components meets in a pair's
   first common entry only, and only if parity sketches, which two sets can't
   differ in by more bits than in elements, let it: both tests are exact, so no
   link is lost and hardly a pair that isn't one is counted.

Every pair of different texts that the index names is thus either counted,
dismissed by its sketches or already in one component, so components are exact.
``class_links`` and ``link_counts`` take no such way round: they hold all pairs of
an entry against their sketches, so links are exact too.

Defined results: a null text, and a text without words, has the empty set, links
with nothing and is its own component; a text with fewer words than an n-gram has
its whole sequence as its only n-gram; repeated rows and equal texts are one
component; an empty table gives an empty table; further columns are ignored. Rows
with a null doc_id have no result row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import compact, id_text, materialize, pieces, record_batch, stored, tidy
from ._graph import components
from ._text import U64, mix, shingle_sets

#: Counters of the sketch (4 bytes each), and how many travel in a row.
SKETCH, SKETCH_ROW = 1 << 22, 1 << 16
#: Fragments that the n-gram order is cut into.
FRAGMENTS = 4
#: Rows of ids (16 bytes each) and of n-grams (8 bytes) up to which they are broadcast; beyond, the join shuffles.
BROADCAST_IDS, BROADCAST_KEYS = 200_000, 1_000_000
#: Documents of an n-gram up to which each is held against the others before it becomes an entry; of more, all become entries.
FEW = 16
#: Earlier entries that a document brings along into an entry, to see whether a pair has met: more spare repetitions, none is needed.
EARLIER = 16


def _long(x: np.ndarray) -> np.ndarray:
    return x.astype(U64).view(np.int64)


def _sketch_rows(k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.uint32)
        for batch in batches:
            for _, _, texts in pieces(batch.column(0).cast(pa.binary())):
                hashes, _ = shingle_sets(texts, k)
                at, times = np.unique((hashes & U64(width - 1)).astype(np.uint32), return_counts=True)
                total[at] += times.astype(np.uint32)
        schema = pa.schema([("row", pa.int32()), ("counts", pa.binary())])
        rows = [(i // SKETCH_ROW, _squeeze(total[i : i + SKETCH_ROW])) for i in range(0, width, SKETCH_ROW) if total[i : i + SKETCH_ROW].any()]
        yield record_batch(schema, [[r[0] for r in rows], [r[1] for r in rows]])

    return run


def _squeeze(counts: np.ndarray) -> bytes:
    """Compressed: counters as bytes where they fit, else as 4 bytes."""
    small = counts.max() < 256
    return (b"b" if small else b"w") + zlib.compress(counts.astype("u1" if small else "<u4").tobytes(), 1)


def _unsqueeze(data: bytes, out: np.ndarray) -> None:
    out += np.frombuffer(zlib.decompress(data[1:]), "u1" if data[:1] == b"b" else "<u4")


def _add_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for row, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            _unsqueeze(data, sums.setdefault(row, np.zeros(SKETCH_ROW, np.uint64)))
    schema = pa.schema([("row", pa.int32()), ("counts", pa.binary())])
    yield record_batch(schema, [list(sums), [np.minimum(s, 0xFFFFFFFF).astype("<u4").tobytes() for s in sums.values()]])


class Order(NamedTuple):
    """The global order: a rank (0 to 255) for each counter of the sketch, and where it is cut into fragments."""

    ranks: np.ndarray
    cuts: list[tuple[int, int]]

    def fragment(self, hashes: np.ndarray) -> np.ndarray:
        rank = self.rank(hashes)
        out = np.zeros(len(hashes), np.int32)
        for r, h in self.cuts:
            out += (rank > r) | ((rank == r) & (hashes >= U64(h)))
        return out

    def rank(self, hashes: np.ndarray) -> np.ndarray:
        return self.ranks[(hashes & U64(len(self.ranks) - 1)).view(np.int64)]


def global_order(texts: DataFrame, k: int, fragments: int = FRAGMENTS, width: int = SKETCH) -> Order:
    """Ranks are in proportion up to twice the usual fill, so that what a few documents share already stands
    behind what one has, and logarithmic beyond. The driver gets 4 bytes a counter."""
    parts = texts.mapInArrow(tidy(_sketch_rows(k, width)), "row int, counts binary")
    summed = parts.repartition("row").mapInArrow(tidy(_add_sketch), "row int, counts binary").collect()
    total = np.zeros(width, np.float32)
    for row, counts in summed:
        part = np.frombuffer(counts, "<u4")
        total[row * SKETCH_ROW : row * SKETCH_ROW + len(part)] = part
    used = total[total > 0]
    usual = max(1.0, float(np.median(used))) if len(used) else 1.0
    ranks = np.where(total <= 2 * usual, total * (96 / usual), 192 + 4 * np.log2(np.maximum(total, 1e-9) / (2 * usual)))
    ranks = np.clip(ranks, 0, 255).astype(np.uint8)
    weight = np.concatenate([[0.0], np.cumsum(np.bincount(ranks, total, 256))])
    cuts = []
    for i in range(1, fragments):
        at = weight[-1] * i / fragments
        r = min(255, int(np.searchsorted(weight, at, side="right")) - 1)
        share = (at - weight[r]) / max(weight[r + 1] - weight[r], 1e-9)
        cuts.append((r, min((1 << 64) - 1, int(share * (1 << 64)))))
    return Order(ranks, cuts)


#: Bits of the parity sketch of sets up to 3,000 elements, 12,000 and more. A set's bit is odd if an odd number of its hashes falls on it, so two sets
#: differ in at least as many elements as their sketches do in bits: a bound that dismisses pairs exactly.
PARITY = (1 << 10, 1 << 12, 1 << 14)
_INDEX = pa.schema([(n, pa.int64()) for n in ("row_id", "doc_id", "n", "d0", "d1")] + [("new", pa.bool_())] + [(n, pa.list_(pa.int64())) for n in ("parity", "keys")])
_INDEX_DDL = "row_id long, doc_id long, n long, d0 long, d1 long, new boolean, parity array<long>, keys array<long>"
#: Sets that a task remembers as met; more are written as if they were new.
MET = 500_000


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _index(k: int, sim: Fraction, order):
    """A row for each document: its set's size and 128-bit digest; and, unless the task has met this set before,
    parity sketch and prefix n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, seen, number = order.value, set(), TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, texts in pieces(batch.column(1).cast(pa.binary())):
                hashes, bounds = shingle_sets(texts, k)
                rank = ranks.rank(hashes)
                one = mix(hashes)
                sums = np.concatenate([np.zeros((1, 2), U64), np.cumsum(np.stack([one, mix(one)], 1), axis=0)])
                bit = (one >> U64(20) & U64(PARITY[-1] - 1)).view(np.int64)
                rows = []
                for doc, lo, hi in zip(ids[a:b], bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    n, number = hi - lo, number + 1
                    digest = tuple(map(_signed, (sums[hi] - sums[lo]).tolist()))
                    if n == 0 or digest in seen:
                        rows.append((number, doc, n, *digest, False, None, None))
                        continue
                    if len(seen) < MET:
                        seen.add(digest)
                    width = PARITY[0 if n < 3000 else 1 if n < 12000 else 2]
                    odd = np.packbits((np.bincount(bit[lo:hi] & (width - 1), minlength=width) & 1).astype(bool)).view(np.int64)
                    take = n + (-n * sim.numerator // sim.denominator) + 1
                    part = hashes[lo:hi]
                    if take < n:
                        part = part[np.lexsort((one[lo:hi], rank[lo:hi]))[:take]]
                    rows.append((number, doc, n, *digest, True, odd, _long(part)))
                if rows:
                    yield record_batch(_INDEX, [list(c) for c in zip(*rows, strict=True)])

    return run


def _folded(parity: str, words: str) -> str:
    """SQL of a sketch whose parts are laid onto each other: it has fewer bits and keeps the bound."""
    return f"transform(sequence(0, {words} - 1), i -> aggregate(sequence(i, size({parity}) - 1, {words}), 0L, (s, j) -> s ^ {parity}[j]))"


_SEGMENTS = pa.schema([("doc_id", pa.int64()), ("fragment", pa.int32()), ("segment", pa.binary())])


def _segments(k: int, order):
    """A document's n-grams, a row for each fragment of the global order: sorted 8-byte numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = order.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, texts in pieces(batch.column(1).cast(pa.binary())):
                hashes, bounds = shingle_sets(texts, k)
                fragment = cut.fragment(hashes)
                rows = []
                for doc, lo, hi in zip(ids[a:b], bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    own, where = hashes[lo:hi], fragment[lo:hi]
                    rows += [(doc, f, own[where == f].tobytes()) for f in np.unique(where).tolist()]
                if rows:
                    yield record_batch(_SEGMENTS, [list(c) for c in zip(*rows, strict=True)])

    return run


_PARTIAL = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("fragment", pa.int32()), ("common", pa.int64())])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlap of two documents in one fragment."""
    for batch in batches:
        common = []
        for x, y in zip(batch.column(3), batch.column(4), strict=True):
            p, q = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
            if len(p) > len(q):
                p, q = q, p
            at = np.searchsorted(q, p)
            at[at == len(q)] = 0
            common.append(int((q[at] == p).sum()))
        yield record_batch(_PARTIAL, [*batch.columns[:3], common])


def count_overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """a, b, common: partial overlaps per fragment, summed per pair. A pair without overlap has no row."""
    left = pairs.join(segments.select(F.col("doc_id").alias("a"), "fragment", F.col("segment").alias("x")), "a")
    both = left.join(segments.select(F.col("doc_id").alias("b"), "fragment", F.col("segment").alias("y")), ["b", "fragment"])
    partial = both.select("a", "b", "fragment", "x", "y").mapInArrow(tidy(_partial), "a long, b long, fragment int, common long")
    each = partial.groupBy("a", "b", "fragment").agg(F.max("common").alias("common"))  # rows may repeat a document
    return each.groupBy("a", "b").agg(F.sum("common").alias("common"))


def _listed(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= most else ids


def _both(x: str, y: str) -> str:
    """The longer of two sketches folded to the shorter's size."""
    return f"if(size({x}) > size({y}), {_folded(x, f'size({y})')}, {x})"


class _Index:
    """Classes of equal sets, entries (a prefix n-gram and a class that has it), and how pairs are dismissed and counted."""

    def __init__(self, docs: DataFrame, k: int, similarity: Fraction, fragments: int):
        self.k, self.similarity = k, similarity
        self.docs = d = id_text(docs).where("doc_id IS NOT NULL")
        self.order = d.sparkSession.sparkContext.broadcast(global_order(d.select("text"), k, fragments))
        raw = stored(d.mapInArrow(tidy(_index(k, similarity, self.order)), _INDEX_DDL))
        self.documents = raw.select("doc_id", "n", "d0", "d1")
        # a class is named by its least document; the carrier is the document whose row has its n-grams
        self.classes = compact(materialize(raw.where("n > 0").groupBy("d0", "d1").agg(F.min("doc_id").alias("rep"), F.min(F.when(F.col("new"), F.col("row_id"))).alias("carrier"))))

        # the same set met by several tasks is indexed once
        again = compact(materialize(raw.where("new").select("row_id").join(self.classes.select(F.col("carrier").alias("row_id")), "row_id", "left_anti")))
        sets = raw.where("new").join(_listed(again), "row_id", "left_anti")
        spots = sets.select("row_id", "n", F.explode("keys").alias("key"))
        shared = spots.groupBy("key").agg(F.count("*").alias("c"), F.min("row_id").alias("lo"), F.expr("bit_xor(xxhash64(row_id))").alias("who"), F.min("n").alias("least"), F.max("n").alias("most"))
        # two that differ too much in size are no pair
        shared = shared.where(f"c > 2 OR c = 2 AND {similarity.numerator} * most <= {similarity.denominator} * least")
        kept = compact(materialize(shared.groupBy("c", "lo", "who", "least", "most").agg(F.min("key").alias("key")).select("key", "c")))
        held = materialize(spots.join(_listed(kept, BROADCAST_KEYS), "key").select("key", "c", "row_id", "n"))
        named = held.where(f"c > {FEW}").select("key", "row_id").union(self._alike(held.where(f"c <= {FEW}"), sets))
        mine = named.groupBy("row_id").agg(F.array_sort(F.collect_set("key")).alias("own"))
        heads = sets.select("row_id", "n", "parity").join(self.classes.select(F.col("carrier").alias("row_id"), F.col("rep").alias("id")), "row_id").join(mine, "row_id")
        before = f"slice(own, 1, least(at, {EARLIER}))"
        self.entries = materialize(heads.select("id", "n", "parity", "own", F.posexplode("own").alias("at", "key")).selectExpr("key", "id", "n", "parity", f"{before} AS before"))

    def _alike(self, held: DataFrame, sets: DataFrame) -> DataFrame:
        """key, row_id of documents that have a possible partner among the few of an n-gram: by sizes, then by sketches.
        Most meet by chance, the more so the larger the corpus, and go before anything wide is sent for them."""

        def partnered(rows: DataFrame, columns: list[str], near: str) -> DataFrame:
            own = rows.groupBy("key").agg(F.collect_list(F.struct("row_id", *columns)).alias("own"))
            left = own.select("key", F.expr(f"filter(own, x -> exists(own, y -> x.row_id <> y.row_id AND {near}))").alias("own"))
            return left.select("key", F.explode("own.row_id").alias("row_id"))

        sized = compact(materialize(partnered(held, ["n"], self.near_size("x", "y"))))
        wide = sets.select("row_id", "n", "parity").join(_listed(sized, BROADCAST_IDS), "row_id")
        return partnered(wide, ["n", "parity"], self.near("x", "y"))

    def near_size(self, x: str, y: str) -> str:
        return f"{self.similarity.numerator} * greatest({x}.n, {y}.n) <= {self.similarity.denominator} * least({x}.n, {y}.n)"

    def near(self, x: str, y: str) -> str:
        """Sizes and sketches don't rule the pair out: similar sets differ in (1 - t) / (1 + t) of the sum of their sizes at most."""
        num, den = self.similarity.numerator, self.similarity.denominator
        apart = f"aggregate(zip_with({_both(f'{x}.parity', f'{y}.parity')}, {_both(f'{y}.parity', f'{x}.parity')}, (p, q) -> bit_count(p ^ q)), 0, (s, c) -> s + c)"
        return f"{self.near_size(x, y)} AND {apart} * {num + den} <= ({x}.n + {y}.n) * {den - num}"

    def links_of(self, pairs: DataFrame) -> DataFrame:
        """a, b of those pairs (x, nx, y, ny) that are similar: the texts of their documents are read again."""
        num, den = self.similarity.numerator, self.similarity.denominator
        asked = compact(materialize(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("nx") + F.col("ny")).alias("total")).distinct()))
        ids = _listed(compact(materialize(asked.select(F.col("a").alias("doc_id")).union(asked.select("b")).distinct())))
        segments = self.docs.join(ids, "doc_id", "left_semi").mapInArrow(tidy(_segments(self.k, self.order)), "doc_id long, fragment int, segment binary")
        counted = count_overlaps(asked.select("a", "b"), segments)
        return compact(materialize(asked.join(counted, ["a", "b"]).where(f"{den} * common >= {num} * (total - common)").select("a", "b")))

    def first_links(self) -> DataFrame:
        """Links of documents with two leaders of each entry: one that is the same for many entries, one that is the entry's own."""
        who = F.struct("id", "n", "parity")
        leaders = self.entries.groupBy("key").agg(F.min_by(who, F.xxhash64("id")).alias("p"), F.min_by(who, F.xxhash64("id", "key")).alias("q"))
        leaders = materialize(leaders.select("key", F.explode(F.array_distinct(F.array("p", "q"))).alias("l")).select("key", "l.*"))
        met = self.entries.drop("before").alias("x").join(leaders.alias("y"), F.expr(f"x.key = y.key AND x.id <> y.id AND {self.near('x', 'y')}"))
        return self.links_of(met.selectExpr("x.id AS x", "x.n AS nx", "y.id AS y", "y.n AS ny"))

    def links_within(self, entries: DataFrame, name: str) -> DataFrame:
        """Links of documents that share an entry and differ in a column ``name``."""
        new = f"x.{name} < y.{name} AND NOT arrays_overlap(x.before, y.before)"
        met = entries.alias("x").join(entries.alias("y"), F.expr(f"x.key = y.key AND {new} AND {self.near('x', 'y')}"))
        return self.links_of(met.selectExpr("x.id AS x", "x.n AS nx", "y.id AS y", "y.n AS ny"))

    def of_documents(self, classes: DataFrame, columns: list[str]) -> DataFrame:
        """doc_id, n_shingles and columns of the documents' classes (null for the empty set)."""
        return self.documents.join(classes.select("d0", "d1", F.lit(1).alias("some"), *columns), ["d0", "d1"], "left").select("doc_id", F.col("n").alias("n_shingles"), *[F.when(F.col("n") > 0, F.col(c)).alias(c) for c in columns])


def jaccard_components(docs: DataFrame, k: int = 5, similarity: Fraction = Fraction(4, 5), fragments: int = FRAGMENTS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    index = _Index(docs, k, similarity, fragments)
    near = compact(materialize(components(index.first_links())))
    known = index.entries.join(_listed(near), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    known = materialize(known)
    open_ = materialize(known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"))
    rest = index.links_within(known.join(_listed(open_), "key", "left_semi"), "comp")
    # links of components: what they join takes the least name
    name = lambda end: near.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
    over = rest.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = compact(materialize(components(over)))
    classes = index.classes.join(near.withColumnRenamed("id", "rep"), "rep", "left").withColumn("id", F.coalesce("component", "rep")).drop("component").join(joined, "id", "left")
    classes = materialize(classes.select("d0", "d1", F.coalesce("component", "id").alias("component")))
    found = index.of_documents(classes, ["component"])
    return found.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def class_links(docs: DataFrame, k: int = 5, similarity: Fraction = Fraction(4, 5), fragments: int = FRAGMENTS) -> tuple[DataFrame, DataFrame]:
    """All links: (a, b), a < b, of classes of equal sets, and (doc_id, n, rep), each document's class.

    Every pair that the index names is held against its sketches, whatever links are known already, so a group of near
    copies is as many pairs as it has; documents of one class are linked by being in it. The empty set has no class of others.
    """
    index = _Index(docs, k, similarity, fragments)
    links = index.links_within(index.entries, "id")
    found = index.of_documents(index.classes, ["rep"])
    return links, found.select("doc_id", F.col("n_shingles").alias("n"), F.coalesce("rep", "doc_id").alias("rep")).distinct()


def link_counts(docs: DataFrame, k: int = 5, similarity: Fraction = Fraction(4, 5), fragments: int = FRAGMENTS) -> DataFrame:
    """doc_id, n_shingles, n_links (other documents whose sets are alike enough, copies too)."""
    links, members = class_links(docs, k, similarity, fragments)
    sizes = materialize(members.groupBy("rep").agg(F.count("*").alias("size")))
    each = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(sizes.toDF("b", "size"), "b")
    met = each.groupBy("a").agg(F.sum("size").alias("met")).withColumnRenamed("a", "rep")
    totals = sizes.join(met, "rep", "left").select("rep", (F.col("size") - 1 + F.coalesce("met", F.lit(0))).alias("n_links"))
    return members.join(totals, "rep").select("doc_id", F.col("n").alias("n_shingles"), "n_links")


def one_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component (rows with a null doc_id stay)."""
    gone = jaccard_components(docs, **parameters).where("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
