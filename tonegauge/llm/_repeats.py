"""Runs of units (words or lines) that occur more than once in a corpus, found by content-selected anchors.

Every run of ``least`` units holds ``least - gram + 1`` grams; the leftmost least
gram hash among them is its anchor, so equal runs have the same anchor at the same
offset. Two steps:

1. anchors of all texts are compared and those whose gram occurs once are
   dropped, with everything they stand for;
2. around each anchor that is left, text is taken left and right up to the length
   asked for: the runs that the anchor is the anchor of. Equal runs meet by a hash of
   96 bits, one row a run; what is equal is a repeat, and overlapping repeats join
   into longer ones, as far as they go both ways.

Runs meet by hash rather than as neighbours in sorted order: of suffixes that share
a gram, those with the longest common right side stand together whatever is left of
them, so neighbours alone miss runs that reach to the left of the gram; and all
suffixes of a frequent gram would have to stand in one task, where their runs are
spread over as many as there are different ones.

Skew: within a slice of a partition equal grams (or runs) send one row for all of
them, since the others are already known to be repeated, so a passage in a third
of all documents is as many rows as there are slices.

A repeat's first occurrence (least doc_id, then position) is kept; any other is
``later``, unless it overlaps the first within one text (as in a text of one word
said over and over), which belongs to the first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import id_text, pieces, record_batch, stored, tidy, unused
from ._text import U64, grams, mix

#: (hash, number of the text, first byte, byte after the last) of every unit of some texts.
Units = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def runs_of(hashes: np.ndarray, owner: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where runs begin, the anchor of each, and all gram hashes."""
    g = grams(hashes, gram)
    n = len(hashes) - least + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), g
    anchors = np.arange(n) + sliding_window_view(g, least - gram + 1).argmin(axis=1)
    starts = np.flatnonzero(owner[:n] == owner[least - 1 :])
    return starts, anchors[starts], g


def _first_units(owner: np.ndarray, n_texts: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n_texts))])


_ANCHORS = pa.schema([("known", pa.bool_()), ("key", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int64())])


def _anchor_rows(units: Units, least: int, gram: int):
    """Anchors: not known to be repeated (key: the gram), or known, of which one per gram also goes out as a
    witness without a place (doc_id null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, texts in pieces(batch.column(1).cast(pa.binary())):
                h, owner, _, _ = units(texts)
                _, anchors, g = runs_of(h, owner, least, gram)
                anchors = np.unique(anchors)
                if not len(anchors):
                    continue
                key, index, counts = np.unique(g[anchors], return_inverse=True, return_counts=True)
                many = counts[index] > 1
                doc = ids[a:b][owner[anchors]]
                pos = anchors - _first_units(owner, b - a)[owner[anchors]]
                witness = key[counts > 1].view(np.int64)
                nothing = pa.nulls(len(witness), pa.int64())
                yield record_batch(_ANCHORS, [many, g[anchors].view(np.int64), doc, pos])
                yield record_batch(_ANCHORS, [np.zeros(len(witness), bool), witness, nothing, nothing])

    return run


#: size: units of a stretch known to be later (key: of its place); 0: a run to compare; -1: one that is known to be repeated.
_RUNS = pa.schema([("key", pa.int64()), ("more", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int32()), ("size", pa.int32())])


def more_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """32 bits beside a key's 64, of the same two hashes."""
    return (mix(a ^ mix(b ^ U64(0xC2B2AE3D27D4EB4F))) >> U64(32)).astype(np.uint32).view(np.int32)


def _run_rows(units: Units, least: int, gram: int):
    """Runs around repeated anchors; those that are later than an equal run of this slice are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            for a, b, texts in pieces(batch.column(1).cast(pa.binary())):
                h, owner, _, _ = units(texts)
                starts, anchors, g = runs_of(h, owner, least, gram)
                first = _first_units(owner, b - a)
                part = places.slice(a, b - a)
                n_places = np.diff(part.offsets.to_numpy())
                wanted = np.zeros(len(h) + 1, bool)
                wanted[part.flatten().to_numpy() + np.repeat(first[:-1], n_places)] = True
                starts = starts[wanted[anchors]]
                if not len(starts):
                    continue
                left, right = g[starts], g[starts + least - gram]
                key, more = mix(left * U64(3) + right), more_bits(left, right)
                doc, pos = ids[a:b][owner[starts]], starts - first[owner[starts]]
                order = np.lexsort((pos, doc, more, key))
                key, more, doc, pos = key[order], more[order], doc[order], pos[order]
                head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (more[1:] != more[:-1])]))
                group = np.repeat(head, np.diff(np.concatenate([head, [len(key)]])))
                later = (doc != doc[group]) | (pos >= pos[group] + least)
                many = np.bincount(group, minlength=len(key))[group] > 1
                out = ~later
                yield record_batch(_RUNS, [key[out].view(np.int64), more[out], doc[out], pos[out].astype(np.int32), -many[out].astype(np.int32)])
                d, s, e = islands(doc[later], pos[later], pos[later] + least)
                place = mix(mix(d.astype(np.int64).view(U64)) + s.astype(U64)).view(np.int64)
                yield record_batch(_RUNS, [place, np.zeros(len(d), np.int32), d, s.astype(np.int32), (e - s).astype(np.int32)])

    return run


def islands(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of each document that touch or overlap become one."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    number = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    wide = int(stop.max()) + 1
    reach = np.maximum.accumulate(stop + number * wide)
    new = np.concatenate([[True], start[1:] + number[1:] * wide > reach[:-1]])
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(doc)]]) - 1
    return doc[at], start[at], reach[last] - number[last] * wide


_SPANS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("is_first", pa.bool_())])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (doc_id, is_first, start): intervals joined; the last one of a batch waits for the next."""
    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, start, stop, first = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if kept is not None:
            doc, start, stop, first = (np.concatenate([[k], c]) for k, c in zip(kept, (doc, start, stop, first), strict=True))
        first = first.astype(bool)
        number = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | (first[1:] != first[:-1])]))
        wide = int(stop.max()) + 1
        reach = np.maximum.accumulate(stop + number * wide)
        at = np.flatnonzero(np.concatenate([[True], start[1:] + number[1:] * wide > reach[:-1]]))
        last = np.concatenate([at[1:], [len(doc)]]) - 1
        ends = reach[last] - number[last] * wide
        out = [doc[at], start[at], ends, first[at]]
        kept = [c[-1] for c in out]
        yield record_batch(_SPANS, [c[:-1] for c in out])
    if kept is not None:
        yield record_batch(_SPANS, [[k] for k in kept])


def merged(spans: DataFrame) -> DataFrame:
    """Spans (doc_id, start, stop, is_first) of a document that touch or overlap become one."""
    return spans.repartition("doc_id").sortWithinPartitions("doc_id", "is_first", "start").selectExpr("doc_id", "cast(start AS long) AS start", "cast(stop AS long) AS stop", "is_first").mapInArrow(tidy(_merge), "doc_id long, start long, stop long, is_first boolean")


def repeats(docs: DataFrame, units: Units, least: int, gram: int) -> DataFrame:
    """doc_id, start, stop (units), is_first of every maximal stretch of runs that occur more than once.

    docs: doc_id (not null), text (not null).
    """
    if 2 * gram < least:
        raise ValueError("two grams must cover a run")
    found = docs.mapInArrow(tidy(_anchor_rows(units, least, gram)), "known boolean, key long, doc_id long, pos long")
    # what is known needs no comparison: dealt out by its document, where it is needed next
    dealt = found.withColumn("deal", F.when(F.col("known"), F.xxhash64("doc_id")).otherwise(F.col("key")))
    repeated = dealt.selectExpr("known", "doc_id", "pos", "if(known, 2, count(*) OVER (PARTITION BY deal, known, if(known, doc_id, key))) AS members").where("members > 1 AND doc_id IS NOT NULL")
    places = repeated.groupBy("doc_id").agg(F.collect_set("pos").alias("places"))
    marked = docs.join(places, "doc_id").select("doc_id", "text", "places")
    runs = marked.mapInArrow(tidy(_run_rows(units, least, gram)), "key long, more int, doc_id long, start int, size int")
    over = "OVER (PARTITION BY key, more, size > 0)"
    judged = runs.selectExpr(
        "doc_id", "start", "size", f"count(*) {over} AS members", f"min(size) {over} AS least", f"min(struct(doc_id, start)) {over} AS first"
    ).where("size > 0 OR least < 0 OR members > 1")
    spans = judged.selectExpr(
        "doc_id", "start", f"if(size > 0, start + size, start + {least}) AS stop", f"size <= 0 AND doc_id = first.doc_id AND start < first.start + {least} AS is_first"
    )
    return merged(spans)


def identified(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs (doc_id, text) in which a doc_id has one text, and None; where one has several, each text gets an id of
    its own, in order of doc_id and the text's hash, and the second is their table (at, doc_id, hash)."""
    hashed = docs.select("doc_id", F.xxhash64("text").alias("hash"))
    if hashed.groupBy("doc_id").agg(F.min("hash").alias("a"), F.max("hash").alias("b")).where("a <> b").isEmpty():
        return docs, None
    # sorted ranges, so numbers by partition and place are in order; a doc_id of many texts may lie in several
    ids = stored(hashed.distinct().repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash").withColumn("at", F.monotonically_increasing_id()))
    return docs.withColumn("hash", F.xxhash64("text")).join(ids, ["doc_id", "hash"]).select(F.col("at").alias("doc_id"), "text"), ids


#: doc_id, start, stop, is_first of doc_id, text.
Find = Callable[[DataFrame], DataFrame]


def by_doc_id(docs: DataFrame, find: Find) -> DataFrame:
    """What is found, under the documents' own ids."""
    own, ids = identified(id_text(docs).where("doc_id IS NOT NULL"))
    found = find(own)
    return found if ids is None else found.withColumnRenamed("doc_id", "at").join(ids, "at").select("doc_id", "start", "stop", "is_first")


def with_spans(docs: DataFrame, find: Find, id_col: str, text_col: str, name: str) -> DataFrame:
    """docs with a column of what to delete from each row's text (null: nothing)."""
    own, ids = identified(id_text(docs, id_col, text_col).where("doc_id IS NOT NULL"))
    at, digest = unused(docs, "_id"), unused(docs, "_hash")
    spans = later_spans(find(own))
    same = F.col(id_col).cast("long") == F.col(at)
    if ids is None:
        found = spans.select(F.col("doc_id").alias(at), F.col("spans").alias(name))
    else:
        found = spans.withColumnRenamed("doc_id", "at").join(ids, "at").select(F.col("doc_id").alias(at), F.col("hash").alias(digest), F.col("spans").alias(name))
        same = same & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(digest))
    return docs.join(found, same, "left").select(*docs.columns, name)


def later_spans(spans: DataFrame) -> DataFrame:
    """doc_id, spans: array<struct<start, stop>> of what to delete."""
    return spans.where("NOT is_first").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
