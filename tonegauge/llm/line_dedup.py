"""Line dedup by winnowing.

Lines (between line feeds, white space at both ends off, blank ones left out) are
hashed; in every run of ``least`` lines the least ``gram``-line hash is selected,
so any run of that length has a fingerprint it shares with its copies. Around
positions of equal fingerprints runs are extended both ways to ``least`` lines, equal
ones meet, overlapping ones join, and all but the first occurrence are deleted (see
``_repeats`` for how runs meet, the order of occurrences and skew).

Runs of fewer lines are too many to take part for their length alone. With
``words``, those that hold so many words do, each length on its own, and so do
whole texts of fewer than ``least`` lines, which only equal whole texts: single
lines that are short stay where they stand among others.

Defined results: null and empty texts have no lines and stay; equal texts repeat
whole (without ``words``, those of ``least`` lines and more); a document of which no line is left has the empty text (``clean`` drops
it); rows that repeat a doc_id with its text count as that document, of a doc_id
with several texts each is a document of its own; a null doc_id takes no part; an empty table gives an empty table; further columns are kept by ``clean``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from ._common import id_text, pieces, record_batch, tidy
from ._repeats import by_doc_id, islands, merged, repeats, with_spans
from ._text import U64, mix
from .suffix_dedup import rewritten

#: A run of at least so many lines is deleted where it repeats; lines of a fingerprint.
LEAST, GRAM = 3, 2
#: A shorter run is deleted where it repeats if it holds so many words.
WORDS = 50
_BLANKS = b" \t\r\x0b\x0c"


def lines(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, number of the text, and the number of the line in its text (twice) of every line that isn't blank."""
    hashes, owner, number = [], [], []
    digest = xxhash.xxh3_64_intdigest
    for i, text in enumerate(texts):
        for j, line in enumerate(text.split(b"\n")):
            if line := line.strip(_BLANKS):
                hashes.append(digest(line))
                owner.append(i)
                number.append(j)
    number = np.array(number, np.int64)
    return np.array(hashes, np.uint64), np.array(owner, np.int64), number, number


def cut(text: bytes, spans: list[dict]) -> bytes:
    """The text without these lines."""
    rows = text.split(b"\n")
    solid = [j for j, line in enumerate(rows) if line.strip(_BLANKS)]
    dead = {solid[u] for s in spans for u in range(s["start"], s["stop"])}
    return b"\n".join(line for j, line in enumerate(rows) if j not in dead)


#: known: +1 later than an equal run of this slice (key: of its place), 0 a run to compare, -1 one that is known to be repeated.
_SHORT = pa.schema([("known", pa.int32()), ("key", pa.int64()), ("more", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("size", pa.int32())])


def _short_runs(text: bytes, least: int, words: int) -> Iterator[tuple[int, int, int]]:
    """128-bit hash, start and size of the text's runs of fewer lines that hold enough words, and of a short text as a whole."""
    solid = [bare for line in text.split(b"\n") if (bare := line.strip(_BLANKS))]
    counts = [len(line.split()) for line in solid]
    for size in range(1, min(least - 1, len(solid)) + 1):
        for start in range(len(solid) - size + 1):
            if sum(counts[start : start + size]) >= words:
                yield xxhash.xxh3_128_intdigest(b"\n".join(solid[start : start + size])), start, size
    if 0 < len(solid) < least and sum(counts) < words:
        yield xxhash.xxh3_128_intdigest(b"\n".join(solid), seed=1), 0, len(solid)  # whole texts equal no part of another


def _short_rows(least: int, words: int):
    """Short runs; those that are later than an equal run of this slice are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, _, texts in pieces(batch.column(1).cast(pa.binary())):
                found = [(key, i, start, size) for i, text in enumerate(texts, a) for key, start, size in _short_runs(text, least, words)]
                if not found:
                    continue
                keys, at, starts, sizes = zip(*found, strict=True)
                key, more, doc = np.array([k & 0xFFFFFFFFFFFFFFFF for k in keys], np.uint64), np.array([k >> 64 for k in keys], np.uint64), ids[np.array(at)]
                start, size = np.array(starts, np.int64), np.array(sizes, np.int64)
                order = np.lexsort((start, doc, more, key))
                key, more, doc, start, size = key[order], more[order], doc[order], start[order], size[order]
                head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (more[1:] != more[:-1])]))
                group = np.repeat(head, np.diff(np.concatenate([head, [len(key)]])))
                later = (doc != doc[group]) | (start >= start[group] + size)
                many = np.bincount(group, minlength=len(key))[group] > 1
                out = ~later
                yield record_batch(_SHORT, [-many[out].astype(np.int32), key[out].view(np.int64), more[out].view(np.int64), doc[out], start[out].astype(np.int32), size[out].astype(np.int32)])
                d, s, e = islands(doc[later], start[later], start[later] + size[later])
                place = mix(mix(d.astype(np.int64).view(U64)) + s.astype(U64)).view(np.int64)
                yield record_batch(_SHORT, [np.ones(len(d), np.int32), place, np.zeros(len(d), np.int64), d, s.astype(np.int32), (e - s).astype(np.int32)])

    return run


def _short_repeats(docs: DataFrame, least: int, words: int) -> DataFrame:
    """doc_id, start, stop, is_first of short runs that occur more than once; spans may overlap."""
    runs = docs.mapInArrow(tidy(_short_rows(least, words)), "known int, key long, more long, doc_id long, start int, size int")
    over = "OVER (PARTITION BY key, more, known > 0)"
    judged = runs.selectExpr("*", f"count(*) {over} AS members", f"min(known) {over} AS least", f"min(struct(doc_id, start)) {over} AS first").where("known > 0 OR least < 0 OR members > 1")
    is_first = "known <= 0 AND doc_id = first.doc_id AND start < first.start + size AS is_first"
    return judged.selectExpr("doc_id", "cast(start AS long) AS start", "cast(start + size AS long) AS stop", is_first)


def _runs(docs: DataFrame, least: int, gram: int, words: int | None) -> DataFrame:
    long = repeats(docs, lines, least, gram)
    return long if words is None else merged(long.unionByName(_short_repeats(docs, least, words)))


def repeated_runs(docs: DataFrame, least: int = LEAST, gram: int = GRAM, words: int | None = None) -> DataFrame:
    """doc_id, start, stop (numbers of lines that aren't blank), is_first. words: of shorter runs that count as well."""
    return by_doc_id(docs, lambda d: _runs(d, least, gram, words))


def clean(docs: DataFrame, least: int = LEAST, gram: int = GRAM, words: int | None = WORDS) -> DataFrame:
    """docs without later repeated runs; documents of which nothing is left go."""
    return rewritten(docs, lambda d: _runs(d, least, gram, words), cut)


_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("deleted_lines", pa.int64()), ("kept_chars", pa.int64()), ("kept_sha256", pa.string())])


def digests(docs: DataFrame, least: int = LEAST, gram: int = GRAM, words: int | None = None) -> DataFrame:
    """doc_id, n_lines (blank ones not), deleted_lines, kept_chars, kept_sha256 of the text that is left, of every row."""
    joined = with_spans(id_text(docs), lambda d: _runs(d, least, gram, words), "doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                n = sum(1 for line in raw.split(b"\n") if line.strip(_BLANKS))
                if spans:
                    raw = cut(raw, spans)
                rows.append((doc, n, sum(s["stop"] - s["start"] for s in spans or ()), len(raw.decode()), hashlib.sha256(raw).hexdigest()))
            if rows:
                yield record_batch(_DIGESTS, [list(c) for c in zip(*rows, strict=True)])

    return joined.mapInArrow(tidy(run), "doc_id long, n_lines long, deleted_lines long, kept_chars long, kept_sha256 string")
