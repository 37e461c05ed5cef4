"""Repeated passages by a sparse suffix array.

Suffixes of the word sequence are retained at minimiser positions only (the least
25-gram hash of every 50-word window), about one word in 13. Those that share
their gram are extended left and right to 50 words; equal extensions meet by a hash
of 96 bits (not as neighbours in sorted order, see ``_repeats`` for why), which makes
them repeated passages, and overlapping ones join. Every passage of at least ``least`` words that occurs twice is found, and
nothing shorter (words ``[^\\x20\\x09-\\x0D]+``, A-Z as a-z; see ``_repeats`` for
the order of occurrences and for skew).

Defined results: null and empty texts, and texts of fewer words, have no
passages; equal texts repeat whole, the least doc_id's is the first; rows that
repeat a doc_id with its text count as that document; of a doc_id with several texts
each is a document of its own, in order of the texts' hashes; a null doc_id takes no part
(its row is never changed); an empty table gives no rows; further columns are
ignored by ``passages`` and kept by ``without_repeats``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import tidy, unused
from ._repeats import by_doc_id, repeats, with_spans
from ._text import words

LEAST, GRAM = 50, 25
_words = partial(words, lower=True)


def passages(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """doc_id, start, stop (word numbers), is_first."""
    return by_doc_id(docs, lambda d: repeats(d, _words, least, gram))


def cut(text: bytes, spans: list[dict]) -> bytes:
    """The text without these words and the white space that follows them."""
    _, _, starts, _ = words([text], lower=False)
    out, at = [], 0
    for s in spans:
        out.append(text[at : int(starts[s["start"]])])
        at = int(starts[s["stop"]]) if s["stop"] < len(starts) else len(text)
    out.append(text[at:])
    return b"".join(out)


def without_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """docs with later occurrences cut out of text (n_chars follows, if there is one); documents of which
    nothing is left go."""
    return rewritten(docs, lambda d: repeats(d, _words, least, gram), cut)


def rewritten(docs: DataFrame, find: Callable[[DataFrame], DataFrame], cutter: Callable[[bytes, list], bytes]) -> DataFrame:
    """docs with cutter(text, spans) as text where find (doc_id, start, stop, is_first of doc_id, text) has later spans."""
    names = docs.columns
    joined = with_spans(docs, find, "doc_id", "text", unused(docs, "cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old, spans = batch.column(names.index("text")).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            new = [t if s is None else cutter(t.encode(), s).decode() for t, s in zip(old, spans, strict=True)]
            keep = [s is None or bool(t.strip()) for t, s in zip(new, spans, strict=True)]
            columns = []
            for i, name in enumerate(names):
                field = batch.schema.field(i)
                if name == "text":
                    columns.append(pa.array(new, field.type))
                elif name == "n_chars":
                    columns.append(pa.array([o if s is None else len(t) for o, t, s in zip(batch.column(i).to_pylist(), new, spans, strict=True)], field.type))
                else:
                    columns.append(batch.column(i))
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([batch.schema.field(i) for i in range(len(names))])).filter(pa.array(keep))

    return joined.mapInArrow(tidy(run), docs.schema)
