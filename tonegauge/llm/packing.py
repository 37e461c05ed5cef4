"""Harmonic packing of tokenised documents into sequences.

A piece of length L belongs to class k = capacity // L and a bin of class k takes
exactly k pieces, so a bin never overflows whatever pieces of the class come, and
each worker fills its own bins without asking any other. A document is first cut
into whole sequences; its rest becomes one piece if its class wastes little, else
a piece of exactly capacity // (k + 1) tokens goes to the class above and the
remainder is looked at again. Bins that are still open when a worker ends hold
fewer than the sum of k pieces, a bound that doesn't depend on the input: they are
laid end to end and cut at the capacity, what is left over at powers of two, so
they need no padding.

Every partition of the input is packed where it is read: no shuffle, and a lost
task repeats its own partition only, with the same ids (partition number and a
counter).

Defined results: a null or empty text is the end token alone; repeated rows are
packed once each; a document longer than a sequence is cut; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._common import id_text, no_cycles, pieces, record_batch, tidy

CAPACITY = 4096
#: Share of a bin that a class may waste before a piece is cut instead.
WASTE = 0.02
#: Pre-tokens in each of the two generations a worker remembers.
MEMO = 400_000
PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
PIECES_DDL = ", ".join(f"{n} long" for n in PIECES.names)
# The tokenizer's white space; its letters and numbers up to U+00FF; its contractions, by either case.
_SPACE = " \\t-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LETTER = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
_NUMBER = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
_SHORT = "'(?:[sStTmMdD]|[rR][eE]|[vV][eE]|[lL][lL])"
_PRE_TOKEN = f"{_SHORT}|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+"
_NARROW = re.compile(_PRE_TOKEN)
#: For texts that aren't of these characters alone: a word that holds another one, or what may be a special token, is left to the library.
_ANY = re.compile(f"[^{_SPACE}]*(?:[^\\x00-\\xff{_SPACE}]|<\\|)[^{_SPACE}]*|{_PRE_TOKEN}")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet's letter for each byte: printable Latin-1 stands for itself, the others are numbered from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def packed_ids(ids: list[int]) -> bytes:
    """As little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class WordTokenizer:
    """Ids of whole texts from a tokenizers file that lower-cases, drops white space and merges within pre-tokens:
    each pre-token goes through the library's model once while it is remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, token: str) -> bytes:
        if token.isascii() and token.isalpha():
            found = self.model.tokenize(token.lower())
        else:
            try:
                data = token.encode("latin-1").decode("latin-1").lower()
            except UnicodeEncodeError:
                return packed_ids(self.tokenizer.encode(token, add_special_tokens=False).ids)
            if "<|" in data:
                return packed_ids(self.tokenizer.encode(token, add_special_tokens=False).ids)
            found = self.model.tokenize(data.encode().decode("latin-1").translate(self.letters))
        return packed_ids([t.id for t in found])

    def _learn(self, new: set[str]) -> None:
        """Remember the ids of pre-tokens that aren't in memory."""
        memo, older, ids = self.memo, self.older, self._ids
        for token in new:
            memo[token] = older[token] if token in older else ids(token)

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = []
        for text in texts:
            try:
                text.encode("latin-1")
                narrow = "<|" not in text
            except UnicodeEncodeError:
                narrow = False
            split.append(_NARROW.findall(text.lower()) if narrow else _ANY.findall(text))
        tokens = set(chain.from_iterable(split))
        missing = tokens - self.memo.keys()
        if len(self.memo) + len(missing) > MEMO:
            self.memo, self.older = {}, self.memo
            missing = tokens
        if missing:
            self._learn(missing)
        ids = self.memo.__getitem__
        return [b"".join(map(ids, x)) for x in split]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def harmonic_cuts(length: int, capacity: int = CAPACITY, waste: float = WASTE) -> list[int]:
    """Piece lengths of one document."""
    cuts, rest = [capacity] * (length // capacity), length % capacity
    while rest:
        k = capacity // rest
        if k * rest >= (1 - waste) * capacity:
            cuts.append(rest)
            break
        cuts.append(capacity // (k + 1))
        rest -= cuts[-1]
    return cuts


class HarmonicPacker:
    """One worker's bins."""

    def __init__(self, capacity: int, waste: float, first_id: int):
        self.capacity, self.waste, self.next_id = capacity, waste, first_id
        self.open: dict[int, list] = {}
        self.rows: list[tuple] = []
        self._cuts: dict[int, list[int]] = {}

    def _emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next_id, at))
            at += n
        self.next_id += 1

    def add(self, doc: int | None, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        if (cuts := self._cuts.get(total)) is None:
            cuts = self._cuts[total] = harmonic_cuts(total, self.capacity, self.waste)
        for n in cuts:
            k = self.capacity // n
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc, start, ids[4 * start : 4 * (start + n)], total))
            start += n
            if len(bin_) == k:
                self._emit(bin_)
                self.open[k] = []

    def close(self) -> None:
        """The open bins, end to end: full sequences, then powers of two."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        size = sum(len(p[2]) // 4 for p in left)
        targets = [self.capacity] * (size // self.capacity)
        targets += [1 << b for b in range(self.capacity.bit_length(), -1, -1) if size % self.capacity >> b & 1]
        left.reverse()
        for target in targets:
            pieces, room = [], target
            while room:
                doc, start, ids, total = left.pop()
                n = len(ids) // 4
                if n > room:
                    left.append((doc, start + room, ids[4 * room :], total))
                    ids, n = ids[: 4 * room], room
                pieces.append((doc, start, ids, total))
                room -= n
            self._emit(pieces)

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return record_batch(PIECES, [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * len(PIECES))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY, waste: float = WASTE) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path)
        packer = HarmonicPacker(capacity, waste, TaskContext.get().partitionId() << 33)
        end = packed_ids([end_id])
        with no_cycles():
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for a, b, texts in pieces(batch.column(1)):
                    for doc, packed in zip(ids[a:b], tokenizer.encode_packed(texts), strict=True):
                        packer.add(doc, packed + end)
                    yield packer.take()
            packer.close()
            yield packer.take()
            tokenizer.memo, tokenizer.older = {}, {}  # the worker lives on, and may do other work

    return id_text(docs).mapInArrow(tidy(run), PIECES_DDL)
