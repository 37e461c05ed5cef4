"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece of bytes exactly one token is the last one of the
prefix's BPE encoding. ``PrefixEncoder`` stores that token per prefix: the next
prefix's last token is the one that ends there and is compatible with the stored
last token of the prefix it leaves. The table makes appends exact without
touching what stands before, and an edit re-encodes only from where it starts
until the tables agree again.

Defined results: a null text is the empty text (no ids; decodes to no bytes); a
text of any length is encoded whole, one match of the pattern at a time; equal
texts give equal ids; an empty table gives an empty table; further columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._common import id_text, no_cycles, record_batch

#: Distinct pieces in each of the two generations a worker keeps; when the younger is full, the older goes.
MEMO_PIECES = 400_000
#: Pairs of tokens whose compatibility a worker keeps.
MEMO_PAIRS = 500_000
#: Bytes at a token's end by which the longest token with this end is known.
TAIL = 4


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PrefixEncoder:
    """BPE by the unique last token of every prefix."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens: dict[int, bytes] = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.reach: dict[bytes, int] = {}
        for t in ranks:
            if len(t) >= TAIL:
                self.reach[t[-TAIL:]] = max(len(t), self.reach.get(t[-TAIL:], 0))
        self.pieces = regex.compile(pattern)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._merged: dict[tuple[int, int], int] = {}
        self._halves: dict[int, tuple[int, int]] = {}
        self._pairs: dict[int, bool] = {}
        self._learn_merges()

    def _learn_merges(self) -> None:
        """The two tokens each token is merged of; taken in rank order, so shorter encodings are already known."""
        for token in sorted(self.ranks, key=self.ranks.get):
            i = self.ranks[token]
            if len(token) == 1:
                self._halves[i] = (i, i)
                continue
            last = self._table(token, below=i)
            right = last[-1]
            left = last[len(token) - len(self.tokens[right])] if right is not None and right != i else None
            if left is None:  # no merge leads here: only a whole piece can be this token
                self._halves[i] = (i, i)
                continue
            self._halves[i] = (left, right)
            self._merged[left, right] = i

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves these two tokens side by side: no merge across their border comes before its turn."""
        bound = 1 << 62
        while True:
            if self._merged.get((left, right), bound) < bound:
                return False
            if left > right:
                bound = left
                left = self._halves[left][1]
                if left == bound:
                    bound, (right, was) = right + 1, (self._halves[right][0], right)
                    if right == was:
                        return True
            else:
                bound, was = right + 1, right
                right = self._halves[right][0]
                if right == was:
                    bound = left
                    left = self._halves[left][1]
                    if left == bound:
                        return True

    def _table(self, piece: bytes, below: int | None = None, last: list | None = None) -> list:
        """last[n]: the last token of the encoding of piece[:n]; extends the table given."""
        last = [None] if last is None else last
        rank, reach, pairs = self.ranks.get, self.reach.get, self._pairs
        for end in range(len(last), len(piece) + 1):
            found = None
            start = end - reach(piece[end - TAIL : end], TAIL - 1) if end > TAIL else 0  # what begins before is no token
            for start in range(start if start > 0 else 0, end):
                token = rank(piece[start:end])
                if token is None or below is not None and token >= below:
                    continue
                if start == 0:
                    found = token
                    break
                if (before := last[start]) is None:
                    continue
                pair = before << 32 | token
                if (fits := pairs.get(pair)) is None:
                    fits = self.compatible(before, token)
                    if below is None:
                        if len(pairs) >= MEMO_PAIRS:
                            pairs.clear()
                        pairs[pair] = fits
                if fits:
                    found = token
                    break
            last.append(found)
        return last

    def append(self, piece: bytes, last: list, more: bytes) -> tuple[bytes, list]:
        """The table of piece + more, from the table of piece: only the new prefixes are worked out."""
        return piece + more, self._table(piece + more, last=last)

    def _walk(self, piece: bytes, last: list) -> list[int]:
        ids, end = [], len(piece)
        while end:
            ids.append(last[end])
            end -= len(self.tokens[last[end]])
        return ids[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self._walk(piece, self._table(piece))

    def packed(self, piece: str) -> bytes:
        """The ids of one match of the pattern, as little-endian unsigned 32-bit integers."""
        found = self.memo.get(piece) or self.older.get(piece)
        if found is None:
            found = np.array(self.encode_piece(piece.encode("utf-8")), dtype="<u4").tobytes()
        if len(piece) <= 64:
            if len(self.memo) >= MEMO_PIECES:
                self.memo, self.older = {}, self.memo
            self.memo[piece] = found
        return found

    def encode_packed(self, text: str) -> bytes:
        pieces = self.pieces.findall(text)
        known = list(map(self.memo.get, pieces))
        if None in known:
            known = [self.packed(p) if k is None else k for p, k in zip(pieces, known, strict=True)]
        return b"".join(known)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype="<u4").tolist()

    def decode_packed(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


class PieceTable:
    """One growing piece: the prefix table, appends and edits in place."""

    def __init__(self, encoder: PrefixEncoder, piece: bytes = b""):
        self.encoder, self.piece, self.last = encoder, piece, encoder._table(piece)

    def append(self, more: bytes) -> None:
        self.piece, self.last = self.encoder.append(self.piece, self.last, more)

    def replace(self, start: int, end: int, by: bytes) -> int:
        """Replace piece[start:end]; returns how many prefixes were worked out anew.

        A last token depends on the bytes and last tokens of the ``longest`` bytes
        before it alone, so once that many new entries equal the old ones past the
        edit, the old tail holds again.
        """
        old, shift = self.last, len(by) - (end - start)
        self.piece = self.piece[:start] + by + self.piece[end:]
        last, worked, same = old[: start + 1], 0, 0
        for stop in range(start + 1, len(self.piece) + 1):
            last = self.encoder._table(self.piece[:stop], last=last)
            worked += 1
            same = same + 1 if stop > start + len(by) + self.encoder.longest and last[stop] == old[stop - shift] else 0
            if same >= self.encoder.longest:
                last += old[stop - shift + 1 :]
                break
        self.last = last
        return worked

    def ids(self) -> list[int]:
        whole = self.encoder.ranks.get(self.piece)
        return [whole] if whole is not None else self.encoder._walk(self.piece, self.last)


_ENCODERS: dict[tuple[str, str], PrefixEncoder] = {}


def encoder(path: str, pattern: str) -> PrefixEncoder:
    """One encoder for each vocabulary and Python worker."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = PrefixEncoder(read_ranks(path), pattern)
    return _ENCODERS[path, pattern]


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64())])
DIGESTED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (packed little-endian unsigned 32-bit), n_tokens of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            packed = [enc.encode_packed(t) for t in batch.column(1).to_pylist()]
            yield record_batch(ENCODED, [batch.column(0), packed, [len(p) // 4 for p in packed]])

    return id_text(docs).mapInArrow(run, "doc_id long, ids binary, n_tokens long")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, decoded (bytes) of packed ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            yield record_batch(schema, [batch.column(0), [enc.decode_packed(p or b"") for p in batch.column(1).to_pylist()]])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def encode_decode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One pass: encode, digest the ids, decode them again, digest the bytes. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        sha = hashlib.sha256
        with no_cycles():
            for batch in batches:
                counts, ids_sha, decoded_sha = [], [], []
                for text in batch.column(1).to_pylist():
                    packed = enc.encode_packed(text)
                    counts.append(len(packed) // 4)
                    ids_sha.append(sha(packed).hexdigest())
                    decoded_sha.append(sha(enc.decode_packed(packed)).hexdigest())
                yield record_batch(DIGESTED, [batch.column(0), counts, ids_sha, decoded_sha])

    return id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
