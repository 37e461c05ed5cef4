"""Vectorised hashing of words and n-grams over many texts at once."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BLOCK = 1 << 20
_GOLD = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = x + _GOLD
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64))
_BASE = U64(0xD1342543DE82EF95)  # odd, so it has an inverse modulo 2**64
_BACK = U64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, _BLOCK + 1)
        ups, downs = np.full(size, _BASE), np.full(size, _BACK)
        ups[0] = downs[0] = 1
        _powers[:] = [np.multiply.accumulate(ups), np.multiply.accumulate(downs)]
    return _powers[0][:n], _powers[1][:n]


def _block_words(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    up, down = _tables(len(b) + 1)
    word = ~_SPACE[b]
    edges = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    sums = np.zeros(len(b) + 1, U64)
    np.cumsum(_BYTE[b] * up[: len(b)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))
    return hashes, starts, ends


def words(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words [^\\x20\\x09-\\x0D]+ in order: hash, number of the text, byte bounds within the text.

    lower: A-Z count as a-z. Works in blocks that end at white space, so the memory
    beside the result doesn't grow with a text's length.
    """
    data = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    if lower:
        data = _LOWER[data]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    text_starts = np.concatenate([[0], np.cumsum(sizes + 1)])[: len(texts)]
    parts, at = [], 0
    while at < len(data):
        stop, step = min(at + _BLOCK, len(data)), _BLOCK
        while stop < len(data) and not _SPACE[data[stop]]:
            gap = np.flatnonzero(_SPACE[data[stop : stop + step]])
            stop = stop + int(gap[0]) if len(gap) else min(stop + step, len(data))
        h, s, e = _block_words(data[at:stop])
        parts.append((h, s + at, e + at))
        at = stop
    if not parts:
        return np.zeros(0, U64), *(np.zeros(0, np.int64),) * 3
    h, s, e = (np.concatenate(x) for x in zip(*parts, strict=True))
    owner = np.searchsorted(text_starts, s, side="right") - 1
    return h, owner, s - text_starts[owner], e - text_starts[owner]


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k neighbours, whatever text they are of."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out = mix(out * U64(3) + hashes[j : j + n])
    return out


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and the bounds of each text's part.

    Shingles are of k words, lower-cased A-Z; a text with fewer words has the whole sequence as one.
    """
    h, owner, _, _ = words(texts, lower=True)
    counts = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(counts)])
    g = grams(h, k)
    sets = []
    for i, n in enumerate(counts.tolist()):
        a = int(first[i])
        if n >= k:
            sets.append(np.unique(g[a : a + n - k + 1]))
        elif n:
            short = h[a : a + 1]
            for j in range(a + 1, a + n):
                short = mix(short * U64(3) + h[j : j + 1])
            sets.append(mix(short ^ U64(n)))
        else:
            sets.append(np.zeros(0, U64))
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, U64)), bounds
