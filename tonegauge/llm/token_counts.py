"""Edit-aware token counting.

A document's pre-tokens (matches of the tokenizer's pattern, each encoded on its
own) lie in a segment tree: leaves hold up to ``LEAF`` pre-tokens, inner nodes the
sums of characters and tokens below. An edit finds its leaves by walking the
character sums, matches the pattern again from a few characters before the edit
until a match begins where an old one began beyond it, counts tokens for these
pre-tokens alone and updates the sums on the paths above.

Why a few characters are enough: every match starts where the last one ended and
looks at no more than ``CONTEXT`` characters past its end, so matches that end so
far before an edit stay, and once a boundary past the edit meets an old boundary
all later matches are the old ones.

Defined results: a null text is empty and has no tokens; any length of text is
counted whole; edits past the end are clamped to it; equal texts have equal
counts; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import id_text, no_cycles, record_batch
from .bpe import PrefixEncoder, encoder

#: Pre-tokens in a leaf, children of a node, characters past a match that its pattern may look at.
LEAF, FAN, CONTEXT = 64, 16, 4


class TokenTree:
    """The pre-token segment tree of one text."""

    def __init__(self, text: str, enc: PrefixEncoder):
        self.enc, self.text = enc, text
        self.touched = 0
        chars, tokens = self._measure(enc.pieces.findall(text))
        starts = range(0, len(chars), LEAF)
        self.leaves = [(chars[i : i + LEAF], tokens[i : i + LEAF]) for i in starts]
        self._sum_up(np.add.reduceat(np.stack([chars, tokens], axis=1), starts, axis=0) if len(chars) else np.zeros((0, 2), np.int64))

    def _measure(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = list(map(self.enc.memo.get, pieces))
        if None in sizes:
            sizes = [self.enc.packed(p) if s is None else s for p, s in zip(pieces, sizes, strict=True)]
        n = len(pieces)
        return np.fromiter(map(len, pieces), np.int64, n), np.fromiter(map(len, sizes), np.int64, n) >> 2

    def _sum_up(self, level: np.ndarray) -> None:
        """All levels: level 0 is a row of (characters, tokens) per leaf, the last one has a single node."""
        self.levels = [level]
        while len(level) > 1:
            level = np.add.reduceat(level, np.arange(0, len(level), FAN), axis=0)
            self.levels.append(level)

    @property
    def n_tokens(self) -> int:
        return int(self.levels[-1][0, 1]) if self.leaves else 0

    def _leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and the characters before that leaf."""
        node = before = 0
        for level in reversed(self.levels[:-1]):
            node *= FAN
            stop = min(node + FAN, len(level))
            while node + 1 < stop and before + level[node, 0] <= char:
                before += int(level[node, 0])
                node += 1
        return node, before

    def replace(self, start: int, end: int, by: str) -> int:
        """Replace characters [start, end) and return the count of tokens after it."""
        old = self.text
        start = min(max(start, 0), len(old))
        end = min(max(end, start), len(old))
        self.text = old[:start] + by + old[end:]
        if not self.leaves:
            self.__init__(self.text, self.enc)
            return self.n_tokens
        shift = len(by) - (end - start)
        first, before = self._leaf_at(max(0, start - CONTEXT))
        ends = before + np.cumsum(self.leaves[first][0])
        keep = int(np.searchsorted(ends, start - CONTEXT, side="right"))
        if keep == 0 and first:  # nothing of this leaf is safe: the last match of the one before starts the context
            first -= 1
            before -= int(self.levels[0][first, 0])
            ends = before + np.cumsum(self.leaves[first][0])
            keep = int(np.searchsorted(ends, start - CONTEXT, side="right"))
        at = int(ends[keep - 1]) if keep else before
        # old boundaries past the edit, leaf by leaf as the matches reach them
        leaf, base = first, before
        bounds: np.ndarray = base + np.concatenate([[0], np.cumsum(self.leaves[leaf][0])])
        pieces, met = [], None
        for match in self.enc.pieces.finditer(self.text, at):
            here = match.start() - shift
            if match.start() >= start + len(by) and here >= end:
                while here >= bounds[-1] and leaf + 1 < len(self.leaves):
                    base, leaf = int(bounds[-1]), leaf + 1
                    bounds = base + np.concatenate([[0], np.cumsum(self.leaves[leaf][0])])
                i = int(np.searchsorted(bounds, here))
                if i < len(bounds) - 1 and bounds[i] == here:
                    met = i
                    break
            pieces.append(match.group())
        chars, tokens = self._measure(pieces)
        self.touched += len(pieces)
        head_c, head_t = (x[:keep] for x in self.leaves[first])
        last = leaf if met is not None else len(self.leaves) - 1
        tail_c, tail_t = (x[met:] for x in self.leaves[leaf]) if met is not None else (chars[:0], tokens[:0])
        chars, tokens = np.concatenate([head_c, chars, tail_c]), np.concatenate([head_t, tokens, tail_t])
        new = [(chars[i : i + LEAF], tokens[i : i + LEAF]) for i in range(0, len(chars), LEAF)]
        if len(new) == last - first + 1:
            self.leaves[first : last + 1] = new
            self._update(first, last)
        else:
            self.leaves[first : last + 1] = new
            self._splice(first, last, new)
        return self.n_tokens

    def _update(self, first: int, last: int) -> None:
        """As many leaves as before: only the sums on their paths change."""
        level = self.levels[0]
        for i in range(first, last + 1):
            level[i] = self.leaves[i][0].sum(), self.leaves[i][1].sum()
        for below, above in zip(self.levels, self.levels[1:], strict=False):
            first, last = first // FAN, last // FAN
            for i in range(first, last + 1):
                above[i] = below[i * FAN : (i + 1) * FAN].sum(axis=0)

    def _splice(self, first: int, last: int, new: list) -> None:
        """More or fewer leaves: their own sums are made, the levels above are added up from kept sums."""
        sums = np.array([(c.sum(), t.sum()) for c, t in new], dtype=np.int64).reshape(-1, 2)
        self._sum_up(np.concatenate([self.levels[0][:first], sums, self.levels[0][last + 1 :]]))


#: (start, end, replacement) from a text: what an editor log would bring.
Edits = Callable[[str], list[tuple[int, int, str]]]


def sample_edits(text: str) -> list[tuple[int, int, str]]:
    """A deletion of up to 40 characters at a third, a word put in at the (then) middle, a sentence at the end."""
    n = len(text)
    cut = min(40, n // 4)
    rest = n - cut
    return [(n // 3, n // 3 + cut, ""), (rest // 2, rest // 2, " unaltered's 2026"), (rest + 17, rest + 17, "\n\nThe end.  ")]


def apply_edits(text: str, edits: list[tuple[int, int, str]]) -> str:
    for start, end, by in edits:
        text = text[:start] + by + text[end:]
    return text


COUNTS = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_chars", "n_tokens", "edited_chars", "edited_tokens", "n_pretokens", "reencoded_pretokens")])


def count_tokens(docs: DataFrame, path: str, pattern: str, edits: Edits = sample_edits) -> DataFrame:
    """Tokens of every whole text before and after its edits; one pass, no shuffle.

    reencoded_pretokens says how many pre-tokens the edits made it encode again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        with no_cycles():
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    tree = TokenTree(text, enc)
                    before, pieces = tree.n_tokens, sum(len(c) for c, _ in tree.leaves)
                    for start, end, by in edits(text):
                        tree.replace(start, end, by)
                    rows.append((doc, len(text), before, len(tree.text), tree.n_tokens, pieces, tree.touched))
                yield record_batch(COUNTS, [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * len(COUNTS))

    return id_text(docs).mapInArrow(run, ", ".join(f"{n} long" for n in COUNTS.names))
