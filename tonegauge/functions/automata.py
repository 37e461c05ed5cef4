"""In how many texts each rule matches, where only that is asked: patterns as automata (RE2, by Arrow) over batches of texts.

An automaton reads a text once, whatever its pattern, and several patterns are one automaton as well as one is. Rules are
the leaves of a tree; a text goes on to the branches whose united patterns it matches, so rules that it hasn't are
dismissed together. Letters are compared as ASCII, so texts are put into lower case and not patterns into both.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

from .text import re2

#: Branches of a node.
WAYS = 7


def _gate(pattern: str) -> str | None:
    """Of a pattern with a long counted repetition, of which an automaton has very many states, what comes after it: every
    match has a match of that in it. Else null."""
    tail = re.split(r"\{\d+,\d{2,}\}", pattern)[-1]
    if tail == pattern or tail.startswith("?") or any(str(op) == "BRANCH" for op, _ in re._parser.parse(pattern)):
        return None
    try:
        return re.compile(tail) and tail
    except re.error:  # the repetition is within a group
        return None


def counter(rules: list[tuple[str, int, str, bool]], out: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over one column of texts: the number of texts for each rule (lexicon, number, pattern, whether case
    counts) that matches any. Null texts match none. What it returns refers to nothing of this package, so that it
    need not be installed where tasks run."""
    lowered = lambda p, case: re2(p if case else re.sub(r"[A-Z]", lambda m: m[0].lower(), p))
    leaves = [(k, lowered(p, case), (gate := _gate(p)) and lowered(gate, case), case) for k, (_, _, p, case) in enumerate(rules)]
    if any(re.search(r"\\[A-Z]", p) for _, _, p, _ in rules):
        raise ValueError("an escape in capitals would change its meaning in lower case")
    leaves.sort(key=lambda leaf: leaf[2] is not None)  # wide ones together: their gates let many texts through
    names, ways = [(lexicon, number) for lexicon, number, _, _ in rules], WAYS

    def count(texts: pa.Array, some: list, found: list[int]) -> None:
        if len(some) == 1:
            k, p, gate, _ = some[0]
            if gate:
                texts = texts.filter(pc.match_substring_regex(texts, gate))
            found[k] += pc.match_substring_regex(texts, p).true_count
            return
        size = -(-len(some) // ways)
        for at in range(0, len(some), size):
            branch = some[at : at + size]
            held = texts if len(branch) == 1 else texts.filter(pc.match_substring_regex(texts, "|".join(f"(?:{gate or p})" for _, p, gate, _ in branch)))
            if len(held):
                count(held, branch, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [0] * len(names)
        for batch in batches:
            texts = batch.column(0).drop_null()
            for case in (True, False):
                some = [leaf for leaf in leaves if leaf[3] == case]
                if len(texts) and some:
                    count(texts if case else pc.ascii_lower(texts), some, found)
        rows = [(*names[k], n) for k, n in enumerate(found) if n]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 3, out.types, strict=True)], schema=out)

    return run
