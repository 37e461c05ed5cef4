"""Rules found by the words they need.

Every match of a pattern holds certain strings: one of "send", "share", ... say. They are read off the pattern once; a
text names its candidate rules by the strings it has, and only these rules' patterns are tried on it. A table of rules is
one constant of the plan, however many rules it has, and not an expression a rule.

Strings are looked for in the text's lower case, so a text of other case or of another alphabet may name a rule in vain,
but never misses one. Rules of which no string is known (a class of characters, white space) are tried on every text.
"""

from __future__ import annotations

import re
from functools import cache

from .text import literals, match_sql


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """Of two sets that both must be met the one that fewer texts meet: longer strings first, then fewer of them."""
    known = [s for s in (a, b) if s and all(s)]
    return max(known, key=lambda s: (min(4, min(map(len, s))), -len(s), sorted(s)), default=None)


def _of(parsed) -> frozenset[str] | None:
    best, run = None, ""
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL" and arg < 128:
            run += chr(arg).lower()
            continue
        if op in ("AT", "ASSERT", "ASSERT_NOT"):  # of no width: what comes next stands next to what came before
            continue
        best, run = _better(best, frozenset([run])), ""
        if op == "SUBPATTERN":
            best = _better(best, _of(arg[3]))
        elif op in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            best = _better(best, _of(arg[2]))
        elif op == "BRANCH":
            ways = [_of(way) for way in arg[1]]
            best = _better(best, None if None in ways else frozenset().union(*ways))
    return _better(best, frozenset([run]))


@cache
def needed(pattern: str) -> tuple[str, ...]:
    """Strings in lower case of which every match of the pattern holds one, less those that hold another; () if none is known."""
    found = _of(re._parser.parse(pattern)) or frozenset()
    return tuple(sorted(s for s in found if not any(t != s and t in s for t in found)))


def hits_sql(var: str, rows: list[tuple[str, tuple[str, ...], dict[str, str]]], **fields: str) -> str:
    """SQL of an array, in no order, with a named_struct of fields for each row (Java pattern, strings needed, SQL constants
    by name) that a text matches. In fields, {start} and {end} stand for the first match's bounds, {name} for a constant."""
    always = [match_sql(var, p, **{f: v.format(start="{start}", end="{end}", **own) for f, v in fields.items()}) for p, words, own in rows if not words]
    held = lambda own: ", ".join(f"'{name}', {value}" for name, value in own.items())
    table = [f"named_struct('p', r\"{p}\", 'w', array({literals(list(words))}), {held(own)})" for p, words, own in rows if words]
    tried = f"filter(array({', '.join(table)}), _r -> exists(_r.w, _w -> contains(_l, _w)) AND {var} RLIKE _r.p)"
    bounds = any("{start}" in v or "{end}" in v for v in fields.values())  # else a match need not be looked for again
    places = f", 's', regexp_instr({var}, _r.p) - 1, 'n', length(regexp_extract({var}, _r.p, 0))" if bounds else ""
    placed = f"transform({tried}, _r -> named_struct('r', _r{places}))"
    constants = {k: f"_h.r.{k}" for k in rows[0][2]}
    built = ", ".join(f"'{f}', {v.format(start='_h.s', end='(_h.s + _h.n)', **constants)}" for f, v in fields.items())
    found = f"element_at(transform(array(lower({var})), _l -> transform({placed}, _h -> named_struct({built}))), 1)" if table else ""
    tests = f"filter(array({', '.join(always)}), _m -> _m IS NOT NULL)" if always else ""
    return f"concat({tests}, {found})" if table and always else found or tests
