"""Which sentence makes the request, and at which level of directness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..functions.needed import hits_sql, needed


def directness_sql(clause: str) -> str:
    """SQL of struct<level, start, ord, end>: the variable's most direct match, the earliest of its level; null without one."""
    rows = [(T.java(r.pattern, r.case), needed(r.pattern), {"ord": str(r.ord), "level": str(rules.level_of(r))}) for r in rules.DIRECTNESS]
    return f"array_min({hits_sql(clause, rows, level='{level}', start='{start}', ord='{ord}', end='{end}')})"


def clauses(text: Column, sentences: Column) -> Column:
    return F.transform(sentences, lambda s: T.piece(text, s["start"], s["end"]))


def matches(clauses_column: str) -> Column:
    """The directness match of each clause of a column."""
    return F.expr(f"transform({clauses_column}, c -> {directness_sql('c')})")


def head_act(sentences: Column, clauses_: Column, matches_: Column) -> Column:
    """struct<level, at, sentence, start, end, d_start, d_end, d_ord, strategy>: the sentence with the most direct
    request that is not in a quotation (the earliest of equals); null without one.

    at: where the match begins in the text; start, end: the sentence; d_start, d_end: the match in the sentence.
    """

    def candidate(s: Column, i: Column) -> Column:
        clause, m = F.get(clauses_, i), F.get(matches_, i)
        return F.when(
            (m["level"] <= rules.TOP_LEVEL) & ~T.in_quotation(clause, m["start"], m["end"]),
            F.struct(
                m["level"].alias("level"), (s["start"] + m["start"]).alias("at"), i.alias("sentence"), s["start"].alias("start"), s["end"].alias("end"),
                m["start"].alias("d_start"), m["end"].alias("d_end"), m["ord"].alias("d_ord"),
            ),
        )

    best = F.array_min(F.transform(sentences, candidate))
    strategies = F.expr(f"array({T.literals(rules.LEVELS)})")
    return T.let(best, lambda b: F.when(b.isNotNull(), b.withField("strategy", F.get(strategies, b["level"] - 1))))
