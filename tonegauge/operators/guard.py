"""Wording that generated copy must not use: claims about a sender's mind, and readers' reactions stated as facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import java

# Patterns.
_SUBJECT = "(?:the sender|sender|they|he|she)"
_VERB = "(?:meant|mean|intended|intends?|knew|know|believed|believes?|trying to|really wanted|truly wanted|wanted you to)"
CLAIMS = {
    "sender_intent": rf"\b{_SUBJECT}\b[^.?!;]*\b{_VERB}\b",
    "intended_as": r"\bintended (?:this|it) as\b",
    "meant_as": r"\bmeant (?:this|it) as\b",
}
READER, MODAL = r"\breaders?\b", r"\b(?:is|are)\s+likely\s+to\b|\btends?\s+to\b|\bat\s+risk\s+of\b"
BARE = r"\breaders?\b\s+(?:a\s+|the\s+|this\s+)?(?!is\b|are\b|was\b|were\b|does\b|has\b|likely\b|tends?\b|tend\b)([a-z][a-z-]*s)\b"
WILL = r"\breaders?\b[^.?!;]*\b(?:will|definitely)\b"


def intent_claim(text: Column) -> Column:
    """Name of the first violation: sender_intent, intended_as, meant_as, reader_unmodalized, reader_will; null without one."""
    claim = F.coalesce(*[F.when(text.rlike(java(p)), name) for name, p in CLAIMS.items()])

    def effect(clause: Column) -> Column:
        open_ = clause.rlike(java(READER)) & ~clause.rlike(java(MODAL))
        return F.when(open_ & clause.rlike(java(BARE)), "reader_unmodalized").when(open_ & clause.rlike(java(WILL)), "reader_will")

    effects = F.filter(F.transform(F.split(text, "[.?!;]"), effect), lambda e: e.isNotNull())
    return F.coalesce(claim, F.get(effects, F.lit(0)))


def assert_no_intent_claims(text: Column) -> Column:
    """The text itself; raises where it has a violation."""
    claim = intent_claim(text)
    return F.when(claim.isNull(), text).otherwise(F.raise_error(F.concat(F.lit("generated text claims "), claim, F.lit(": "), text)))
