"""Message threads made from the test tables' keys.

The tables' own texts are invented words without a request, so a bank of templates
of our own is dealt out by key arithmetic: conversation and turn are the thread and
its order, the role is the sender. With each template stands what it is worth,
derived by hand, for the SQL that results are held against.
"""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, rules
from ..functions.text import literals

#: 2026-08-17T13:00:00Z, a Monday.
ANCHOR_MS = 1_786_971_600_000
DAY_END = "17:00"


class Template(NamedTuple):
    """level 0: no request. request: the sentence that makes it. due: kind of deadline; rung: its weight (-1: by the
    hours left of the day); consequence, dependency, follow_up: what they add."""

    text: str
    level: int = 0
    surface: float | None = None
    request: str | None = None
    due: str | None = None
    rung: float = 0.0
    consequence: float = 0.0
    dependency: float = 0.0
    follow_up: float = 0.0

    def marks(self) -> list[tuple[str, str, float]]:
        """Phrase, subcategory and weight of the wording evidence: the phrases below that the text has, in the request
        or in a sentence of nothing but modifiers."""
        return [m for m in MARKS if self.level and m[0] in self.text and self.text not in m[3]]


#: Phrase, subcategory, weight, and texts that have the phrase where it doesn't count: read off the rule tables by hand.
MARKS = [
    ("Review", "mood_derivable", 10.0, ()), ("Please update", "mood_derivable", 10.0, ()), ("Please send", "mood_derivable", 10.0, ()), ("I'm asking you to", "performative", 9.0, ()),
    ("I'd like to ask you to", "hedged_performative", 8.0, ()), ("You need to", "obligation", 7.0, ()), ("You should", "obligation", 7.0, ()), ("You should", "syntactic.weak_deontic", -0.32, ()),
    ("I need", "want", 6.0, ()), ("How about", "suggestory", 4.5, ()), ("Let's", "suggestory", 4.5, ()), ("Can you", "query_preparatory", 3.5, ()), ("Could you", "query_preparatory", 3.5, ()),
    ("Would you mind", "query_preparatory", 3.5, ()), ("?", "syntactic.interrogative", -0.4, ("Could you look at the chart, Bob?",)), ("Could", "syntactic.conditional", -0.4, ()),
    ("please", "politeness_marker", -0.32, ()), ("if possible", "downtoner", -0.64, ()), ("No rush", "workplace_formula", -0.8, ("Could you review the plan? No rush on the other task.",)),
    ("really", "intensifier", 0.4, ()), ("!!", "emphatic_orthography", 0.64, ()), ("LOGIN", "emphatic_orthography", 0.48, ()),
]


def _t(request: str, level: int, surface: float, rest: str = "", **more: object) -> Template:
    return Template(request + rest, level, surface, request, **more)


BANK = [
    _t("Review the budget deck.", 1, 10.0),
    _t("Please update the roadmap.", 1, 10.0),
    _t("I'm asking you to confirm the venue.", 2, 9.0),
    _t("I'd like to ask you to share the notes.", 3, 8.0),
    _t("You need to submit the invoice.", 4, 7.0),
    _t("You should archive the old ticket.", 4, 6.68),
    _t("I need the signed contract.", 5, 6.0),
    _t("How about a short sync?", 6, 4.1),
    _t("Let's move the launch.", 6, 4.5),
    _t("Can you send the report?", 7, 3.1),
    _t("Could you send the report?", 7, 2.7),
    _t("Would you mind sharing the draft?", 7, 3.1),
    _t("Could you please check the draft, if possible?", 7, 1.74),
    _t("Could you review the plan?", 7, 1.9, " No rush."),
    _t("Could you review the plan?", 7, 2.7, " No rush on the other task."),
    _t("You need to really fix the login page!!", 4, 8.04),
    _t("You need to fix the LOGIN page.", 4, 7.48),
    _t("You need to send the file by EOD.", 4, 7.0, due="end of day", rung=-1),
    _t("Can you send the invoice by Friday?", 7, 3.1, due="friday", rung=3.0),
    _t("Can you send the invoice tomorrow?", 7, 3.1, due="tomorrow", rung=3.0),
    _t("Can you send the invoice today?", 7, 3.1, due="end of day", rung=-1),
    _t("Can you send the invoice ASAP?", 7, 3.1, due="now", rung=5.0),
    _t("Can you send the invoice sometime?", 7, 3.1, due="unknown", rung=0.5),
    _t("Can you send the invoice this week?", 7, 3.1, due="friday", rung=1.5),
    _t("Can you send the invoice?", 7, 3.1, " There is no deadline.", due="unknown", rung=0.0),
    _t("Can you send the summary?", 7, 3.1, " Otherwise we'll miss the window.", consequence=2.8 * 0.83),
    _t("Can you send the summary?", 7, 3.1, " We're blocked on it.", dependency=2.2 * 0.8),
    _t("Can you send the summary?", 7, 3.1, " The client is waiting.", dependency=2.2 * 0.8),
    _t("Can you escalate this ticket?", 7, 3.1),
    Template("Some thoughts on the summary."),
    _t("Can you send the summary?", 7, 3.1, " Following up on this.", follow_up=1.8 * 0.8),
    Template('The note said "please send the file" and nothing else.'),
    Template("Thanks, done."),
    Template("The numbers look fine."),
    Template("The file was sent over."),
    _t("Can you review item no. 5 and reply by 5pm?", 7, 3.1, due="5pm", rung=4.0),
    _t("Can you share the plan by 2026-09-30?", 7, 3.1, due="2026-09-30", rung=4.0),
    _t("Can you share the plan by the 15th?", 7, 3.1, due="15th", rung=3.0),
    _t("Could you look at the chart, Bob?", 7, 3.1),
    Template("🎉 Great. Can you tag the release?", 7, 3.1, "Can you tag the release?"),
]
#: One thread's course, for every fourth conversation: the same request again and again, and answers.
COURSE = [
    _t("Can you send the summary?", 7, 3.1),
    Template("The numbers look fine."),
    _t("Could you send the summary?", 7, 2.7),
    Template("The numbers look fine."),
    _t("I need the summary.", 5, 6.0),
    Template("Thanks, done."),
    _t("Please send the summary.", 1, 10.0),
    Template("The file was sent over."),
]
TEMPLATES = [*BANK, *COURSE]


def _example(parsed) -> str:
    """A short text that a parsed pattern matches: first branches, least repetitions."""
    out, groups = "", {}
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op in ("ANY", "NOT_LITERAL"):
            out += "x"
        elif op == "IN":
            kind, value = arg[0]
            out += {"LITERAL": lambda v: chr(v), "RANGE": lambda v: chr(v[0]), "CATEGORY": lambda v: {"CATEGORY_DIGIT": "3", "CATEGORY_SPACE": " "}.get(str(v), "a"), "NEGATE": lambda v: "x"}[str(kind)](value)
        elif op == "BRANCH":
            out += _example(arg[1][0])
        elif op == "SUBPATTERN":
            groups[arg[0]] = _example(arg[3])
            out += groups[arg[0]]
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            out += _example(arg[2]) * arg[0]
        elif op == "GROUPREF":
            out += groups[arg]
        elif op == "ASSERT" and arg[0] == 1:
            out += _example(arg[1])
    return out


@cache
def examples() -> list[str]:
    """For each rule a short text that it matches, made from its pattern."""
    from re import _parser

    return [_example(_parser.parse(r.pattern)) for table in rules.TABLES.values() for r in table]


def template_number(conv: str, turn: str) -> str:
    """SQL (both engines') of a message's template."""
    return f"CASE WHEN {conv} % 4 = 0 THEN {len(BANK)} + {turn} % {len(COURSE)} ELSE ({conv} * 31 + {turn} * 7) % {len(BANK)} END"


def sent_ms(conv: str, turn: str) -> str:
    """SQL of a message's time: turns of even conversations come closer and closer."""
    return f"{ANCHOR_MS} + {conv} * 97200000 + CASE WHEN {conv} % 2 = 0 THEN {turn} * (26 - {turn}) ELSE {turn} * 12 END * 3600000"


def offset_of(conv: str) -> str:
    return f"CASE WHEN {conv} % 3 = 0 THEN 0 WHEN {conv} % 3 = 1 THEN -240 ELSE 330 END"


def messages(conversations: DataFrame) -> DataFrame:
    """thread_id, ord, msg_id, sender_id, recipient_ids, ts, text, conv_id, template."""
    bank = F.expr(f"array({literals([t.text for t in TEMPLATES])})")
    number: Column = F.expr(template_number("conv_id", "turn")).cast("int")
    offset = F.expr(offset_of("conv_id"))
    local = F.expr(sent_ms("conv_id", "turn")) + offset * dates.MINUTE
    to = F.when(F.col("role") == "user", F.array(F.lit("assistant"))).when(F.col("role") == "assistant", F.array(F.lit("user"))).otherwise(F.array().cast("array<string>"))
    return conversations.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("thread_id"), F.col("turn").alias("ord"), F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("msg_id"),
        F.col("role").alias("sender_id"), to.alias("recipient_ids"), dates.iso_text(local, offset).alias("ts"), F.get(bank, number).alias("text"), "conv_id", number.alias("template"),
    )


def event_messages(events: DataFrame) -> DataFrame:
    """A volume corpus: a thread for each user, in order of time."""
    bank = F.expr(f"array({literals([t.text for t in TEMPLATES])})")
    number = ((F.col("user_id") * 31 + F.col("event_id") * 7) % len(TEMPLATES)).cast("int")
    sender = F.when(F.col("event_id") % 3 == 0, "b").otherwise("a")
    return events.select(
        F.col("user_id").cast("string").alias("thread_id"), F.col("event_id").alias("ord"), F.col("event_id").cast("string").alias("msg_id"), sender.alias("sender_id"),
        F.array(F.when(sender == "a", "b").otherwise("a")).alias("recipient_ids"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.get(bank, number).alias("text"),
    )
