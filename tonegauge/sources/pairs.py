"""Minimal pairs, with what each side is worth, derived by hand from the rule tables; dealt out to the keys of a table.

A pair's sides differ in one respect, its family. The first three families word the same request more or less
strongly (a stronger than b, force the same); the others give more or less reason to act (b more than a, surface the
same). Each wording is made for each object, so a family has 20 pairs.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import adapters

#: A Monday; the fixtures' end of the business day is 17:00.
AT, DAY_END = "2026-08-17T09:00:00-04:00", "17:00"
ADDRESSES = {"A": "sender-a@example.com", "B": "sender-b@example.com"}
OBJECTS = ["the agenda", "the forecast", "the handbook", "the roster"]
SURFACE_FAMILIES = ["modality", "strategy", "modification"]
FORCE_FAMILIES = ["external", "deadline", "escalation"]

_ASK = "Can you send {o}?"
_EXP = "CAST(1.5 * exp(-{h} / 48.0) AS DOUBLE)"


class Side(NamedTuple):
    """messages: (minutes before, sender, text); force: SQL of what is expected."""

    messages: list[tuple[int, str, str]]
    surface: float
    force: str = "3.0"


def _one(text: str, surface: float, force: str = "3.0") -> Side:
    return Side([(0, "A", text)], surface, force)


def _near(rung: float, hours: float) -> str:
    return f"3.0 + {rung} * 0.6 + {_EXP.format(h=hours)}"


_VAGUE = _one("Can you send {o} sometime?", 3.1, "3.0 + 0.5 * 0.6")
_ALONE = _one(_ASK, 3.1)
_ASK_AT = lambda *minutes: [(m, "A", _ASK) for m in minutes]

PAIRS: list[tuple[str, Side, Side]] = [
    ("modality", _one("Send {o}.", 10.0), _one("Could you send {o}?", 2.7)),
    ("modality", _one("You need to send {o}.", 7.0), _one("Can you send {o}?", 3.1)),
    ("modality", _one("Please send {o}.", 10.0), _one("Would you mind sending {o}?", 3.1)),
    ("modality", _one("I want you to send {o}.", 6.0), _one("Could you send {o}?", 2.7)),
    ("modality", _one("Let's send {o}.", 4.5), _one("Can you send {o}?", 3.1)),
    ("strategy", _one("I'm asking you to send {o}.", 9.0), _one("I'd like to ask you to send {o}.", 8.0)),
    ("strategy", _one("I'd like to ask you to send {o}.", 8.0), _one("You need to send {o}.", 7.0)),
    ("strategy", _one("You need to send {o}.", 7.0), _one("I want you to send {o}.", 6.0)),
    ("strategy", _one("I need {o}.", 6.0), _one("We could send {o}.", 4.5)),
    ("strategy", _one("We could send {o}.", 4.5), _one(_ASK, 3.1)),
    ("modification", _one("You need to urgently send {o}.", 7.8), _one("You need to maybe send {o}.", 6.52)),
    ("modification", _one("You need to really send {o}!!", 8.04), _one("You need to send {o}.", 7.0)),
    ("modification", _one("You need to really send {o}!!", 8.04), _one("You need to possibly send {o}.", 6.6)),
    ("modification", _one("You need to urgently send {o}.", 7.8), _one("You need to possibly send {o}.", 6.6)),
    ("modification", _one("You need to really send {o}!!", 8.04), _one("You need to maybe send {o}.", 6.52)),
    ("external", _ALONE, _one(_ASK + " Otherwise we'll miss the window.", 3.1, "3.0 + 2.8 * 0.83")),
    ("external", _ALONE, _one(_ASK + " Otherwise we'll escalate.", 3.1, "3.0 + 3.0 * 0.83")),
    ("external", _ALONE, _one(_ASK + " We're blocked on it.", 3.1, "3.0 + 2.2 * 0.8")),
    ("external", _ALONE, _one(_ASK + " The client is waiting.", 3.1, "3.0 + 2.2 * 0.8")),
    ("external", _ALONE, _one(_ASK + " Following up on this.", 3.1, "3.0 + 1.8 * 0.8")),
    ("deadline", _VAGUE, _one("Can you send {o} by Friday?", 3.1, _near(3, 104))),
    ("deadline", _VAGUE, _one("Can you send {o} tomorrow?", 3.1, _near(3, 32))),
    ("deadline", _VAGUE, _one("Can you send {o} today?", 3.1, _near(3, 8))),
    ("deadline", _VAGUE, _one("Can you send {o} by 5pm?", 3.1, _near(4, 8))),
    ("deadline", _VAGUE, _one("Can you send {o} ASAP?", 3.1, _near(5, 0))),
    ("escalation", _ALONE, Side(_ASK_AT(1440, 0), 3.1, "3.0 + 1.0 + 0.5")),
    ("escalation", _ALONE, Side(_ASK_AT(2880, 1440, 0), 3.1, "3.0 + 1.8 + 0.5")),
    ("escalation", _ALONE, Side(_ASK_AT(2880, 480, 0), 3.1, "3.0 + 1.8 + 0.5 + 0.5 - 0.0")),
    ("escalation", Side([(1440, "A", _ASK), (480, "B", "All done."), (0, "A", _ASK)], 3.1), Side([(1440, "A", _ASK), (480, "B", "Looking."), (0, "A", _ASK)], 3.1, "3.0 + 1.0")),
    ("escalation", _ALONE, Side([(1440, "A", "Could you send {o}?"), (0, "A", _ASK)], 3.1, "3.0 + 1.0 + 0.5")),
]

#: A wording for each level that is selected, each on a rule of its own.
LEVELS = [
    (1, "Please laminate {o}."), (2, "I'm requesting a fresh copy of {o}."), (3, "Mind if I ask you to translate {o}."), (4, "You'll have to renumber {o}."), (5, "I'm after two copies of {o}."),
    (6, "Another option is trimming {o}."), (7, "Is it possible to rebind {o}?"),
]

#: What counts once and what counts apart: text, category, rows and events expected.
SCENARIOS = [
    ("a single consequence", _ASK + " The risk is a bare stall at the fair.", "consequence", 1, 1),
    ("a consequence either side of a semicolon", _ASK + " The risk is a bare stall at the fair; worst case the hall goes to others.", "consequence", 2, 2),
    ("a consequence in each of two sentences", _ASK + " The risk is a bare stall at the fair. Worst case the hall goes to others.", "consequence", 2, 2),
    ("a clock time and how near it is", "Can you send {o} by noon?", "temporal", 2, 1),
    ("a promise made", _ASK + " I committed to it.", "dependency", 1, 1),
    ("two promises in two units", _ASK + " I committed to it; finance needs the totals.", "dependency", 2, 2),
    ("a promise is no consequence", _ASK + " I committed to it.", "consequence", 0, 0),
]


#: Every pair in every wording, every scenario: what keys are dealt to.
N_PAIRS = len(PAIRS) * len(OBJECTS)


def _dealt(keys: DataFrame, threads: list[tuple[int, str, int, int, str, str]], number: Column) -> DataFrame:
    """Messages of the threads (number, suffix, ord, minutes before, sender, text) that each key's number has."""
    spark = keys.sparkSession
    rows = spark.createDataFrame([(n, suffix, i, minutes, sender, "B" if sender == "A" else "A", text) for n, suffix, i, minutes, sender, text in threads], "number int, suffix string, ord int, minutes_before int, sender string, recipient string, text string")
    dealt = keys.select(F.col("key"), number.cast("int").alias("number")).join(F.broadcast(rows), "number")  # as many rows as the lists above have messages
    return adapters.fixture_thread(dealt.withColumn("thread_id", F.concat_ws("-", F.lit("k"), F.col("key").cast("string"), "suffix")), AT, ADDRESSES)


def pair_messages(keys: DataFrame) -> DataFrame:
    """keys (key): threads k-KEY-a and k-KEY-b, of pair 37 KEY modulo N_PAIRS, so that few keys have all families."""
    threads = [(n * len(OBJECTS) + k, end, i, m, s, t.format(o=o)) for n, (_, *sides) in enumerate(PAIRS) for end, side in zip("ab", sides, strict=True) for k, o in enumerate(OBJECTS) for i, (m, s, t) in enumerate(side.messages)]
    return _dealt(keys, threads, F.col("key") * 37 % N_PAIRS)


def pair_rows(keys: DataFrame) -> DataFrame:
    """pair_id (the key), family, a_thread, b_thread."""
    families = F.array(*[F.lit(pair[0]) for pair in PAIRS for _ in OBJECTS])
    thread = lambda end: F.concat(F.lit("k-"), F.col("key").cast("string"), F.lit(f"-{end}"))
    return keys.select(F.col("key").alias("pair_id"), F.get(families, (F.col("key") * 37 % N_PAIRS).cast("int")).alias("family"), thread("a").alias("a_thread"), thread("b").alias("b_thread"))


def level_messages(keys: DataFrame) -> DataFrame:
    """Threads k-KEY-level-LEVEL, all levels for each key, with object KEY modulo OBJECTS."""
    threads = [(k, f"level-{level}", 0, 0, "A", text.format(o=o)) for level, text in LEVELS for k, o in enumerate(OBJECTS)]
    return _dealt(keys, threads, F.col("key") % len(OBJECTS))


def scenario_messages(keys: DataFrame) -> DataFrame:
    """Threads k-KEY-scenario, of scenario KEY modulo SCENARIOS."""
    return _dealt(keys, [(n, "scenario", 0, 0, "A", text.format(o=OBJECTS[0])) for n, (_, text, *_) in enumerate(SCENARIOS)], F.col("key") % len(SCENARIOS))
