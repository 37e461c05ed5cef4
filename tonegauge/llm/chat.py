"""Chat formatting by event-sourced reconstruction.

A log has one row per event: conv_id, seq, kind, turn, role, text.

* ``start``: a message begins at a turn, with a role and its first text;
* ``delta``: streamed text that goes to the end of the turn's message;
* ``edit``: the turn's text so far is replaced;
* ``regenerate``: what the conversation had at this turn and after it is dropped;
  a message begins anew there (role null: the dropped message's role is not kept,
  ``assistant`` is taken).

The log is dealt out by conversation, sorted by sequence and folded from its end:
read backwards, an event is dead if a later regeneration stands at its turn or
before, or a later start or edit replaces its turn. So the fold needs only the
lowest regenerated turn and the replaced turns, never the texts, and texts stream
through. The survivors are sorted by turn and sequence within the same partitions
(no second shuffle) and rendered turn by turn.

Template: ``<|im_start|>role\\n`` text ``<|im_end|>\\n`` for each turn. In texts and
roles one backslash is put into every ``<``, backslashes, ``|``, so control strings
never occur in them and the change is reversible; line breaks and backslashes of
roles are written ``\\n`` and ``\\\\``. The loss mask covers the escaped texts of assistants.

Defined results: a null text is empty, a null role is ``user``; events of equal
sequence number are taken in the order kind, turn, role, text; a message whose
``start`` is missing is a user's; events without a turn are of one more message, after all others; rows of a null conv_id are one conversation; an
empty log gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import record_batch

START, END = "<|im_start|>", "<|im_end|>"
_MARK, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def escape(text: str) -> str:
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def role_line(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def role_of(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(line))


def render(role: str, text: str) -> tuple[str, int, int]:
    """One turn of the template, and the bounds of its text in it."""
    head, body = f"{START}{role_line(role)}\n", escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"not a turn at {at}")
        turns.append((role_of(m[1]), unescape(m[2])))
        at = m.end()
    return turns


#: The turn of events that name none: a message of its own, after all others.
NO_TURN = (1 << 63) - 1
EVENTS = ("conv_id", "seq", "kind", "turn", "role", "text")
_LIVE = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("seq", pa.int64()), ("at", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_TURNS = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("role", pa.string()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
_NONE = object()


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events in falling sequence: those that nothing later undoes."""
    conv, lowest, replaced, at = _NONE, None, set(), 0
    for batch in batches:
        rows = []
        for c, seq, kind, turn, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if c != conv:
                conv, lowest, replaced, at = c, None, set(), 0
            at += 1
            if (lowest is None or turn < lowest) and turn not in replaced:
                if kind == "regenerate":
                    role = role or "assistant"
                elif kind in ("delta", "edit"):
                    role = None
                else:
                    role = role or "user"
                rows.append((c, turn, seq, -at, role, text))
                if kind in ("start", "regenerate"):
                    replaced.add(turn)
            elif kind == "start" and (lowest is None or turn < lowest):
                rows.append((c, turn, seq, -at, role or "user", ""))  # its text was edited away, its role holds
            if kind == "edit":
                replaced.add(turn)
            if kind == "regenerate" and (lowest is None or turn < lowest):
                lowest = turn
        yield record_batch(_LIVE, [list(x) for x in zip(*rows, strict=True)] if rows else [[]] * 6)


def _render_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Survivors by conversation, turn and sequence: one formatted row per turn."""
    key, role, parts, number, rows = None, None, [], 0, []

    def flush() -> None:
        if key is not None:
            who = role or "user"
            text, a, b = render(who, "".join(parts))
            spoken = who == "assistant"
            rows.append((key[0], number, who, text, a if spoken else None, b if spoken else None))

    for batch in batches:
        for c, turn, _, _, who, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if key is None or (c, turn) != key:
                flush()
                number = number + 1 if key is not None and key[0] == c else 0
                key, role, parts = (c, turn), None, []
            role = who or role
            parts.append(text)
        yield record_batch(_TURNS, [list(x) for x in zip(*rows, strict=True)] if rows else [[]] * 6)
        rows = []
    flush()
    if rows:
        yield record_batch(_TURNS, [list(x) for x in zip(*rows, strict=True)])


def format_log(events: DataFrame) -> DataFrame:
    """conv_id, turn_no (from 0), role, formatted, loss_start, loss_end: the rows of a conversation in
    order, end to end, are its formatted text; loss bounds are code points within the row (null: no loss)."""
    log = events.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("seq").cast("long").alias("seq"), "kind",
        F.coalesce(F.col("turn").cast("long"), F.lit(NO_TURN)).alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"),
    )
    backwards = log.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("seq").desc(), F.col("kind").desc(), F.col("turn").desc(), F.col("role").desc(), F.col("text").desc()
    )
    live = backwards.mapInArrow(_survivors, "conv_id long, turn long, seq long, at long, role string, text string")
    return live.sortWithinPartitions("conv_id", "turn", "seq", "at").mapInArrow(
        _render_turns, "conv_id long, turn_no long, role string, formatted string, loss_start long, loss_end long"
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, state, rows = _NONE, None, []

    def flush() -> None:
        if state is not None:
            n, turns, loss_chars, loss, chars = state
            rows.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

    for batch in batches:
        for c, _, _, formatted, a, b in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if c != conv:
                flush()
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            if a is not None:
                spoken = unescape(formatted[a:b])
                state[2] += len(spoken)
                state[3].update(spoken.encode())
            state[4] += len(formatted)
        yield record_batch(_DIGESTS, [list(x) for x in zip(*rows, strict=True)] if rows else [[]] * 6)
        rows = []
    flush()
    if rows:
        yield record_batch(_DIGESTS, [list(x) for x in zip(*rows, strict=True)])


def read_back(turns: DataFrame) -> DataFrame:
    """Digests of what the formatted rows of ``format_log`` say, parsed again; they stand by conversation
    already, and hashes run on from row to row, so no conversation is held whole."""
    return turns.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def events_of_turns(conversations: DataFrame) -> DataFrame:
    """A log that folds to finished turns, with all that happens to a message on its way.

    Every row is a turn of its own, numbered within its conversation by turn (null last), role and text. By its
    number a turn is streamed in two parts; or begun with a draft that an edit replaces before the rest is streamed;
    or answered wrongly, followed by another message, and regenerated, which drops both. Events of a message stand
    in the log from last to first: order comes from their sequence numbers alone.
    """
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.coalesce("role", F.lit("user")), "text")
    c = c.withColumn("turn", (F.row_number().over(order) - 1).cast("long"))
    half = F.floor(F.length("text") / 2).cast("int")
    first, rest = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    nobody, who = F.lit(None).cast("string"), F.coalesce("role", F.lit("user"))

    def event(at: int, kind: str, role: Column, text: Column, later: int = 0) -> Column:
        return F.struct((F.col("turn") * 8 + at).alias("seq"), F.lit(kind).alias("kind"), (F.col("turn") + later).alias("turn"), role.alias("role"), text.alias("text"))

    plain = F.array(event(1, "delta", nobody, rest), event(0, "start", F.col("role"), first))
    edited = F.array(event(2, "delta", nobody, rest), event(1, "edit", nobody, first), event(0, "start", F.col("role"), F.lit("a draft")))
    again = F.array(
        event(4, "delta", nobody, rest), event(3, "regenerate", who, first), event(2, "start", F.lit("user"), F.lit("that is not it"), later=1), event(1, "delta", nobody, F.lit(" answer")),
        event(0, "start", F.col("role"), F.lit("a wrong")),
    )
    course = F.when(F.col("turn") % 3 == 1, edited).when(F.col("turn") % 3 == 2, again).otherwise(plain)
    return c.select("conv_id", F.inline(course)).select(*EVENTS)
