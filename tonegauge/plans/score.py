"""Scores of every message of every thread.

Head act, surface, masked text and what force finds in it depend on a text alone, and
on whether it is addressed to anybody. They are worked out once for each text
(``of_texts``), in expressions without a shuffle, however many messages say it; texts
are dealt out before it. Their table is joined twice: messages take a text's number,
signature and completion, and after repetition (``mentions``: rows are written to a
table, and small records of them, sender, signature, whether something is done, time,
meet in windows and joins) what is left: deadlines at the message's time, sums, ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, formats, rules
from ..functions import text as T
from ..operators import confidence as C
from ..operators import escalation, force, head_act, surface
from . import mentions as M
from .store import stored

#: Characters of texts, each counted with so many more for its rows, up to which their table is broadcast; beyond, joins shuffle.
BROADCAST_CHARS, ROWS_CHARS = 8_000_000, 2_000

MESSAGES = "thread_id string, ord long, msg_id string, sender_id string, recipient_ids array<string>, ts string, text string"


def _settled(value: Column) -> Column:
    """The value itself, in a form that filters aren't pushed below: the optimizer would put a copy of all the
    expressions it is made of into the filter, and again for each step they go through."""
    return F.when(F.spark_partition_id() >= 0, value)


def _parts(d: DataFrame) -> int:
    return int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def defined(messages: DataFrame) -> DataFrame:
    """The columns the plan reads, nulls defined: a null text is empty, null recipients are nobody."""
    return messages.select(
        "thread_id", F.col("ord").cast("long").alias("ord"), "msg_id", F.coalesce("sender_id", F.lit("")).alias("sender_id"),
        F.coalesce("recipient_ids", F.array().cast("array<string>")).alias("recipient_ids"), "ts", F.coalesce("text", F.lit("")).alias("text"),
    )


def prepared(messages: DataFrame) -> DataFrame:
    """Defined messages, dealt out, with the stable form of their texts."""
    return defined(messages.repartition(_parts(messages), "thread_id", "ord")).withColumn("stable", T.stable(F.col("text")))


def with_head_act(messages: DataFrame) -> DataFrame:
    """Adds sentences, head (struct or null) and suppressed (why a message has no scores)."""
    found = messages.withColumn("sentences", T.sentences(F.col("stable"))).withColumn("clauses", head_act.clauses(F.col("stable"), F.col("sentences")))
    found = found.withColumn("matches", head_act.matches("clauses"))
    found = found.withColumn("head", _settled(head_act.head_act(F.col("sentences"), F.col("clauses"), F.col("matches")))).drop("matches")
    reason = F.when(F.col("head").isNull(), "no_head_act").when(F.size("recipient_ids") == 0, "unresolved_addressee")
    return found.withColumn("suppressed", reason)


def with_surface(found: DataFrame) -> DataFrame:
    """Adds contributions, surface and surface_evidence to messages that are scored."""
    scored = F.col("suppressed").isNull()
    head, stable = F.col("head"), F.col("stable")
    after = F.get(F.col("sentences"), head["sentence"] + 1)
    none = F.array().cast(f"array<{surface._SPAN}>")
    d = found.withColumn("_clause", F.when(scored, F.get("clauses", head["sentence"]))).withColumn("_next", F.when(scored, F.get("clauses", head["sentence"] + 1))).drop("clauses")
    d = d.withColumn("_mods", surface.modifiers("_clause")).withColumn("_next_mods", surface.modifiers("_next"))
    near = surface.shifted(surface.attached(F.col("_clause"), F.col("_mods"), head["d_start"], head["d_end"], head["d_ord"]), head["start"])
    beyond = F.when(after.isNotNull(), surface.shifted(surface.following(F.col("_next"), F.col("_next_mods")), after["start"])).otherwise(none)
    weights = F.array(*[F.lit(next(r.weight for r in rules.DIRECTNESS if rules.level_of(r) == level)) for level in range(1, len(rules.LEVELS) + 1)])
    d = d.withColumn("base", F.when(scored, F.get(weights, head["level"] - 1) * rules.SCALE["directness"]))
    d = d.withColumn("contributions", F.when(scored, F.concat(near, beyond))).drop("_clause", "_next", "_mods", "_next_mods")
    d = d.withColumn("_surface", F.when(scored, surface.surface_score(F.col("base"), F.col("contributions"))))
    rows = surface.surface_evidence(F.col("msg_id"), F.col("text"), stable, head, F.col("base"), F.col("contributions"), F.col("_surface"))
    d = d.withColumn("surface_evidence", _settled(F.when(scored, rows).otherwise(F.array().cast(surface.EVIDENCE))))
    return d.withColumn("surface", F.col("_surface")["surface"]).drop("_surface")


def with_mask(scored: DataFrame) -> DataFrame:
    """Adds masked (surface evidence and closed quotations blanked), signature and completion.

    This is the border between the sides: what follows may use the masked text only.
    """
    spans = F.concat(F.transform("surface_evidence", lambda e: F.struct(e["span"]["start"].alias("start"), e["span"]["end"].alias("end"))), T.quoted_spans(F.col("stable")))
    head = F.col("head")
    words = F.when(F.col("suppressed").isNull(), T.signature(T.piece(F.col("stable"), head["start"], head["end"]))).otherwise(F.array().cast("array<string>"))
    d = scored.withColumn("masked", T.blank(F.col("stable"), spans)).withColumn("signature", words)
    return d.withColumn("completion", T.has_completion(F.col("masked")))


def with_reasons(masked: DataFrame) -> DataFrame:
    """Adds what force finds in the masked texts that are scored, whenever they were sent: due (deadline phrases),
    consequence and dependency (evidence), follow_up, spot."""
    scored = F.col("suppressed").isNull()
    text, message, head = F.col("masked"), F.col("msg_id"), F.col("head")
    none = F.array().cast(surface.EVIDENCE)
    d = masked.withColumn("units", F.when(scored, force.clauses(text, T.sentences(text))))
    d = d.withColumn("due", F.when(scored, force.temporal_candidates(text, "units"))).withColumn("spot", F.when(scored, escalation.anchor(text, head["start"], head["end"])))
    d = d.withColumn("follow_up", F.when(scored, escalation.follow_up("units")))
    d = d.withColumn("consequence", F.when(scored, force.consequence(message, text, "units", head["start"], head["end"])).otherwise(none))
    return d.withColumn("dependency", F.when(scored, force.dependency(message, text, "units")).otherwise(none)).drop("units", "sentences")


def of_texts(messages: DataFrame) -> DataFrame:
    """text, addressed, number, and all that is the same for every message with the text, in a table: evidence as of a
    message whose id is empty."""
    each = messages.select("text", (F.size("recipient_ids") > 0).alias("addressed")).distinct().repartition(_parts(messages), "text")
    somebody = F.when(F.col("addressed"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    d = each.select("text", "addressed", F.lit("").alias("msg_id"), somebody.alias("recipient_ids"), T.stable(F.col("text")).alias("stable"))
    d = with_reasons(with_mask(with_surface(with_head_act(d)))).drop("msg_id", "recipient_ids", "stable", "contributions", "base")
    return stored(d.withColumn("number", F.monotonically_increasing_id()))


def _meet(rows: DataFrame, texts: DataFrame, few: bool, *keys: str) -> DataFrame:
    return rows.join(F.broadcast(texts) if few else texts.hint("merge"), list(keys))


def _of_message(rows: str) -> Column:
    """A text's evidence with the message's id."""
    own = lambda e, name: F.concat("msg_id", e[name])
    return F.transform(rows, lambda e: e.withField("id", own(e, "id")).withField("event_id", own(e, "event_id")).withField("message_id", F.col("msg_id")))


def with_force(found: DataFrame, business_day_end: str | None) -> DataFrame:
    """Adds force and force_evidence to messages that are scored."""
    scored = F.col("suppressed").isNull()
    text, head, message = F.col("masked"), F.col("head"), F.lit("")
    local = F.col("ms") + F.col("offset").cast("long") * dates.MINUTE
    d = found.withColumn("deadline", F.when(scored, force.temporal_winner(F.col("due"), local, business_day_end)))
    d = d.withColumn("unanswered", M.unanswered(F.col("earlier"), F.col("last_ms"), F.col("reply_ms"))).withColumn("accelerating", M.accelerating(F.col("earlier"), F.col("ms"), F.col("last_ms"), F.col("before_ms")))
    parts = [
        force.temporal(message, text, F.col("deadline"), local, F.col("offset"), business_day_end),
        F.col("consequence"),
        F.col("dependency"),
        escalation.escalation(message, text, F.col("follow_up"), F.col("spot"), head["start"], head["end"], F.col("earlier"), F.col("accelerating"), F.col("unanswered")),
    ]
    d = d.withColumn("_parts", F.when(scored, F.concat(*parts))).withColumn("_force", F.when(scored, force.force_score(F.col("_parts"))))
    d = d.withColumn("force", F.col("_force")["force"]).withColumn("_rows", F.coalesce(F.col("_force")["evidence"], F.array().cast(surface.EVIDENCE)))
    return d.withColumn("force_evidence", _settled(_of_message("_rows"))).withColumn("surface_evidence", _settled(_of_message("surface_evidence"))).drop("_parts", "_force", "_rows")


def repeated(messages: DataFrame) -> DataFrame:
    """Messages with all that is known of their texts, their instants and earlier mentions."""
    d = defined(messages).withColumn("addressed", F.size("recipient_ids") > 0)
    texts = of_texts(d)
    few = texts.agg(F.coalesce(F.sum(F.length("text") + ROWS_CHARS), F.lit(0))).first()[0] <= BROADCAST_CHARS
    said = _meet(d, texts.select("text", "addressed", "number", "signature", "completion"), few, "text", "addressed")
    said = said.drop("text", "addressed").withColumn("ms", dates.epoch_ms(F.col("ts"))).withColumn("offset", dates.offset_minutes(F.col("ts")))
    return _meet(M.with_mentions(said), texts.drop("addressed", "signature", "completion"), few, "number")


def stages(messages: DataFrame, business_day_end: str | None = None) -> DataFrame:
    """All intermediate columns."""
    return with_force(repeated(messages), business_day_end)


def result(d: DataFrame) -> DataFrame:
    scored = F.col("suppressed").isNull()
    head = F.when(F.col("head").isNotNull(), F.struct(F.struct(F.col("head")["start"].alias("start"), F.col("head")["end"].alias("end")).alias("span"), F.col("head")["level"].alias("level"), F.col("head")["strategy"].alias("strategy")))
    found: Column = C.confidence(F.col("recipient_ids"), F.col("surface_evidence"), F.col("force_evidence"))
    d = d.withColumn("gap", F.when(scored, formats.gap(F.col("force"), F.col("surface"))))
    return d.select(
        "thread_id", "ord", "msg_id", head.alias("head_act"), "surface", "force", "gap", formats.band(F.col("gap")).alias("band"),
        F.when(scored, found).alias("confidence"), "surface_evidence", "force_evidence", "suppressed",
    )


def score_threads(messages: DataFrame, business_day_end: str | None = None) -> DataFrame:
    """thread_id, ord, msg_id, head_act, surface, force, gap, band, confidence, both evidence traces, suppressed.

    messages: thread_id, ord (position in the thread), msg_id, sender_id, recipient_ids, ts (ISO text with its
    offset), text. Every input row has one result row.
    """
    return result(stages(messages, business_day_end))
