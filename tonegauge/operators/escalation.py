"""What repetition across a thread adds: follow-up wording, verified restatements, shrinking intervals, silence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from .force import collect
from .surface import EVIDENCE, evidence, evidence_id


def anchor(masked: Column, clause_start: Column, clause_end: Column) -> Column:
    """struct<start, end>: the first word left in the request's sentence, else in the message; null without one."""

    def word(text: Column, shift: Column) -> Column:
        return T.let(T.first_match(text, "[A-Za-z0-9]+"), lambda m: F.when(m.isNotNull(), F.struct((m["start"] + shift).alias("start"), (m["end"] + shift).alias("end"))))

    return F.coalesce(word(T.piece(masked, clause_start, clause_end), clause_start), word(masked, F.lit(0)))


def follow_up(units: str) -> Column:
    """The strongest follow-up wording, the first collected of equals; null without one."""
    found = collect(units, rules.FOLLOW_UP, rules.SCALE["dependency"])
    return F.array_min(F.transform(found, lambda m: F.struct((-m["value"]).alias("neg"), m["idx"].alias("idx"), m["start"].alias("start"), m["end"].alias("end"), m["raw"].alias("raw"))))


def restated(earlier: Column) -> Column:
    second, third, more = rules.RESTATED
    return F.when(earlier >= 3, more).when(earlier == 2, third).when(earlier == 1, second).otherwise(0.0)


def escalation(message: Column, masked: Column, found: Column, spot: Column, clause_start: Column, clause_end: Column, earlier: Column, accelerating: Column, unanswered: Column) -> Column:
    """Evidence rows of one event; their sum is bounded, and a bound shrinks all of them. found: the follow-up wording."""
    part = "array<struct<category:string,subcategory:string,value:double,start:int,end:int,raw:double,capped:boolean>>"
    none = F.array().cast(part)

    def one(category: str, subcategory: str, value: Column, start: Column, end: Column, raw: Column, capped: Column) -> Column:
        return F.array(
            F.struct(
                F.lit(category).alias("category"), F.lit(subcategory).alias("subcategory"), value.alias("value"), start.alias("start"), end.alias("end"), raw.alias("raw"), capped.alias("capped")
            )
        ).cast(part)

    def threaded(subcategory: str, value: Column, holds: Column) -> Column:
        return F.when(holds & spot.isNotNull(), one("escalation", subcategory, value, spot["start"], spot["end"], value, F.lit(False))).otherwise(none)

    wording = T.let(
        found,
        lambda f: F.when(
            f.isNotNull(),
            one("dependency", "follow_up", F.least(F.lit(rules.FOLLOW_UP_CAP), -f["neg"]), f["start"], f["end"], f["raw"], -f["neg"] > rules.FOLLOW_UP_CAP + rules.EPSILON),
        ).otherwise(none),
    )
    parts = F.concat(
        wording,
        threaded("verified_restatement", restated(earlier), earlier > 0),
        threaded("accelerating_intervals", F.lit(rules.ACCELERATING), accelerating),
        threaded("unanswered", F.lit(rules.UNANSWERED), unanswered),
    )
    event = evidence_id(message, "force", F.lit("escalation"), F.lit("component"), clause_start, clause_end)

    def rows(ps: Column) -> Column:
        total = F.aggregate(ps, F.lit(0.0), lambda acc, p: acc + p["value"])

        def bounded(sum_: Column) -> Column:
            most = F.least(F.lit(rules.ESCALATION_CAP), sum_)
            capped = (sum_ - most) > rules.EPSILON
            factor = F.when(capped & (sum_ != 0), F.try_divide(most, sum_)).otherwise(1.0)
            return F.transform(
                ps,
                lambda p: evidence(
                    message, "force", p["category"], p["subcategory"], T.piece(masked, p["start"], p["end"]), p["start"], p["end"], p["raw"], p["value"] * factor, capped | p["capped"], event=event
                ),
            )

        return F.when(F.size(ps) > 0, T.let(total, bounded)).otherwise(F.array().cast(EVIDENCE))

    return T.let(parts, rows)
