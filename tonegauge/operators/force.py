"""What makes action expected: deadlines, consequences, dependencies. Sees masked texts only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dates, rules
from ..functions import text as T
from ..functions.needed import hits_sql, needed
from .surface import EVIDENCE, clamp, evidence, evidence_id

_EOD_GAP = "|".join(f"{d}day[{T.SPACE}]{{0,{12 - len(d) - 3}}}" for d in "mon tues wednes thurs fri satur sun".split())
_TODAY = f"(?i){T.BORDER}today{T.BORDER}"
_EOD = f"(?i){T.BORDER}(?<!{_EOD_GAP})(?:EOD|COB){T.BORDER}"


def clauses(text: Column, sentences: Column) -> Column:
    """array<struct<start, clause>> of a masked text."""
    return F.transform(sentences, lambda s: F.struct(s["start"].alias("start"), T.piece(text, s["start"], s["end"]).alias("clause")))


def collect(units: str, table: list[rules.Rule], scale: float) -> Column:
    """First match of each rule in each sentence of a column of clauses; idx keeps the order of collection."""
    rows = [(T.java(r.pattern, r.case), needed(r.pattern), {"ord": str(r.ord), "raw": f"{r.weight}D", "value": f"{r.weight}D * {scale}D", "subcategory": f"'{r.subcategory}'"}) for r in table]
    found = hits_sql(
        "u.clause", rows, idx="i * 1000 + {ord}", start="u.start + {start}", end="u.start + {end}", raw="{raw}", value="{value}", subcategory="{subcategory}", sentence="i", at="{start}",
    )
    return F.expr(f"flatten(transform({units}, (u, i) -> array_sort({found})))")


_MATCH = "struct<idx:int,start:int,end:int,raw:double,value:double,subcategory:string,sentence:int,at:int>"


def without_overlaps(matches: Column) -> Column:
    """Greedy: by value, length, start and order; whatever overlaps one already kept goes. In order of collection."""
    ranked = F.array_sort(
        F.transform(matches, lambda m: F.struct((-m["value"]).alias("a"), (m["start"] - m["end"]).alias("b"), m["start"].alias("c"), m["idx"].alias("d"), m.alias("m")))
    )
    kept = F.aggregate(
        ranked,
        F.array().cast(f"array<{_MATCH}>"),
        lambda acc, r: F.when(F.exists(acc, lambda k: (r["m"]["start"] < k["end"]) & (r["m"]["end"] > k["start"])), acc).otherwise(F.concat(acc, F.array(r["m"]))),
    )
    return F.array_sort(kept)


def strongest_of_events(matches: Column, key: Callable[[Column], Column]) -> Column:
    """Of matches with equal keys the one with the largest value, then length, then the earliest; null keys don't occur."""

    def beats(k: Column, m: Column) -> Column:
        rank = lambda x: F.struct(x["value"].alias("a"), (x["end"] - x["start"]).alias("b"), (-x["start"]).alias("c"), (-x["idx"]).alias("d"))
        return (key(k) == key(m)) & (rank(k) > rank(m))

    return F.filter(matches, lambda m: ~F.exists(matches, lambda k: beats(k, m)))


def with_unit(matches: Column, units: Column) -> Column:
    """Adds the number of the local event unit (0 on a delimiter)."""
    return F.transform(matches, lambda m: m.withField("unit", F.coalesce(T.index_at(T.event_units(F.get(units, m["sentence"])["clause"]), m["at"]), F.lit(0))))


def _unit_key(m: Column) -> Column:
    return F.concat(F.lit("sentence:"), m["sentence"].cast("string"), F.lit(":unit:"), m["unit"].cast("string"))


def consequence(message: Column, text: Column, units: str, clause_start: Column, clause_end: Column) -> Column:
    """Stated outcomes; sanction words that are part of what is asked for don't count."""
    raw = collect(units, rules.CONSEQUENCE, rules.SCALE["consequence"])
    open_ = F.filter(raw, lambda m: ~((m["subcategory"] == "sanction") & (m["start"] >= clause_start) & (m["end"] <= clause_end)))
    return _component(message, text, F.col(units), open_, "consequence", _unit_key)


def dependency(message: Column, text: Column, units: str) -> Column:
    """Who or what waits, and who is accountable."""
    table = [r for r in rules.DEPENDENCY if r.subcategory != "follow_up"]
    raw = collect(units, table, rules.SCALE["dependency"])
    return _component(message, text, F.col(units), raw, "dependency", lambda m: F.concat(m["subcategory"], F.lit(":"), _unit_key(m)))


def _component(message: Column, text: Column, units: Column, matches: Column, category: str, key: Callable[[Column], Column]) -> Column:
    def built(winners: Column) -> Column:
        return F.transform(
            winners,
            lambda m: evidence(
                message, "force", F.lit(category), m["subcategory"], T.piece(text, m["start"], m["end"]), m["start"], m["end"], m["raw"], m["value"], F.lit(False),
                event=evidence_id(message, "force", F.lit(category), key(m), m["start"], m["end"]),
            ),
        )

    rows = T.let(with_unit(without_overlaps(matches), units), lambda ms: built(strongest_of_events(ms, key)))
    return F.when(F.size(matches) > 0, rows).otherwise(F.array().cast(EVIDENCE))


def temporal_candidates(text: Column, units: str) -> Column:
    """struct<own, today, end>: of the rules the highest rung, the earliest of it (null without one), and the first phrases
    whose rung goes by the hours left of the day."""
    rows = [(T.java(r.pattern, r.case), needed(r.pattern), {"neg": f"{-r.weight}D", "ord": str(r.ord), "subcategory": f"'{r.subcategory}'"}) for r in rules.TEMPORAL]
    found = hits_sql("u.clause", rows, neg="{neg}", start="u.start + {start}", idx="{ord}", end="u.start + {end}", subcategory="{subcategory}")
    own = F.array_min(F.expr(f"transform({units}, u -> array_min({found}))"))
    return F.struct(own.alias("own"), T.first_match(text, _TODAY).alias("today"), T.first_match(text, _EOD).alias("end"))


def temporal_winner(due: Column, local: Column, business_day_end: str | None) -> Column:
    """struct<neg, start, idx, end, subcategory>: the highest rung, the earliest of it; null without one."""
    hour, minute, _ = dates.business_end(business_day_end)
    left = (dates.at_clock(dates.day_of(local), hour, minute) - local) / 3_600_000
    rung = F.when(left > 6, 3.0).when(left >= 2, 4.0).otherwise(5.0)

    def dynamic(m: Column, subcategory: str, idx: int) -> Column:
        return F.when(m.isNotNull(), F.struct((-rung).alias("neg"), m["start"].alias("start"), F.lit(idx).alias("idx"), m["end"].alias("end"), F.lit(subcategory).alias("subcategory")))

    return F.array_min(F.array(due["own"], dynamic(due["today"], "today.dynamic", 1000), dynamic(due["end"], "eod_cob.dynamic", 1001)))


def temporal(message: Column, text: Column, winner: Column, local: Column, offset: Column, business_day_end: str | None) -> Column:
    """The winning deadline phrase and how near it is: two rows of one event, or none."""
    assumed_end = dates.business_end(business_day_end)[2]

    def rows(w: Column) -> Column:
        trigger = T.piece(text, w["start"], w["end"])

        def of(d: Column) -> Column:
            event = evidence_id(message, "force", F.lit("temporal"), w["subcategory"], w["start"], w["end"])
            hours = (d["at"] - local) / 3_600_000
            dynamic = w["subcategory"].isin("today.dynamic", "eod_cob.dynamic") & F.lit(assumed_end)
            raw = -w["neg"] + 0.0
            near = dates.proximity(hours)
            note = F.when(d["at"].isNotNull(), F.concat(F.lit("due "), dates.iso_text(d["at"], offset), F.format_string(", %.2f h after the message", hours))).otherwise(F.coalesce(d["reason"], F.lit("no instant can be named")))
            return F.array(
                evidence(message, "force", F.lit("temporal"), w["subcategory"], trigger, w["start"], w["end"], raw, raw * rules.SCALE["temporal"], F.lit(False), event, assumed=d["locale_assumed"] | dynamic),
                evidence(message, "force", F.lit("temporal"), F.lit("temporal.proximity"), trigger, w["start"], w["end"], near, near, F.lit(False), event, resolved=d["at"].isNotNull(), assumed=d["end_assumed"], note=note),
            )

        return F.when(w.isNotNull(), T.let(dates.resolve(trigger, w["subcategory"], local, business_day_end), of)).otherwise(F.array().cast(EVIDENCE))

    return T.let(winner, rows)


def force_score(rows: Column) -> Column:
    """struct<force, evidence>: where the score's bound cuts the sum, positive rows shrink in proportion."""
    total = F.aggregate(rows, F.lit(0.0), lambda acc, e: acc + e["weight"])

    def scored(sum_: Column) -> Column:
        def bounded(value: Column) -> Column:
            reach = value - rules.FORCE_BASELINE
            capped = F.abs(sum_ - reach) > rules.EPSILON
            factor = F.when(capped & (sum_ != 0), F.try_divide(reach, sum_)).otherwise(1.0)
            cut = F.transform(rows, lambda e: F.when(e["weight"] > 0, e.withField("weight", e["weight"] * factor).withField("capped", F.lit(True))).otherwise(e))
            return F.struct(value.alias("force"), F.when(capped, cut).otherwise(rows).alias("evidence"))

        return T.let(clamp(sum_ + rules.FORCE_BASELINE, rules.SCORE_MIN, rules.SCORE_MAX), bounded)

    return T.let(total, scored)
