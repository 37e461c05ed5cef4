"""How forcefully a request is worded: directness, and the modifiers that attach to it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..functions.needed import hits_sql, needed

_MODIFIERS = [*rules.DOWNGRADERS, *rules.UPGRADERS]
_SPAN = "struct<ord:int,start:int,end:int,raw:double,scale:double,category:string,subcategory:string>"


def caps_pattern() -> str:
    """Words of capitals, but for the excluded tokens and the words of excluded phrases."""
    b, space = T.BORDER, f"[{T.SPACE}]"
    skip = f"(?!(?:{'|'.join(rules.CAPS_EXCLUDED)}){b})"
    for one, two in rules.CAPS_EXCLUDED_PHRASES:
        skip += f"(?!{one}{space}+(?i:{two}){b})(?!(?<={b}(?i:{one}){space}{{1,64}}){two}{b})"
    return f"{b}{skip}[A-Z]{{3,}}{b}"


def modifiers(clause: str) -> Column:
    """All modifier rules that match a column, each with its first match, less those nested in a longer one
    (of equal spans the first rule stays); in rule order. Null for a null clause."""
    rows = []
    for n, r in enumerate(_MODIFIERS):
        caps = r.subcategory == "emphatic_orthography" and "A-Z" in r.pattern
        pattern = caps_pattern() if caps else T.java(r.pattern, r.case)
        about = {"ord": str(n), "raw": f"{r.weight}D", "scale": f"{rules.SCALE[r.category]}D", "category": f"'{r.category}'", "subcategory": f"'{r.subcategory}'"}
        rows.append((pattern, () if caps else needed(r.pattern), about))
    fields = ["ord", "start", "end", "raw", "scale", "category", "subcategory"]
    every = F.array_sort(F.expr(hits_sql(clause, rows, **{f: f"{{{f}}}" for f in fields})))

    def outermost(all_: Column) -> Column:
        def nested(m: Column, k: Column) -> Column:
            inside = (m["start"] >= k["start"]) & (m["end"] <= k["end"])
            longer = (k["end"] - k["start"]) > (m["end"] - m["start"])
            return inside & (longer | ((k["start"] == m["start"]) & (k["end"] == m["end"]) & (k["ord"] < m["ord"])))

        return F.filter(all_, lambda m: ~F.exists(all_, lambda k: nested(m, k)))

    return F.when(F.col(clause).isNotNull(), T.let(every, outermost))


_HARMLESS = f"(?i){T.BORDER}(?:{'|'.join(rules.HARMLESS.split())}){T.BORDER}"
_NOTHING = f"\\A[{T.SPACE}.,!?;:—-]*\\z"


def standalone(unit: Column, spans: Column) -> Column:
    """Whether a unit is nothing but these matches, coordination, speech participants and punctuation."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("left"))
    in_order = F.array_sort(F.transform(spans, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))))
    rest = F.aggregate(
        in_order,
        start,
        lambda acc, m: F.struct(
            F.greatest(acc["at"], m["end"]).alias("at"),
            F.concat(acc["left"], F.substring(unit, acc["at"] + 1, F.greatest(m["start"] - acc["at"], F.lit(0)))).alias("left"),
        ),
        lambda acc: F.concat(acc["left"], F.substring(unit, acc["at"] + 1, F.length(unit))),
    )
    return (F.size(spans) > 0) & F.regexp_replace(rest, _HARMLESS, "").rlike(_NOTHING)


def attached(clause: Column, found: Column, d_start: Column, d_end: Column, d_ord: Column) -> Column:
    """Modifiers of the request's own sentence that count: those in the local segment of the directness match,
    and all of a segment that is nothing but modifiers; less what the match itself absorbs."""
    exempt = {rules.DIRECTNESS[i].ord: subs for i in range(len(rules.DIRECTNESS)) if (subs := rules.ABSORPTION_EXCEPTIONS.get(rules.DIRECTNESS[i].pattern))}

    def absorbed(m: Column) -> Column:
        free = m["subcategory"] == rules.NEVER_ABSORBED
        for number, subs in exempt.items():
            free = free | ((d_ord == number) & m["subcategory"].isin(subs))
        return (m["start"] >= d_start) & (m["end"] <= d_end) & ~free

    def by_segment(pieces: Column) -> Column:
        def chosen(all_: Column) -> Column:
            home = T.index_at(pieces, d_start)

            def of_segment(seg: Column, number: Column) -> Column:
                own = F.filter(all_, lambda m: (m["start"] >= seg["start"]) & (m["start"] < seg["end"]))
                moved = F.transform(own, lambda m: F.struct((m["start"] - seg["start"]).alias("start"), (m["end"] - seg["start"]).alias("end")))
                counts = F.coalesce(home == number, F.lit(False)) | standalone(T.piece(clause, seg["start"], seg["end"]), moved)
                return F.when(counts, own).otherwise(F.array().cast(f"array<{_SPAN}>"))

            return F.array_sort(F.filter(F.flatten(F.transform(F.filter(pieces, lambda p: ~p["hit"]), of_segment)), lambda m: ~absorbed(m)))

        return chosen(found)

    return T.let(T.local_segments(clause), by_segment)


def following(clause: Column, found: Column) -> Column:
    """Modifiers of the next sentence: all, if it is nothing but modifiers, else none."""
    return F.when(standalone(clause, found), found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def shifted(spans: Column, by: Column) -> Column:
    return F.transform(spans, lambda m: m.withField("start", m["start"] + by).withField("end", m["end"] + by))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def surface_score(base: Column, contributions: Column) -> Column:
    """struct<surface, factor, capped>: the score, and by what contributions shrink where a bound cuts their sum."""
    total = F.aggregate(contributions, F.lit(0.0), lambda acc, m: acc + m["raw"] * m["scale"])

    def scored(sum_: Column) -> Column:
        value = clamp(base + clamp(sum_, -rules.MODIFIER_CLAMP, rules.MODIFIER_CLAMP), rules.SCORE_MIN, rules.SCORE_MAX)

        def bounded(v: Column) -> Column:
            capped = F.abs(sum_ - (v - base)) > rules.EPSILON
            return F.struct(v.alias("surface"), F.when(capped & (sum_ != 0), F.try_divide(v - base, sum_)).otherwise(1.0).alias("factor"), capped.alias("capped"))

        return T.let(value, bounded)

    return T.let(total, scored)


def evidence_id(message: Column, scorer: str, category: Column, subcategory: Column, start: Column, end: Column) -> Column:
    return F.concat(message, F.lit(f":{scorer}:"), category, F.lit(":"), subcategory, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def evidence(message: Column, scorer: str, category: Column, subcategory: Column, trigger: Column, start: Column, end: Column, raw: Column, weight: Column, capped: Column, event: Column | None = None, resolved: Column | None = None, assumed: Column | None = None, note: Column | None = None) -> Column:
    """One row of the evidence trace."""
    own = evidence_id(message, scorer, category, subcategory, start, end)
    return F.struct(
        own.alias("id"), F.lit(scorer).alias("scorer"), category.alias("category"), subcategory.alias("subcategory"), trigger.alias("trigger"),
        F.struct(start.alias("start"), end.alias("end")).alias("span"), message.alias("message_id"), raw.alias("raw_weight"), weight.alias("weight"),
        capped.alias("capped"), (own if event is None else event).alias("event_id"), (F.lit(None).cast("string") if note is None else note).alias("note"),
        (F.lit(None).cast("boolean") if resolved is None else resolved).alias("resolved"), (F.lit(False) if assumed is None else assumed).alias("assumed"),
    )


EVIDENCE = (
    "array<struct<id:string,scorer:string,category:string,subcategory:string,trigger:string,span:struct<start:int,end:int>,message_id:string,"
    "raw_weight:double,weight:double,capped:boolean,event_id:string,note:string,resolved:boolean,assumed:boolean>>"
)


def surface_evidence(message: Column, text: Column, stable: Column, head: Column, base: Column, contributions: Column, score: Column) -> Column:
    """The directness match, then the contributions in order."""
    start, end = head["start"] + head["d_start"], head["start"] + head["d_end"]
    cut = lambda a, b: T.original_slice(text, stable, a, b)
    first = evidence(message, "surface", F.lit("directness"), head["strategy"], cut(start, end), start, end, base, base * rules.SCALE["directness"], F.lit(False))
    rest = F.transform(
        contributions,
        lambda m: evidence(message, "surface", m["category"], m["subcategory"], cut(m["start"], m["end"]), m["start"], m["end"], m["raw"], m["raw"] * m["scale"] * score["factor"], score["capped"]),
    )
    return F.concat(F.array(first), rest)
