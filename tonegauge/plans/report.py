"""Reports over results: evidence overlay, formatted rows, checks that every release must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formats, rules
from ..functions import text as T
from .store import stored

PHRASES = ["by friday", "tomorrow", "day after tomorrow", "this week", "next week", "end of week", "end of the month", "end of quarter", "by noon", "by 5pm", "within 3 days", "in 20 minutes", "by the 15th", "2026-09-30", "sometime", "next monday", "thursday at 9am", "sep 3"]
#: Copy to hold against the guard, and whether it may pass.
GUARD_SAMPLES = [
    ("The wording is softer than the deadline.", True), ("The sender meant to press you.", False), ("They really wanted an answer.", False), ("You intended it as a hint.", False),
    ("A reader is likely to overlook the date.", True), ("The reader under-weights the date.", False), ("Readers will overlook it.", False), ("This phrasing tends to be read as optional.", True),
]


def swept(texts: DataFrame, key: str) -> DataFrame:
    """key, start, end, covering, evidence: parts of texts (key, size, spans: array<struct<start, end, id>>) between the
    bounds of spans, with the number of spans that cover each and their ids, in the spans' order.

    A sweep: a span adds one where it begins and takes it off where it ends, and a running sum over a text's bounds is
    what covers the part from each bound to the next. Spans find the numbers of their bounds by an equi-join and give
    their ids to the parts between. Spans lie within the text; empty ones cover nothing; of an empty text there is no part.
    """
    spans = texts.select(key, F.posexplode("spans").alias("place", "s")).select(key, "place", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.id").alias("id"))
    ends = F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("step")))
    borders = texts.select(key, F.explode(F.array(F.lit(0), F.col("size"))).alias("at"), F.lit(0).alias("step"))
    steps = spans.select(key, F.inline(ends)).unionByName(borders).groupBy(key, "at").agg(F.sum("step").alias("step"))
    along = Window.partitionBy(key).orderBy("at")
    bounds = steps.select(key, "at", F.lead("at").over(along).alias("next"), F.sum("step").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("covering"), F.row_number().over(along).alias("number"))
    first = bounds.select(key, F.col("at").alias("start"), F.col("number").alias("first"))
    last = bounds.select(key, F.col("at").alias("end"), F.col("number").alias("last"))
    covered = spans.where("start < end").join(first, [key, "start"]).join(last, [key, "end"]).select(key, "place", "id", F.explode(F.sequence(F.col("first"), F.col("last") - 1)).alias("number"))
    ids = covered.groupBy(key, "number").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("ids"))
    parts = bounds.where("next IS NOT NULL").join(ids, [key, "number"], "left")
    evidence = F.coalesce(F.transform("ids", lambda x: x["id"]), F.array().cast("array<string>"))
    return parts.select(key, F.col("at").alias("start"), F.col("next").alias("end"), F.col("covering").cast("int").alias("covering"), evidence.alias("evidence"))


def overlay(rows: DataFrame) -> DataFrame:
    """Parts of each text between the bounds of its evidence: start, end, part, and the rows that cover it."""
    every = F.concat("surface_evidence", "force_evidence")
    spans = F.transform(every, lambda e: F.struct(e["span"]["start"].alias("start"), e["span"]["end"].alias("end"), e["id"].alias("id")))
    stable = T.stable(F.coalesce("text", F.lit("")))
    d = stored(rows.select("msg_id", "text", stable.alias("stable"), F.length(stable).alias("size"), spans.alias("spans")))
    parts = swept(d, "msg_id").join(d.select("msg_id", "text", "stable"), "msg_id")
    return parts.select("msg_id", "start", "end", T.original_slice(F.col("text"), F.col("stable"), F.col("start"), F.col("end")).alias("part"), "covering", "evidence")


def formatted_columns() -> list[Column]:
    return [
        formats.score_text(F.col("surface")).alias("surface_text"), formats.score_text(F.col("force")).alias("force_text"), formats.signed_gap_text(F.col("gap")).alias("gap_text"),
        formats.percent_text(F.col("confidence.value")).alias("confidence_text"), formats.band_label(F.col("band")).alias("band_text"), formats.suppression_text(F.col("suppressed")).alias("suppression_text"),
        F.coalesce(formats.baseline_only(F.col("force"), F.col("force_evidence")), F.lit(False)).alias("baseline_only"),
    ]


def _sum(rows: str) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda acc, e: acc + e["weight"])


def release_metrics(results: DataFrame, messages: DataFrame) -> DataFrame:
    """check, rows, failures: invariants of every scored message."""
    d = results.where("suppressed IS NULL").join(messages.select("msg_id", "text"), "msg_id").withColumn("stable", T.stable(F.col("text")))
    faithful = F.forall("surface_evidence", lambda e: e["trigger"] == T.original_slice(F.col("text"), F.col("stable"), e["span"]["start"], e["span"]["end"]))
    quoted = F.forall("force_evidence", lambda e: e["trigger"] == T.piece(F.col("stable"), e["span"]["start"], e["span"]["end"]))
    checks = {
        "surface trace adds up": F.abs(_sum("surface_evidence") - F.col("surface")) < 1e-6,
        "force trace adds up": F.abs(_sum("force_evidence") + rules.FORCE_BASELINE - F.col("force")) < 1e-6,
        "surface triggers are the text's": faithful,
        "force triggers are the text's": quoted,
        "scores in range": F.col("surface").between(0, 10) & F.col("force").between(0, 10),
        "gap is the difference": F.abs(F.col("gap") - formats.gap(F.col("force"), F.col("surface"))) < 1e-9,
        "confidence in range": F.col("confidence.value").between(0, 0.95),
        "sides share no character": ~F.exists("force_evidence", lambda f: F.exists("surface_evidence", lambda s: (f["span"]["start"] < s["span"]["end"]) & (s["span"]["start"] < f["span"]["end"]))),
    }
    one = d.agg(F.count("*").alias("rows"), *[F.sum((~ok).cast("int")).alias(str(i)) for i, ok in enumerate(checks.values())])
    names = F.array(*[F.struct(F.lit(name).alias("check"), F.col(str(i)).alias("failures")) for i, name in enumerate(checks)])
    return one.select("rows", F.explode(names).alias("c")).select(F.col("c.check").alias("check"), "rows", F.coalesce("c.failures", F.lit(0)).alias("failures"))


def compare_pairs(results: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, family and scores of both sides of pairs (pair_id, family, a_thread, b_thread): the last message of each thread."""
    last = results.groupBy("thread_id").agg(F.max_by(F.struct("surface", "force", "gap", "suppressed"), "ord").alias("r"))
    a, b = last.select(F.col("thread_id").alias("a_thread"), F.col("r").alias("a")), last.select(F.col("thread_id").alias("b_thread"), F.col("r").alias("b"))
    sides = [F.col(f"{end}.{c}").alias(f"{c}_{end}") for end in "ab" for c in ("surface", "force", "gap")]
    return pairs.join(a, "a_thread").join(b, "b_thread").select("pair_id", "family", *sides)


# Tolerances and thresholds of the checks.
TOLERANCE, LEAST_DELTA, DIRECTION_RATE = 1e-9, 1.0, 0.95


def pair_checks(compared: DataFrame, surface_families: list[str]) -> DataFrame:
    """Adds to compared pairs: whether what should stay stayed, what should move moved by enough, and the gap the right way
    (more surface lowers it, more force raises it). Null where a side has no score."""
    wording = F.col("family").isin(surface_families)
    surface, force = F.abs(F.col("surface_a") - F.col("surface_b")), F.abs(F.col("force_a") - F.col("force_b"))
    return compared.select(
        "*", F.when(wording, force).otherwise(surface).__le__(TOLERANCE).alias("stays"), F.when(wording, surface).otherwise(force).__ge__(LEAST_DELTA - TOLERANCE).alias("moves"),
        (F.col("gap_a") < F.col("gap_b")).alias("direction"),
    )


def summary(checks: DataFrame) -> DataFrame:
    """check, name, status, held, applicable, report of rows (check, name, ok, share needed, partial)."""
    counts = checks.groupBy("check", "name", "need", "partial").agg(F.count("ok").alias("applicable"), F.sum(F.col("ok").cast("long")).alias("held"))
    enough = (F.col("applicable") > 0) & (F.col("held") >= F.col("need") * F.col("applicable"))
    status = F.when(enough & F.col("partial"), "PARTIAL").when(enough, "PASS").otherwise("FAIL")
    counts = counts.select("check", "name", status.alias("status"), F.coalesce("held", F.lit(0)).cast("long").alias("held"), "applicable")
    line = F.concat_ws("  ", F.lpad(F.col("check").cast("string"), 2, " "), F.rpad("status", 7, " "), F.col("name"), F.concat(F.col("held").cast("string"), F.lit("/"), F.col("applicable").cast("string")))
    return counts.withColumn("report", line)


def status_counts(report: DataFrame) -> DataFrame:
    """The report's last line."""
    names = ["PASS", "PARTIAL", "FAIL"]
    one = report.agg(*[F.sum((F.col("status") == n).cast("long")).alias(n) for n in names])
    return one.select(F.concat_ws(", ", *[F.concat(F.col(n).cast("string"), F.lit(f" {n}")) for n in names]).alias("report"))


def band_cube(results: DataFrame) -> DataFrame:
    """An extension: messages by thread and band, with all subtotals."""
    return results.cube("thread_id", "band").agg(F.count("*").alias("messages"))
