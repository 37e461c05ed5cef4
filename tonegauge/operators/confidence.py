"""How far a result can be relied on, and why."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .surface import clamp

# Terms and wording.
BASE, EXACT, ADDRESSEE, CLEAN, OVERLAP, ONE_EVENT, MORE_EVENTS, UNRESOLVED, ASSUMED, MOST = 0.4, 0.2, 0.1, 0.15, 0.2, 0.05, 0.1, 0.15, 0.1, 0.95
REASONS = {
    "exact": "Exact lexical head-act match", "addressee": "Resolvable addressee", "no_addressee": "No resolvable addressee", "overlap": "Surface/force partition overlaps",
    "clean": "Surface/force partition is clean", "unresolved": "Unresolved temporal instant", "assumed": "Explicit temporal/calendar assumption applied",
}
FLAGS = {"overlap": "surface_force_overlap", "unresolved": "unresolved_temporal", "assumed": "temporal_assumption"}


def partition_overlap(surface: Column, force: Column) -> Column:
    """Whether a character counts on both sides."""
    return F.exists(force, lambda f: F.exists(surface, lambda s: (f["span"]["start"] < s["span"]["end"]) & (s["span"]["start"] < f["span"]["end"])))


def independent_events(force: Column) -> Column:
    return F.size(F.array_distinct(F.transform(F.filter(force, lambda e: e["weight"] > 0), lambda e: e["event_id"])))


def confidence(recipients: Column, surface: Column, force: Column) -> Column:
    """struct<value, reasons, ambiguity_flags>; every head act here is an exact match."""
    overlap, events = partition_overlap(surface, force), independent_events(force)
    unresolved = F.exists(force, lambda e: (e["subcategory"] == "temporal.proximity") & (e["weight"] == 0) & ~e["resolved"])
    assumed = F.exists(force, lambda e: (e["category"] == "temporal") & e["assumed"])
    addressed = F.size(recipients) > 0
    value = F.lit(BASE) + F.lit(EXACT)
    value = value + F.when(addressed, F.lit(ADDRESSEE)).otherwise(0.0)
    value = value + F.when(overlap, F.lit(-OVERLAP)).otherwise(F.lit(CLEAN))
    value = value + F.when(events >= 2, F.lit(MORE_EVENTS)).when(events == 1, F.lit(ONE_EVENT)).otherwise(0.0)
    value = value + F.when(unresolved, F.lit(-UNRESOLVED)).otherwise(0.0)
    value = value + F.when(assumed, F.lit(-ASSUMED)).otherwise(0.0)
    said = F.concat(events.cast("string"), F.when(events == 1, F.lit(" independent force event")).otherwise(F.lit(" independent force events")))
    reasons = F.array(
        F.lit(REASONS["exact"]), F.when(addressed, REASONS["addressee"]).otherwise(REASONS["no_addressee"]), F.when(overlap, REASONS["overlap"]).otherwise(REASONS["clean"]),
        said, F.when(unresolved, REASONS["unresolved"]), F.when(assumed, REASONS["assumed"]),
    )
    flags = F.array(F.when(overlap, FLAGS["overlap"]), F.when(unresolved, FLAGS["unresolved"]), F.when(assumed, FLAGS["assumed"]))
    tidy = lambda a: F.array_sort(F.array_distinct(F.array_compact(a)))
    return F.struct(clamp(value, 0.0, MOST).alias("value"), tidy(reasons).alias("reasons"), tidy(flags).alias("ambiguity_flags"))
