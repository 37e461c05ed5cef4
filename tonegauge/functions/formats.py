"""Gap, bands and the wording of results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round1(x: Column) -> Column:
    """To one decimal, halves up (towards positive infinity)."""
    return F.floor(x * 10 + 0.5) / 10.0


def gap(force: Column, surface: Column) -> Column:
    return round1(round1(force) - round1(surface))


# Cut points and names of bands.
BANDS = ["under-phrased", "mildly-under-phrased", "aligned", "mildly-over-phrased", "over-phrased"]


def band(gap_: Column) -> Column:
    return F.when(gap_.isNull(), None).when(gap_ >= 3, BANDS[0]).when(gap_ >= 1, BANDS[1]).when(gap_ > -1, BANDS[2]).when(gap_ > -3, BANDS[3]).otherwise(BANDS[4])


def score_text(x: Column) -> Column:
    """One decimal; a dash where there is no score."""
    return F.when(x.isNull(), "—").otherwise(F.format_string("%.1f", x))


def signed_gap_text(x: Column) -> Column:
    return F.when(x.isNull(), "—").when(x > 0, F.format_string("+%.1f", x)).otherwise(F.format_string("%.1f", x))


def percent_text(x: Column) -> Column:
    return F.when(x.isNull(), "—").otherwise(F.concat(F.floor(x * 100 + 0.5).cast("string"), F.lit("%")))


def signed_weight_text(x: Column) -> Column:
    return F.when(x > 0, F.format_string("+%.2f", x)).otherwise(F.format_string("%.2f", x))


def band_label(band_: Column) -> Column:
    """As shown: first letter upper case, hyphens between words only."""
    return F.when(band_ == "aligned", "Aligned").otherwise(F.concat(F.upper(F.substring(band_, 1, 1)), F.regexp_replace(F.substring(band_, F.lit(2), F.length(band_)), "ly-", "ly ")))


def suppression_text(reason: Column) -> Column:
    return F.when(reason == "no_head_act", "No request found in this message.").when(reason == "unresolved_addressee", "A request, but nobody it is addressed to.")


def baseline_only(force: Column, rows: Column) -> Column:
    """Only the floor of the force score, and nothing that adds to it."""
    return (force == 3.0) & ~F.exists(rows, lambda e: e["weight"] > 0)


def baseline_note(gap_: Column, force: Column, rows: Column) -> Column:
    return F.when((gap_ > 0) & baseline_only(force, rows), "The gap comes from the wording alone: the thread gives no pressure beyond the request.")
