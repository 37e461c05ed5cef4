"""Instants with their own offset, and the deadline a phrase names.

An instant is two columns: milliseconds since the epoch and the offset in minutes.
Wall-clock arithmetic works on ``local`` milliseconds (epoch plus offset) as whole
days and a rest, so nothing depends on the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from .text import let

DAY, MINUTE = 86_400_000, 60_000
# Names in the order they are looked for.
WEEKDAYS = [
    ["sunday", "sun"], ["monday", "mon"], ["tuesday", "tues", "tue"], ["wednesday", "wednes", "wed"], ["thursday", "thurs", "thu"], ["friday", "fri"], ["saturday", "satur", "sat"],
]
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
WORD_NUMBERS = {"a few": 3, "two": 2, "three": 3}
DAY_END = (23, 59)


def offset_minutes(iso: Column) -> Column:
    sign = F.when(F.regexp_extract(iso, r"([+-])(\d{2}):(\d{2})$", 1) == "-", -1).otherwise(1)
    size = F.regexp_extract(iso, r"([+-])(\d{2}):(\d{2})$", 2).try_cast("int") * 60 + F.regexp_extract(iso, r"([+-])(\d{2}):(\d{2})$", 3).try_cast("int")
    return F.when(iso.endswith("Z"), 0).otherwise(F.coalesce(sign * size, F.lit(0))).cast("int")


def epoch_ms(iso: Column) -> Column:
    """Milliseconds since the epoch; an instant without offset is UTC; null if it isn't one."""
    zoned = F.when(iso.rlike(r"(Z|[+-]\d{2}:\d{2})$"), iso).otherwise(F.concat(iso, F.lit("Z")))
    return F.unix_millis(F.try_to_timestamp(zoned))


def table_ms(events: DataFrame, name: str, nearest: bool = False) -> Column:
    """Milliseconds since the epoch of a table's time column. A time without a zone is read as UTC, whatever the
    session's zone is, and one with a zone is an instant already. nearest: to the nearest, as DuckDB's epoch_ms has
    them, so 59.9995 s is the next minute; else cut."""
    ts = F.col(name) + F.expr("INTERVAL '0.0005' SECOND") if nearest else F.col(name)
    if not isinstance(events.schema[name].dataType, TimestampNTZType):
        return F.unix_millis(ts.cast("timestamp"))
    clock = F.hour(ts) * 3_600_000 + F.minute(ts) * MINUTE + F.floor(F.date_part(F.lit("SECOND"), ts) * 1000)
    return F.unix_date(ts.cast("date")).cast("long") * DAY + clock.cast("long")


def day_of(local: Column) -> Column:
    return F.floor(local / DAY).cast("int")


def weekday(day: Column) -> Column:
    """0: Sunday."""
    return F.pmod(day + 4, F.lit(7))


def day_number(year: Column, month: Column, day: Column) -> Column:
    """Days since the epoch; months from 0, and months and days may run over. Years below 100 are of the 20th century."""
    y = year + F.floor(month / 12)
    y = F.when((y >= 0) & (y < 100), y + 1900).otherwise(y)
    return F.unix_date(F.make_date(y.cast("int"), (F.pmod(month, F.lit(12)) + 1).cast("int"), F.lit(1))) + day.cast("int") - 1


def at_clock(day: Column, hour: Column | int, minute: Column | int) -> Column:
    """Local milliseconds."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return day.cast("long") * DAY + lit(hour).cast("long") * 3_600_000 + lit(minute).cast("long") * MINUTE


def business_end(config: str | None) -> tuple[int, int, bool]:
    """Hour, minute, and whether they are the fallback."""
    hour, _, minute = (config or "").partition(":")
    if hour.isdigit() and len(hour) <= 2 and minute.isdigit() and len(minute) == 2:
        return int(hour), int(minute), False
    return *DAY_END, True


def proximity(hours: Column) -> Column:
    """1.5 for what is past, falling by e in 48 hours, nothing from two weeks on or without an instant."""
    from . import rules

    curve = F.lit(rules.PROXIMITY_MAX) * F.exp(-hours / rules.PROXIMITY_TAU)
    return F.when(hours.isNull() | (hours >= rules.PROXIMITY_HORIZON), 0.0).when(hours <= 0, rules.PROXIMITY_MAX).otherwise(curve)


def _has(text: Column, words: str) -> Column:
    return text.rlike(rf"\b(?:{words})\b")


def _group(text: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(text, pattern, n)


def _number(text: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(text, pattern, n).try_cast("int")


def _month(text: Column, pattern: str) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), _group(text, pattern, 1)).cast("int") - 1


def _weekday_named(text: Column) -> Column:
    named = F.lit(None).cast("int")
    for number in range(6, -1, -1):
        named = F.when(_has(text, "|".join(WEEKDAYS[number])), number).otherwise(named)
    return named


def _hour24(hour: Column, half: Column) -> Column:
    return F.pmod(hour, F.lit(12)) + F.when(half == "pm", 12).otherwise(0)


def resolve(trigger: Column, subcategory: Column, local: Column, business_day_end: str | None) -> Column:
    """struct<at, locale_assumed, end_assumed, reason>: the local milliseconds of the deadline a phrase names
    (null: none can be named), whether month/day order was assumed, whether the day's end was."""
    hour, minute, assumed = business_end(business_day_end)
    named_date = rf"\b({'|'.join(MONTHS)})[a-z]*\s+(\d{{1,2}})\b"
    iso, numeric = r"\b(\d{4})-(\d{2})-(\d{2})\b", r"\b(\d{1,2})/(\d{1,2})(?:/(\d{2,4}))?\b"
    ordinal, clock = r"\bthe (\d{1,2})(?:st|nd|rd|th)\b", r"\b(\d{1,2})(?::(\d{2}))?\s?(am|pm)?\b"
    bare_clock, minutes = r"\b(\d{1,2})(?::(\d{2}))?\s?(am|pm)\b", r"\b(?:within|in) (\d{1,2}) minutes?\b"
    window = r"\bwithin (?:the next )?(\d+|a few|two|three) (days|hours|weeks)\b"

    def end(day: Column) -> Column:
        return at_clock(day, hour, minute)

    def result(at: Column, locale: bool = False, day_end: bool = False, reason: str | None = None) -> Column:
        # a written instant has whole seconds
        seconds = (F.floor(at / 1000) * 1000).cast("long")
        return F.struct(seconds.alias("at"), F.lit(locale).alias("locale_assumed"), F.lit(day_end).alias("end_assumed"), F.lit(reason).cast("string").alias("reason"))

    def choose(t: Column) -> Column:
        today = day_of(local)
        date = F.date_from_unix_date(today)
        year, month = F.year(date), F.month(date) - 1
        nothing = result(F.lit(None).cast("long"))
        named = _weekday_named(t)

        def coming(target: Column) -> Column:
            return today + F.pmod(target - weekday(today), F.lit(7))

        def past_of(target: Column) -> Column:
            back = F.pmod(weekday(today) - target, F.lit(7))
            return today - F.when(back == 0, 7).otherwise(back)

        def month_day(years_back: int = 0) -> Column:
            return day_number(year - years_back, _month(t, named_date), _number(t, named_date, 2))

        overdue = F.when(end(month_day()) > local, end(month_day(1))).otherwise(end(month_day()))
        passed = (
            F.when(named.isNotNull(), result(end(past_of(named))))
            .when(_has(t, "yesterday"), result(end(today - 1)))
            .when(_has(t, "an hour ago"), result(local - 60 * MINUTE))
            .when(t.rlike(named_date), result(overdue))
            .otherwise(nothing)
        )
        full_year = F.when(F.length(_group(t, numeric, 3)) == 2, _number(t, numeric, 3) + 2000).otherwise(F.coalesce(_number(t, numeric, 3), year))
        this_month = day_number(year, month, _number(t, ordinal, 1))
        next_month = day_number(year, month + 1, _number(t, ordinal, 1))
        no_ordinals = F.regexp_replace(t, r"\b\d{1,2}(st|nd|rd|th)\b", "")
        half = _group(no_ordinals, clock, 3)
        is_next = t.rlike(r"\bnext\s+\w+\b")
        on_day = F.when(is_next & (named == weekday(today)), today + 7).otherwise(coming(named))
        day_clock = at_clock(on_day, _hour24(_number(no_ordinals, clock, 1), half), F.coalesce(_number(no_ordinals, clock, 2), F.lit(0)))

        def rolled(at: Column) -> Column:
            # a day on, seconds dropped, where it is past
            return F.when(at < local, at + DAY).otherwise(at)

        hours_now = at_clock(today, _hour24(_number(t, bare_clock, 1), _group(t, bare_clock, 3)), F.coalesce(_number(t, bare_clock, 2), F.lit(0)))
        amount = _group(t, window, 1)
        count = F.coalesce(amount.try_cast("long"), *[F.when(amount == w, F.lit(n).cast("long")) for w, n in WORD_NUMBERS.items()])
        unit_hours = F.when(_group(t, window, 2) == "hours", 1).when(_group(t, window, 2) == "days", 24).otherwise(168)
        friday = coming(F.lit(5))
        quarter_end = (F.floor(month / 3) * 3 + 2).cast("int")
        return (
            F.when(subcategory == "already_past", passed)
            .when(subcategory.isin("today.dynamic", "eod_cob.dynamic"), result(end(today), day_end=assumed))
            .when(_has(t, "first thing"), nothing)
            .when(t.rlike(r"\bstart of (?:play|business) (?:mon|tues|wednes|thurs|fri|satur|sun)day\b"), result(F.lit(None).cast("long"), reason="no start of the business day is configured"))
            .when(t.rlike(iso), result(end(day_number(_number(t, iso, 1), _number(t, iso, 2) - 1, _number(t, iso, 3)))))
            .when(t.rlike(numeric), result(end(day_number(full_year, _number(t, numeric, 1) - 1, _number(t, numeric, 2))), locale=True))
            .when(t.rlike(named_date), result(end(month_day())))
            .when(t.rlike(ordinal), result(F.when(end(this_month) < local, end(next_month)).otherwise(end(this_month))))
            .when(named.isNotNull() & (half != ""), result(day_clock))
            .when(named.isNotNull(), result(end(on_day)))
            .when(_has(t, "day after tomorrow"), result(end(today + 2)))
            .when(_has(t, "tomorrow"), result(end(today + 1)))
            .when(t.rlike(bare_clock), result(rolled(hours_now)))
            .when(_has(t, "noon"), result(rolled(at_clock(today, 12, 0))))
            .when(_has(t, "now|right now|right away|immediately|asap"), result(local))
            .when(t.rlike(minutes), result(local + _number(t, minutes, 1).cast("long") * MINUTE))
            .when(_has(t, "within the hour|in the next hour"), result(local + 60 * MINUTE))
            .when(_has(t, "in the next 30 minutes|in the next half hour"), result(local + 30 * MINUTE))
            .when(t.rlike(window), result(local + count * unit_hours * 60 * MINUTE))
            .when(_has(t, "this week"), result(end(friday)))
            .when(_has(t, "next week"), result(end(friday + 7)))
            .when(_has(t, "end of week|end of the week|eow"), result(end(friday)))
            .when(_has(t, "end of month|end of the month"), result(end(day_number(year, month + 1, F.lit(0)))))
            .when(_has(t, "end of quarter|end of the quarter"), result(end(day_number(year, quarter_end + 1, F.lit(0)))))
            .otherwise(nothing)
        )

    return let(F.lower(trigger), choose)


def iso_text(local: Column, offset: Column) -> Column:
    """An instant as text in its own offset."""
    day, rest = day_of(local), F.pmod(local, F.lit(DAY))
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    size = F.abs(offset)
    clock = [two(F.floor(rest / 3_600_000)), two(F.floor(rest % 3_600_000 / MINUTE)), two(F.floor(rest % MINUTE / 1000))]
    zone = F.concat(F.when(offset < 0, "-").otherwise("+"), two(F.floor(size / 60)), F.lit(":"), two(size % 60))
    return F.concat(F.date_format(F.date_from_unix_date(day), "yyyy-MM-dd"), F.lit("T"), F.concat_ws(":", *clock), zone)
