"""Other shapes of input: editor rows, a single composed message, fixture blocks of a document, sample threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates

#: 2026-01-05T14:00:00Z: where editor threads start, an hour from row to row.
EDITOR_START_MS = 1_767_621_600_000


def from_editor(rows: DataFrame, thread: str) -> DataFrame:
    """Messages of rows (thread, ord from 0, sender, recipient, text): blank senders are numbered, blank recipients nobody."""
    ts = dates.iso_text(F.lit(EDITOR_START_MS) + F.col("ord").cast("long") * 3_600_000, F.lit(0))
    sender = F.trim(F.coalesce("sender", F.lit("")))
    recipient = F.trim(F.coalesce("recipient", F.lit("")))
    return rows.select(
        F.col(thread).cast("string").alias("thread_id"), F.col("ord").cast("long").alias("ord"), F.concat_ws("-", F.col(thread).cast("string"), F.col("ord").cast("string")).alias("msg_id"),
        F.when(sender == "", F.concat(F.lit("Sender "), (F.col("ord") + 1).cast("string"))).otherwise(sender).alias("sender_id"),
        F.when(recipient == "", F.array().cast("array<string>")).otherwise(F.array(recipient)).alias("recipient_ids"), F.regexp_replace(ts, r"\+00:00$", "Z").alias("ts"), "text",
    )


def composed(drafts: DataFrame, as_of: str) -> DataFrame:
    """Single-message threads of drafts (draft_id, sender, recipient, text), all stamped with the ISO instant given."""
    rows = from_editor(drafts.withColumn("ord", F.lit(0)), "draft_id")
    return rows.withColumn("ts", F.lit(as_of))


def fixture_rows(spark: SparkSession, path: str, header: str, schema: str) -> DataFrame:
    """Rows of the first fenced JSON block after a header of a Markdown file."""
    whole = spark.read.text(path, wholetext=True)
    quoted = header.replace("\\", "\\\\").replace('"', '\\"')
    after = F.element_at(F.split("value", r"\Q" + quoted + r"\E", 2), 2)
    block = F.regexp_extract(after, r"(?s)```json\s*\n(.*?)\n```", 1)
    return whole.select(F.inline(F.from_json(block, f"array<struct<{schema}>>")))


def repeated_ids(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1")


def fixture_thread(rows: DataFrame, start: str, addresses: dict[str, str]) -> DataFrame:
    """Messages of rows (thread_id, ord, minutes_before, sender, recipient, text) around an instant, whose offset they keep."""
    at, offset = dates.epoch_ms(F.lit(start)), dates.offset_minutes(F.lit(start))
    local = at + offset.cast("long") * dates.MINUTE - F.col("minutes_before").cast("long") * dates.MINUTE
    names = F.create_map(*[F.lit(x) for pair in addresses.items() for x in pair])

    def address(c: str) -> Column:
        return F.coalesce(F.element_at(names, F.col(c)), F.concat(F.col(c), F.lit("@example.com")))

    return rows.select(
        "thread_id", F.col("ord").cast("long").alias("ord"), F.concat("thread_id", F.lit("-m"), F.col("ord").cast("string")).alias("msg_id"), address("sender").alias("sender_id"),
        F.array(address("recipient")).alias("recipient_ids"), dates.iso_text(local, offset).alias("ts"), "text",
    )


def sample_threads(spark: SparkSession) -> DataFrame:
    """Three short threads to try things on."""
    rows = [
        ("launch", 0, "Ana", "Ben", "Can you send the launch checklist?"), ("launch", 1, "Ben", "Ana", "Looking at it now."), ("launch", 2, "Ana", "Ben", "Could you send the launch checklist by Friday?"),
        ("launch", 3, "Ana", "Ben", "Following up, can you send the launch checklist today? Otherwise we'll miss the window."),
        ("deadline", 0, "Ana", "Ben", "Would you mind reviewing the contract by Thursday? We're blocked on it."), ("nobody", 0, "Ana", "", "Please update the roster."),
    ]
    return from_editor(spark.createDataFrame(rows, "thread string, ord int, sender string, recipient string, text string"), "thread")
