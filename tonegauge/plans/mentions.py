"""Repetition in a thread: a similarity join of signatures and as-of windows, without a message's history in its row.

For each message: how many earlier messages of its sender make the same request since one of its recipients last said
that something is done, when the last two of them were sent, and the latest message of a recipient before it.

1. Resets and replies: a row for each person that a message is from or to; per thread and person, running maxima over
   what was said before.
2. Same requests: signatures of a thread and sender, each once, meet by their rarest words (prefix filter), and those
   that meet are compared word for word.
3. Mentions: per thread, sender and signature, running counts and the last two messages; a message looks them up for
   each signature like its own, at its own place and at the reset's, whose count goes off.

Windows hold numbers only, in running frames, so a thread of any length costs memory by the row. Rows meet by thread
and person or signature, so a long thread is spread over tasks. What grows is the number of signatures that are alike
but not equal, within a thread and sender: a message looks at each of them.

Defined results: a message without a thread, a sender or words in its signature has no earlier mentions; ``ord`` tells
a thread's messages apart; null recipients are nobody; a message without a time answers nothing. Times need not rise
with ``ord``: where one doesn't, replies are looked up one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from .store import stored

_MESSAGE = ["thread_id", "ord"]
_SENDER = ["thread_id", "sender_id"]
_SPOT = "struct<ord:bigint,ms:bigint>"


def _earlier(*keys: str, by: str) -> Window:
    return Window.partitionBy(*keys).orderBy(by).rangeBetween(Window.unboundedPreceding, -1)


def resets_and_replies(records: DataFrame) -> DataFrame:
    """thread_id, ord, reset (ord of the last completion by a recipient), reply_ms (the latest message of a recipient that
    was sent before), for messages with a signature."""
    own = F.struct(F.col("sender_id").alias("person"), F.lit(True).alias("said"), F.lit(False).alias("self"))
    to = F.transform(F.array_distinct(F.coalesce("recipient_ids", F.array().cast("array<string>"))), lambda r: F.struct(r.alias("person"), F.lit(False).alias("said"), (r == F.col("sender_id")).alias("self")))
    asks = (F.size("signature") > 0).alias("asks")
    people = records.select(*_MESSAGE, "ms", "completion", asks, F.inline(F.concat(F.array(own), to))).where("person IS NOT NULL AND (said OR asks)")
    latest = F.max(F.when(F.col("said") & F.col("ms").isNotNull(), F.struct("ms", (-F.col("ord")).alias("neg"))))
    seen = people.withColumn("reset", F.max(F.when(F.col("said") & F.col("completion"), F.col("ord"))).over(_earlier("thread_id", "person", by="ord")))
    seen = seen.withColumn("reply", latest.over(_earlier("thread_id", "person", by="ms"))).where("NOT said")
    seen = seen.select(*_MESSAGE, "person", "ms", F.when(~F.col("self"), F.col("reset")).alias("reset"), "reply")
    late = -F.col("reply.neg") >= F.col("ord")  # sent before this message, but later in the thread: not what was asked for
    said = people.where("said").select(F.col("thread_id").alias("_thread"), F.col("person").alias("_person"), F.col("ord").alias("_ord"), F.col("ms").alias("_ms"))
    before = (F.col("_thread") == F.col("thread_id")) & (F.col("_person") == F.col("person")) & (F.col("_ord") < F.col("ord")) & (F.col("_ms") < F.col("ms"))
    odd = seen.where(late).join(said, before, "left").select(*_MESSAGE, "reset", F.col("_ms").alias("reply_ms"))
    even = seen.where(~F.coalesce(late, F.lit(False)) | F.col("reply").isNull()).select(*_MESSAGE, "reset", F.col("reply.ms").alias("reply_ms"))
    return even.unionByName(odd).groupBy(*_MESSAGE).agg(F.max("reset").alias("reset"), F.max("reply_ms").alias("reply_ms"))


def same_requests(records: DataFrame) -> DataFrame:
    """thread_id, sender_id, one, other: signatures (as texts) that are the same request, both ways and each with itself."""
    each = records.where(F.size("signature") > 0).select(*_SENDER, "said", F.array_distinct("signature").alias("words")).dropDuplicates([*_SENDER, "said"])
    words = each.select(*_SENDER, "said", "words", F.explode("words").alias("word"))
    known = words.withColumn("times", F.count("*").over(Window.partitionBy(*_SENDER, "word")))
    place = F.row_number().over(Window.partitionBy(*_SENDER, "said").orderBy("times", "word"))
    size = F.size("words")
    # a signature of n words has 0.3 n in common with a like one, so one of the first n - 0.3 n + 1 is common
    prefix = known.withColumn("place", place).where(F.col("place") <= size - F.ceil(F.round(size * rules.SAME_REQUEST, 9)) + 1)
    a = prefix.select(*_SENDER, "word", F.col("said").alias("one"), F.col("words").alias("a"))
    b = prefix.select(*_SENDER, "word", F.col("said").alias("other"), F.col("words").alias("b"))
    sizes = F.least(F.size("a"), F.size("b")) >= F.greatest(F.size("a"), F.size("b")) * rules.SAME_REQUEST - 1e-9
    met = a.join(b, [*_SENDER, "word"]).where((F.col("one") < F.col("other")) & sizes).dropDuplicates([*_SENDER, "one", "other"])
    alike = met.where(T.jaccard(F.col("a"), F.col("b")) >= rules.SAME_REQUEST).select(*_SENDER, "one", "other")
    return alike.unionByName(alike.select(*_SENDER, F.col("other").alias("one"), F.col("one").alias("other"))).unionByName(each.select(*_SENDER, F.col("said").alias("one"), F.col("said").alias("other")))


def mentions(messages: DataFrame) -> DataFrame:
    """thread_id, ord, earlier, last_ms, before_ms, reply_ms of messages (thread_id, ord, sender_id, recipient_ids,
    signature, completion, ms) with an earlier mention; earlier: how many."""
    d = messages.where("thread_id IS NOT NULL AND sender_id IS NOT NULL").select(
        *_MESSAGE, "sender_id", "recipient_ids", "signature", "completion", "ms", F.array_join(F.array_sort(F.array_distinct("signature")), " ").alias("said")
    )
    asked = d.where(F.size("signature") > 0).select(*_MESSAGE, "sender_id", "said", "ms")
    spot = F.struct("ord", "ms")
    previous = F.lag(spot).over(Window.partitionBy(*_SENDER, "said").orderBy("ord"))
    events = asked.select(*_SENDER, "said", F.col("ord").alias("at"), F.struct(F.col("ord"), F.col("ms"), previous.alias("previous")).alias("event"), F.lit(None).cast("bigint").alias("asker"), F.lit(None).cast("bigint").alias("reset"), F.lit(1).alias("sign"))
    wanted = asked.drop("ms").join(resets_and_replies(d).drop("reply_ms"), _MESSAGE, "left").join(same_requests(d).withColumnRenamed("one", "said"), [*_SENDER, "said"])
    nothing = F.lit(None).cast(f"struct<ord:bigint,ms:bigint,previous:{_SPOT}>").alias("event")
    # at the message, and just after the reset, whose count goes off
    places = F.filter(F.array(F.struct(F.col("ord").alias("at"), F.lit(1).alias("sign")), F.struct((F.col("reset") + 1).alias("at"), F.lit(-1).alias("sign"))), lambda p: p["at"].isNotNull())
    looks = wanted.select(*_SENDER, F.col("other").alias("said"), F.explode(places).alias("p"), nothing, F.col("ord").alias("asker"), "reset").select(*_SENDER, "said", "p.at", "event", "asker", "reset", "p.sign")
    over = _earlier(*_SENDER, "said", by="at")
    found = events.unionByName(looks).select("thread_id", "sign", "asker", "reset", F.count("event").over(over).alias("n"), F.max("event").over(over).alias("last")).where("asker IS NOT NULL AND n > 0")
    here = F.col("sign") > 0
    after = lambda e: F.when(e["ord"] > F.coalesce("reset", F.lit(-1).cast("bigint")), F.struct(e["ord"].alias("ord"), e["ms"].alias("ms")))
    found = found.select("thread_id", "asker", (F.col("n") * F.col("sign")).alias("n"), F.when(here, after(F.col("last"))).alias("last"), F.when(here, after(F.col("last")["previous"])).alias("previous"))
    found = found.withColumn("best", F.max("last").over(Window.partitionBy("thread_id", "asker")))
    second = F.max(F.when(F.col("last.ord") == F.col("best.ord"), F.col("previous")).otherwise(F.col("last")))
    chains = found.groupBy("thread_id", F.col("asker").alias("ord")).agg(F.sum("n").alias("earlier"), F.max("best.ms").alias("last_ms"), second["ms"].alias("before_ms")).where("earlier > 0")
    return chains.join(resets_and_replies(d).drop("reset"), _MESSAGE, "left")


def with_mentions(messages: DataFrame) -> DataFrame:
    """messages with earlier (0: none), last_ms, before_ms, reply_ms.

    The rows are written to a table first: what they took to score is done once, and the windows and joins read only
    the columns they need of it.
    """
    whole = stored(messages)
    return whole.join(mentions(whole), _MESSAGE, "left").withColumn("earlier", F.coalesce("earlier", F.lit(0).cast("bigint")))


def unanswered(earlier: Column, last_ms: Column, reply_ms: Column) -> Column:
    """No recipient's message lies between the last mention and this message."""
    return (earlier >= 1) & ~F.coalesce(reply_ms > last_ms, F.lit(False))


def accelerating(earlier: Column, ms: Column, last_ms: Column, before_ms: Column) -> Column:
    """The interval to this message is shorter than the one before."""
    return F.coalesce((earlier >= 2) & ((ms - last_ms) < (last_ms - before_ms)), F.lit(False))
