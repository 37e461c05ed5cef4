"""Queries over the test tables, one per operator group."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import automata, dates, formats, rules
from .functions import text as T
from .functions.needed import hits_sql, needed
from .operators import guard
from .plans import labelled, mentions, report, score, selection, store
from .sources import adapters, corpus, fixtures, pairs

Query = Callable[[SparkSession, str], DataFrame]


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.messages(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


#: Tasks for each shuffle partition where texts of very different lengths are dealt out.
TASKS = 4


def _dealt(rows: DataFrame, key: str, tasks: int = TASKS) -> DataFrame:
    """Rows dealt out: splits of a file go by bytes and whole row groups, and the work goes by texts."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) * tasks, key)


def _listed(words: list[str], number: Column) -> Column:
    """The word at a number, modulo their count, as the SQL takes it: negative places count from the end, and there is none at 0."""
    return F.try_element_at(F.expr(f"array({T.literals(words)})"), F.nullif((number % len(words) + 1).cast("int"), F.lit(0)))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.score_threads(_messages(spark, sf_dir), corpus.DAY_END)


def _weights(rows: str, condition: Callable) -> Column:
    return F.aggregate(F.filter(rows, condition), F.lit(0.0), lambda acc, e: acc + e["weight"])


def thread_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message's scores."""
    return _scored(spark, sf_dir).select(
        "thread_id", "ord", F.coalesce("head_act.level", F.lit(0)).alias("level"), F.round("surface", 6).alias("surface"), F.round("force", 6).alias("force"), F.round("gap", 1).alias("gap"), "band",
        F.round("confidence.value", 6).alias("confidence"), "suppressed",
    )


def force_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What adds to force, by component."""
    rows = "force_evidence"
    return _scored(spark, sf_dir).where("suppressed IS NULL").select(
        "thread_id", "ord",
        F.round(_weights(rows, lambda e: (e["category"] == "temporal") & (e["subcategory"] != "temporal.proximity")), 6).alias("rung"),
        F.round(_weights(rows, lambda e: e["subcategory"] == "temporal.proximity"), 6).alias("proximity"),
        F.round(_weights(rows, lambda e: e["category"] == "consequence"), 6).alias("consequence"),
        F.round(_weights(rows, lambda e: (e["category"] == "dependency") & (e["subcategory"] != "follow_up")), 6).alias("dependency"),
        F.round(_weights(rows, lambda e: (e["category"] == "escalation") | (e["subcategory"] == "follow_up")), 6).alias("escalation"),
    )


def band_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).groupBy("band", "suppressed").agg(F.count("*").alias("messages"))


def head_act_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score.with_head_act(score.prepared(_messages(spark, sf_dir)))
    return found.where("head IS NOT NULL").groupBy(F.col("head.level").alias("level"), F.col("head.strategy").alias("strategy")).agg(F.count("*").alias("messages"))


def suppression_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score.with_head_act(score.prepared(_messages(spark, sf_dir)))
    return found.groupBy(F.coalesce("suppressed", F.lit("scored")).alias("outcome")).agg(F.count("*").alias("messages"))


def widest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thread's message with the largest gap either way, the earliest of equals, and how many are scored."""
    d = _scored(spark, sf_dir).where("gap IS NOT NULL")
    most = F.max_by(F.struct("ord", "gap"), F.struct(F.abs(F.round("gap", 1)), -F.col("ord")))
    return d.groupBy("thread_id").agg(most.alias("m"), F.count("*").alias("scored")).select("thread_id", F.col("m.ord").alias("ord"), F.round("m.gap", 1).alias("gap"), "scored")


def mention_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each request was made before, and whether it went unanswered or came faster."""
    d = score.repeated(_messages(spark, sf_dir)).where("suppressed IS NULL")
    return d.select("thread_id", "ord", "earlier", mentions.unanswered(F.col("earlier"), F.col("last_ms"), F.col("reply_ms")).alias("unanswered"), mentions.accelerating(F.col("earlier"), F.col("ms"), F.col("last_ms"), F.col("before_ms")).alias("accelerating"))


def text_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of conversations that say the same again: as one sender's messages of seven long threads, timed by events.

    A text's words are its signature; each event is a message with the text of a conversation's turn, from one of five
    people to two others.
    """
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    first = lambda text: F.slice(T.signature(text), 1, 6)
    said = turns.groupBy((F.col("conv_id") * 8 + F.col("turn")).alias("place")).agg(F.min("text").alias("text"))
    said = store.stored(said.where("place BETWEEN 0 AND 210").select("place", first(F.col("text")).alias("words")))  # a text's words are found once, not for each event
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events = events.select("event_id", "user_id", dates.table_ms(events, "ts").alias("ms"))
    person = lambda k: F.concat(F.lit("p"), ((F.col("event_id") + k) % 5).cast("string"))
    asked = events.join(said, F.col("place") == F.col("user_id") % 211, "left").select(
        F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("thread_id"), F.col("event_id").alias("ord"), person(0).alias("sender_id"), F.array(person(1), person(2)).alias("recipient_ids"),
        F.when(F.col("event_id") % 2 == 0, F.coalesce("words", first(F.lit("")))).otherwise(F.array().cast("array<string>")).alias("signature"), (F.col("event_id") % 97 == 0).alias("completion"), "ms",
    )
    found = mentions.mentions(asked)
    return found.select(
        "thread_id", "ord", "earlier", "last_ms", F.coalesce("before_ms", F.lit(-1)).alias("before_ms"), mentions.unanswered(F.col("earlier"), F.col("last_ms"), F.col("reply_ms")).alias("unanswered"),
    )


def masked_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masking keeps lengths: per template, what is lost of its length, and what is left of its text."""
    d = score.with_mask(score.with_surface(score.with_head_act(score.prepared(_messages(spark, sf_dir)))))
    return d.where("suppressed IS NULL").groupBy(F.col("text")).agg(F.max(F.length("stable") - F.length("masked")).alias("lost"), F.max(F.regexp_replace("masked", " +", " ")).alias("left"))


def surface_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace of surface scores: evidence rows by subcategory and weight."""
    # one list of the few values counted, so that no field access is pushed into the scoring expressions
    about = F.transform("surface_evidence", lambda e: F.concat_ws("|", e["category"], e["subcategory"], F.round(e["weight"], 6).cast("string"), e["capped"].cast("string")))
    rows = _scored(spark, sf_dir).select(F.explode(about).alias("e")).groupBy("e").agg(F.count("*").alias("rows"))
    part = F.split("e", "[|]")
    return rows.select(part[0].alias("category"), part[1].alias("subcategory"), part[2].cast("double").alias("weight"), part[3].cast("boolean").alias("capped"), "rows")


def evidence_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut at the bounds of their evidence, each part with the number of rows that cover it."""
    d = score.score_threads(_messages(spark, sf_dir), corpus.DAY_END)
    texts = _messages(spark, sf_dir).select("msg_id", "text")
    return report.overlay(d.join(texts, "msg_id")).groupBy("covering").agg(F.count("*").alias("parts"))


def document_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of documents between the bounds of their capitalised words and of eight stretches dealt by doc_id: how many
    there are by coverage, and of how many characters."""
    d = _dealt(_documents(spark, sf_dir), "doc_id")
    words = F.transform(F.filter(T.cut_at(F.col("text"), "[A-Z][A-Za-z]*"), lambda p: p["hit"]), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.lit("word").alias("id")))
    size = F.length("text")
    dealt = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: ((F.col("doc_id") * 37 + k * 911) % F.greatest(size, F.lit(1))).cast("int"))
    stretches = F.transform(dealt, lambda at, k: F.struct(at.alias("start"), F.least(size, at + 40 * k).alias("end"), F.lit("stretch").alias("id")))
    rows = store.stored(d.select("doc_id", size.alias("size"), F.concat(words, F.when(size > 0, stretches).otherwise(F.array().cast("array<struct<start:int,end:int,id:string>>"))).alias("spans")))
    parts = report.swept(rows, "doc_id")
    return parts.groupBy("doc_id", "covering").agg(F.count("*").alias("parts"), F.sum(F.col("end") - F.col("start")).cast("long").alias("chars"), F.sum(F.size(F.filter("evidence", lambda e: e == "word"))).cast("long").alias("words"))


def partition_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that count for both sides: none here."""
    from .operators.confidence import partition_overlap as overlap

    d = _scored(spark, sf_dir).where("suppressed IS NULL")
    return d.agg(F.count("*").alias("messages"), F.sum(overlap(F.col("surface_evidence"), F.col("force_evidence")).cast("int")).alias("overlapping"))


def release_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.release_metrics(_scored(spark, sf_dir), _messages(spark, sf_dir))


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key: the conversations, each once."""
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("key")).distinct()


def _pairs(keys: DataFrame, results: DataFrame | None = None) -> DataFrame:
    results = score.score_threads(pairs.pair_messages(keys), pairs.DAY_END) if results is None else results
    return report.pair_checks(report.compare_pairs(results, pairs.pair_rows(keys)), pairs.SURFACE_FAMILIES)


def pair_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A minimal pair for each conversation: scores of both sides, and whether one score stayed and the other moved."""
    return _pairs(_keys(spark, sf_dir)).select("pair_id", "family", *[F.round(c, 6).alias(c) for c in ("surface_a", "surface_b", "force_a", "force_b")], "stays", "moves")


def gap_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(_keys(spark, sf_dir)).select("pair_id", F.round("gap_a", 1).alias("gap_a"), F.round("gap_b", 1).alias("gap_b"), "direction")


def _key(thread: str = "thread_id") -> Column:
    return F.split(thread, "-")[1].cast("long")


def _levels(keys: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """By level and key: the level found, its surface score, and whether it lies below the level before."""
    d = score.score_threads(pairs.level_messages(keys), pairs.DAY_END) if results is None else results
    d = d.select(F.split("thread_id", "-")[3].cast("int").alias("level"), _key().alias("key"), F.col("head_act.level").alias("matched"), "surface")
    return d.withColumn("below", F.col("surface") < F.lag("surface").over(Window.partitionBy("key").orderBy("level")))


def level_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(_keys(spark, sf_dir)).select("level", "key", "matched", F.round("surface", 6).alias("surface"), "below")


def _scenarios(keys: DataFrame, results: DataFrame | None = None) -> DataFrame:
    d = score.score_threads(pairs.scenario_messages(keys), pairs.DAY_END) if results is None else results
    of = lambda i: F.get(F.array(*[F.lit(x[i]) for x in pairs.SCENARIOS]), (_key() % len(pairs.SCENARIOS)).cast("int"))
    found = F.transform(F.filter("force_evidence", lambda e: e["category"] == of(2)), lambda e: e["event_id"])
    return d.select(_key().alias("key"), of(0).alias("scenario"), F.size(found).alias("rows"), F.size(F.array_distinct(found)).alias("events"), ((F.size(found) == of(3)) & (F.size(F.array_distinct(found)) == of(4))).alias("held"))


def event_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of evidence, of how many events, stand for facts said together and apart."""
    return _scenarios(_keys(spark, sf_dir)).drop("held")


def _twice(spark: SparkSession, sf_dir: str, first: DataFrame | None = None) -> DataFrame:
    """msg_id, same: two runs over different partitions give the same result rows."""
    m = _messages(spark, sf_dir)

    def run(r: DataFrame, name: str) -> DataFrame:
        return r.select("msg_id", F.sha2(F.to_json(F.struct(*[c for c in r.columns if c != "msg_id"])), 256).alias(name))

    first = score.score_threads(m, corpus.DAY_END) if first is None else first
    return run(first, "one").join(run(score.score_threads(m.repartition(5, "msg_id"), corpus.DAY_END), "two"), "msg_id").select("msg_id", (F.col("one") == F.col("two")).alias("same"))


def determinism(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _twice(spark, sf_dir).agg(F.count("*").alias("messages"), F.sum(F.col("same").cast("long")).alias("identical"))


def release_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every release check with its status, and a line of text for each."""
    # one run for all (their thread and message ids differ), and a second one to hold against it
    keys = _keys(spark, sf_dir)
    sources = [_messages(spark, sf_dir), pairs.pair_messages(keys), pairs.level_messages(keys), pairs.scenario_messages(keys)]
    columns = ["thread_id", "ord", "msg_id", "sender_id", "recipient_ids", "ts", "text"]
    results = score.score_threads(reduce(DataFrame.unionByName, [d.select(*columns) for d in sources]), corpus.DAY_END)
    results = store.stored(results)
    compared = _pairs(keys, results).withColumn("wording", F.col("family").isin(pairs.SURFACE_FAMILIES))
    one = lambda n, name, ok, need=1.0, partial=False: F.struct(F.lit(n).alias("check"), F.lit(name).alias("name"), ok.alias("ok"), F.lit(need).alias("need"), F.lit(partial).alias("partial"))
    rows = compared.select(F.explode(F.array(
        one(1, "force stays when wording changes", F.when(F.col("wording"), F.col("stays"))), one(2, "surface moves when wording changes", F.when(F.col("wording"), F.col("moves"))),
        one(3, "force moves when reasons change", F.when(~F.col("wording"), F.col("moves"))), one(4, "surface stays when reasons change", F.when(~F.col("wording"), F.col("stays"))),
        one(5, "gap moves the way it should", F.col("direction"), report.DIRECTION_RATE),
    )).alias("c"))
    levels = _levels(keys, results.where("thread_id LIKE 'k-%-level-%'")).select(one(6, "surface falls from level to level", (F.col("matched") == F.col("level")) & F.coalesce("below", F.lit(True)), partial=True).alias("c"))
    events = _scenarios(keys, results.where("thread_id LIKE 'k-%-scenario'")).select(one(9, "a fact counts once", F.col("held")).alias("c"))
    metrics = report.release_metrics(results, _messages(spark, sf_dir))
    fidelity, partition = F.col("check") != "sides share no character", F.col("check") == "sides share no character"
    trace = metrics.where(fidelity).select(one(7, "evidence adds up and quotes the text", F.col("failures") == 0).alias("c"))
    apart = metrics.where(partition).select(one(8, "no character counts on both sides", F.col("failures") == 0).alias("c"))
    again = _twice(spark, sf_dir, results).select(one(10, "two runs give the same", F.col("same")).alias("c"))
    passes = F.get(F.array(*[F.lit(ok) for _, ok in report.GUARD_SAMPLES]), F.col("sample"))
    guarded = intent_guard(spark, sf_dir).select(one(11, "copy claims no intent", F.col("claim").isNull() == passes).alias("c"))
    every = rows.unionByName(levels).unionByName(events).unionByName(trace).unionByName(apart).unionByName(again).unionByName(guarded)
    found = report.summary(every.select("c.*"))
    total = report.status_counts(found).select(F.lit(99).alias("check"), F.lit("total").alias("name"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("long").alias("held"), F.lit(None).cast("long").alias("applicable"), "report")
    return found.unionByName(total)


def formatted_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("thread_id", "ord", *report.formatted_columns())


def volume_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volume run: a message for each row of events."""
    d = score.score_threads(corpus.event_messages(spark.read.parquet(f"{sf_dir}/events.parquet")), corpus.DAY_END)
    return d.groupBy("band", "suppressed").agg(F.count("*").alias("messages"), F.round(F.avg("force"), 4).alias("mean_force"))


# -- text functions over the tables' own texts


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _conversations(spark, sf_dir).withColumn("s", T.sentences(T.stable(F.col("text"))))
    return d.select("conv_id", "turn", F.size("s").cast("long").alias("sentences"), F.aggregate("s", F.lit(0), lambda a, s: a + s["end"] - s["start"]).cast("long").alias("chars"))


def local_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _conversations(spark, sf_dir).withColumn("p", T.local_segments(F.col("text")))
    solid = F.filter("p", lambda p: ~p["hit"])
    return d.select("conv_id", "turn", F.size(solid).cast("long").alias("segments"), F.array_max(F.transform(solid, lambda p: p["end"] - p["start"])).cast("long").alias("longest"))


def event_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _messages(spark, sf_dir).withColumn("p", T.event_units(F.concat("text", F.lit("; and, so it "), "text")))
    return d.select("thread_id", "ord", F.size(F.filter("p", lambda p: ~p["hit"])).cast("long").alias("units"))


def quoted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _messages(spark, sf_dir).withColumn("q", T.quoted_spans(F.col("text")))
    return d.select("thread_id", "ord", F.size("q").cast("long").alias("quotations"), F.aggregate("q", F.lit(0), lambda a, q: a + q["end"] - q["start"]).cast("long").alias("quoted_chars"))


def signature_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("thread_id", "ord", F.array_join(T.signature(F.col("text")), " ").alias("signature"))


def same_request_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of one sender in one thread whose signatures have a Jaccard coefficient of 0.3 or more."""
    d = _messages(spark, sf_dir).select("thread_id", "ord", "sender_id", T.signature(F.col("text")).alias("s"))
    # a thread's earlier messages through a window: one shuffle, no self-join
    before = Window.partitionBy("thread_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    pairs = d.withColumn("p", F.collect_list(F.struct("ord", "sender_id", "s")).over(before)).withColumn("p", F.explode("p")).where("p.sender_id = sender_id")
    near = pairs.withColumn("j", T.jaccard(F.col("p.s"), F.col("s"))).where(F.col("j") >= rules.SAME_REQUEST)
    return near.select("thread_id", F.col("p.ord").alias("earlier"), F.col("ord").alias("later"), F.round("j", 6).alias("jaccard"))


_RE2_UNSAFE = ("(?!", "(?=", "(?<", "\\1")


def _rule_counts(spark: SparkSession, sf_dir: str, safe: bool) -> DataFrame:
    """In how many messages each rule matches: those of conversations, and an example of a rule for each event."""
    said = corpus.examples()
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.get(F.expr(f"array({T.literals(said)})"), (F.col("event_id") % len(said)).cast("int")).alias("text"))
    d = _messages(spark, sf_dir).select("text").unionByName(events).groupBy("text").agg(F.count("*").alias("n"))
    wanted = [(name, r) for name, table in rules.TABLES.items() for r in table if any(x in r.pattern for x in _RE2_UNSAFE) != safe]
    hits = F.expr("array(" + ", ".join(f'CASE WHEN text RLIKE r"{T.java(r.pattern, r.case)}" THEN named_struct(\'lexicon\', \'{name}\', \'rule\', {r.ord}) END' for name, r in wanted) + ")")
    found = d.select("n", F.explode(F.array_compact(hits)).alias("h"))
    return found.groupBy(F.col("h.lexicon").alias("lexicon"), F.col("h.rule").alias("rule")).agg(F.sum("n").alias("messages"))


def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules without look-around or back-reference."""
    return _rule_counts(spark, sf_dir, safe=True)


def rule_hits_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules with look-around or back-reference, which DuckDB's patterns haven't; held against Python's."""
    return _rule_counts(spark, sf_dir, safe=False)


def _in_documents(spark: SparkSession, sf_dir: str, safe: bool, indexed: bool = True) -> DataFrame:
    """In how many documents each rule matches: their whole texts, between two examples dealt by doc_id. Rules without
    look-around are automata, the others are found by the words they need; or (for tests) all are tried one by one."""
    wanted = [(name, r) for name, table in rules.TABLES.items() for r in table if any(x in r.pattern for x in _RE2_UNSAFE) != safe]
    said = corpus.examples()
    # automata take a text's length in time, and many texts at once
    d = _dealt(_documents(spark, sf_dir), "doc_id", *[1] * (safe and indexed)).select(F.concat(_listed(said, F.col("doc_id")), F.lit(" "), "text", F.lit(" "), _listed(said, F.col("doc_id") * 7)).alias("text"))
    if safe and indexed:
        counted = automata.counter([(name, r.ord, r.pattern, r.case) for name, r in wanted], pa.schema({"lexicon": pa.string(), "rule": pa.int32(), "documents": pa.int64()}))
        return d.mapInArrow(counted, "lexicon string, rule int, documents long").groupBy("lexicon", "rule").agg(F.sum("documents").alias("documents"))
    rows = [(T.java(r.pattern, r.case), needed(r.pattern) if indexed else (), {"lexicon": f"'{name}'", "rule": str(r.ord)}) for name, r in wanted]
    hits = d.select(F.explode(F.expr(hits_sql("text", rows, lexicon="{lexicon}", rule="{rule}"))).alias("h"))
    return hits.groupBy(F.col("h.lexicon").alias("lexicon"), F.col("h.rule").alias("rule")).agg(F.count("*").alias("documents"))


def document_rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules without look-around or back-reference in documents."""
    return _in_documents(spark, sf_dir, safe=True)


def labelled_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels found in conversations against labels: the templates' own, with every seventh place labelled the next level."""
    m = _messages(spark, sf_dir)
    own = F.get(F.array(*[F.lit(t.level) for t in corpus.TEMPLATES]), F.col("template"))
    labels = m.select("msg_id", F.when((F.col("conv_id") * 3 + F.col("ord")) % 7 == 0, (own + 1) % 8).otherwise(own).alias("label"))
    found = labelled.level_metrics(score.result(score.stages(m, corpus.DAY_END)), labels)
    return found.select("level", "labelled", "found", "agreed", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "precision_low", "precision_high", "recall_low", "recall_high")])


def caps_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of three and more capitals in documents, but for the excluded tokens."""
    d = _documents(spark, sf_dir).select("doc_id", F.regexp_extract_all("text", F.lit(f"({T.BORDER}[A-Z]{{3,}}{T.BORDER})"), F.lit(1)).alias("w"))
    kept = F.filter("w", lambda w: ~w.isin(rules.CAPS_EXCLUDED))
    return d.select("doc_id", F.size(kept).cast("long").alias("capitals")).where("capitals > 0")


def reduplication_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a word said twice in a row."""
    repeated = next(r for r in rules.UPGRADERS if r.subcategory == "repetition")
    return _documents(spark, sf_dir).where(F.col("text").rlike(T.java(repeated.pattern, repeated.case))).select("doc_id")


def intent_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of copy for each conversation, and the claim it makes."""
    samples = F.array(*[F.lit(s) for s, _ in report.GUARD_SAMPLES])
    d = _keys(spark, sf_dir).select("key", (F.col("key") % len(report.GUARD_SAMPLES)).cast("int").alias("sample"))
    return d.select("key", "sample", guard.intent_claim(F.get(samples, F.col("sample"))).alias("claim"))


# -- numbers over events


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value", ((F.col("event_id") % 400) - 20).cast("double").alias("hours"))


def proximity_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hours(spark, sf_dir).select("event_id", F.round(dates.proximity(F.col("hours")), 9).alias("bonus"))


def gap_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap and band of scores made from keys."""
    d = _hours(spark, sf_dir).select("event_id", ((F.col("event_id") * 37 % 1001) / 100.0).alias("force"), ((F.col("event_id") * 53 % 1001) / 100.0).alias("surface"))
    gap = formats.gap(F.col("force"), F.col("surface"))
    return d.select("event_id", F.round(gap, 1).alias("gap"), formats.band(gap).alias("band"))


def value_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median of the events' values: of each user, of each type, and of all, which is one group."""
    d = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "value")
    keys = F.array(F.concat(F.lit("user "), F.col("user_id").cast("string")), F.concat(F.lit("type "), F.col("event_type")), F.lit("all"))
    return selection.upper_medians(d.select(F.explode(keys).alias("key"), "value"), "key", "value")


def deadline_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases resolved at the times of events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    d = events.select("event_id", (F.floor(dates.table_ms(events, "ts", nearest=True) / 60000) * 60000).cast("long").alias("local"), _listed(report.PHRASES, F.col("event_id")).alias("phrase"))
    at = dates.resolve(F.col("phrase"), F.lit("named_day"), F.col("local"), corpus.DAY_END)["at"]
    return d.select("event_id", "phrase", F.coalesce(at, F.lit(-1).cast("long")).alias("due_ms"))


def editor_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows typed into an editor as messages of a thread."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").alias("ord"), F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise(" ").alias("sender"), F.when(F.col("turn") % 3 == 0, "").otherwise("all").alias("recipient"), "text")
    return adapters.from_editor(rows, "conv_id").select("thread_id", "ord", "sender_id", F.size("recipient_ids").alias("recipients"), "ts")


def fixture_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark rows, each of a family dealt by its id, written as fenced blocks, read, written as JSON lines and read."""
    families = [*pairs.SURFACE_FAMILIES, *pairs.FORCE_FAMILIES]
    d = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.get(F.array(*[F.lit(f) for f in families]), (F.col("item_id") % len(families)).cast("int")).alias("family"), "text")
    rows = d.count()
    for form in fixtures.FORMS:
        path = f"{store.shared_folder(spark)}/fixtures-{uuid.uuid4().hex}"
        fixtures.write(d, path, "item_id", "family", form, "Benchmark", rows, dict.fromkeys(families))
        store.swept(spark, path)
        d = fixtures.read(spark, path, "item_id long, family string, text string")
    return d


_ALL = (
    thread_report, force_components, band_distribution, head_act_levels, suppression_counts, widest_gap, mention_chain, text_mentions, masked_text, surface_evidence, evidence_overlay, document_overlay, partition_overlap,
    release_metrics, pair_checks, gap_direction, level_order, event_dedupe, determinism, release_report, formatted_report, volume_bands, sentences, local_segments, event_units, quoted_spans, signature_tokens, same_request_pairs, rule_hits, rule_hits_around, document_rule_hits, caps_hits, reduplication_hits,
    intent_guard, labelled_levels, value_medians, proximity_bonus, gap_bands, deadline_resolution, editor_threads, fixture_round_trip,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}
