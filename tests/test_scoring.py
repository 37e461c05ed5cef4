"""Scores of single messages and short threads, worked out by hand."""

import pytest

from tonegauge.functions import rules
from tonegauge.plans import score_threads
from tonegauge.plans.score import MESSAGES
from tonegauge.sources import adapters, corpus

MONDAY = "2026-08-17T09:00:00-04:00"


def scored(spark, texts, end="17:00", ts=MONDAY, to=("B",)):
    rows = [(f"t{i:03d}", 0, f"m{i:03d}", "A", list(to), ts, t) for i, t in enumerate(texts)]
    return sorted(score_threads(spark.createDataFrame(rows, MESSAGES), end).collect(), key=lambda r: r.msg_id)


def thread(spark, rows, end="17:00"):
    """rows: sender, hours before, text."""
    from datetime import datetime, timedelta

    at = datetime.fromisoformat(MONDAY)
    data = [("t", i, f"m{i}", s, ["B" if s == "A" else "A"], (at - timedelta(hours=h)).isoformat(), text) for i, (s, h, text) in enumerate(rows)]
    return sorted(score_threads(spark.createDataFrame(data, MESSAGES), end).collect(), key=lambda r: r.ord)


def weights(rows, *subs):
    return [round(e.weight, 6) for e in rows if e.subcategory in subs]


def test_every_template_is_worth_what_was_derived_by_hand(spark):
    for t, r in zip(corpus.TEMPLATES, scored(spark, [t.text for t in corpus.TEMPLATES]), strict=True):
        assert (r.head_act.level if r.head_act else 0) == t.level, t.text
        assert r.surface == (None if t.surface is None else pytest.approx(t.surface, abs=1e-9)), t.text
        assert sum(e.weight for e in r.force_evidence if e.category == "consequence") == pytest.approx(t.consequence), t.text
        assert sum(weights(r.force_evidence, "framing", "accountability")) == pytest.approx(t.dependency, abs=1e-6), t.text
        units = t.text.encode("utf-16-le")
        if t.request:
            assert units[2 * r.head_act.span.start : 2 * r.head_act.span.end].decode("utf-16-le") == t.request


def test_numeric_goldens(spark):
    plain, soft, strong, quick = scored(spark, ["Review the deck.", "You need to maybe review the deck.", "You need to urgently review the deck.", "Could you review the deck?"])
    assert (plain.surface, soft.surface, strong.surface, quick.force) == (10.0, pytest.approx(6.52), pytest.approx(7.8), 3.0)
    assert quick.confidence.value == pytest.approx(0.85)
    (r,) = scored(spark, ["Not too much trouble, but would you mind reviewing the doc by Thursday? We're blocked on it."], end=None, ts="2026-01-05T14:00:00Z")
    assert (r.surface, round(r.force, 4), r.gap, r.band) == (pytest.approx(3.1), 6.8318, 3.7, "under-phrased")
    assert r.confidence.value == pytest.approx(0.95)


def test_a_text_is_scored_once_however_often_it_is_said(spark, monkeypatch):
    from tonegauge.plans import score

    texts = ["Can you send the file today? We're blocked on it.", "Review the deck.", "🎉 Could you look at \"the plan\"?", "The numbers look fine.", "", None]
    times = [MONDAY, "2026-08-17T15:30:00-04:00", "2026-08-17T18:30:00Z", None]
    rows = [(f"t{i}.{k}.{n}", 0, f"m{i}.{k}.{n}", "A", to, ts, t) for i, t in enumerate(texts) for k, ts in enumerate(times) for n, to in enumerate((["B"], [], None))]
    tables, write = [], score.stored
    monkeypatch.setattr(score, "stored", lambda df: tables.append(write(df)) or tables[-1])
    got = {r.msg_id: r for r in score_threads(spark.createDataFrame(rows, MESSAGES), "17:00").collect()}
    assert [t.count() for t in tables] == [10]  # five texts, addressed and not
    assert len(got) == len(rows)
    assert [[e.raw_weight for e in got[f"m0.{k}.0"].force_evidence if e.subcategory == "today.dynamic"] for k in range(3)] == [[3.0], [5.0], [5.0]]
    assert {r.suppressed for m, r in got.items() if m[1] in "012"} == {None, "unresolved_addressee"} and got["m2.0.0"].surface_evidence[0].trigger == "Could you"
    assert all(e.id.startswith(f"{m}:") and e.event_id.startswith(f"{m}:") and e.message_id == m for m, r in got.items() for e in [*r.surface_evidence, *r.force_evidence])
    monkeypatch.setattr(score, "BROADCAST_CHARS", -1)  # many texts
    assert {r.msg_id: r for r in score_threads(spark.createDataFrame(rows, MESSAGES), "17:00").collect()} == got


def test_bounds_rescale_the_trace(spark):
    soft, hard = scored(spark, ["Could you maybe possibly just please look at the plan, if possible, no rush, no pressure?", "Send the report ASAP!! Otherwise we'll escalate; the client is waiting. Following up. We're blocked on it."])
    assert soft.surface == pytest.approx(0.5) and all(e.capped for e in soft.surface_evidence[1:])
    assert sum(e.weight for e in soft.surface_evidence) == pytest.approx(soft.surface)
    assert hard.force == 10.0 and sum(e.weight for e in hard.force_evidence) == pytest.approx(7.0)


def test_guards(spark):
    none, quoted, empty, null = scored(spark, ["The numbers look fine.", 'She wrote "could you send it" twice.', "", None])
    assert [r.suppressed for r in (none, quoted, empty, null)] == ["no_head_act"] * 4
    (nobody,) = scored(spark, ["Review the deck."], to=())
    assert nobody.suppressed == "unresolved_addressee" and nobody.head_act.level == 1 and nobody.surface is None


def test_modifier_attachment(spark):
    vocative, other, own, astral = scored(spark, ["Could you look, Bob?", "No rush on payroll, but could you send it?", "No rush, but could you send it?", "🎉🎉 Nice. Could you send it?"])
    assert vocative.surface == pytest.approx(3.1)
    assert other.surface == pytest.approx(2.7) and own.surface == pytest.approx(1.9)
    assert astral.head_act.span.start == 11 and astral.surface_evidence[0].trigger == "Could you"


def test_today_depends_on_the_hours_left(spark):
    for at, raw in (("09:00", 3.0), ("13:00", 4.0), ("16:00", 5.0), ("18:30", 5.0)):
        (r,) = scored(spark, ["Can you send the file today?"], ts=f"2026-08-17T{at}:00-04:00")
        assert [e.raw_weight for e in r.force_evidence if e.subcategory == "today.dynamic"] == [raw]
    (late,) = scored(spark, ["Can you send the file today?"], ts="2026-08-17T18:30:00-04:00")
    assert weights(late.force_evidence, "temporal.proximity") == [1.5]


@pytest.mark.parametrize(
    ("phrase", "due"),
    [
        ("by Friday", "2026-08-21T17:00:00-04:00"), ("next Friday", "2026-08-21T17:00:00-04:00"), ("by the 15th", "2026-09-15T17:00:00-04:00"), ("on 24/7", "2027-12-07T17:00:00-04:00"), ("by 8/20", "2026-08-20T17:00:00-04:00"),
        ("Friday at 3pm", "2026-08-21T15:00:00-04:00"), ("within 2 weeks", "2026-08-31T09:00:00-04:00"), ("end of the month", "2026-08-31T17:00:00-04:00"), ("by noon", "2026-08-17T12:00:00-04:00"),
        ("day after tomorrow", "2026-08-19T17:00:00-04:00"), ("in 20 minutes", "2026-08-17T09:20:00-04:00"), ("before 8am", "2026-08-18T08:00:00-04:00"), ("overdue since Sep 3", "2025-09-03T17:00:00-04:00"),
    ],
)
def test_deadlines(spark, phrase, due):
    (r,) = scored(spark, [f"Can you send the file {phrase}?"])
    notes = [e.note for e in r.force_evidence if e.subcategory == "temporal.proximity"]
    assert notes == [] if due is None else notes[0].startswith(f"due {due}")


def test_mentions_reset_speed_and_silence(spark):
    r = thread(spark, [("A", 48, "Can you send the summary?"), ("A", 20, "Can you send the summary?"), ("A", 0, "Can you send the summary?")])
    assert weights(r[1].force_evidence, "verified_restatement", "unanswered") == [1.0, 0.5]
    assert weights(r[2].force_evidence, "verified_restatement", "accelerating_intervals", "unanswered") == [1.8, 0.5, 0.5]
    r = thread(spark, [("A", 48, "Can you send the summary?"), ("B", 24, "All done."), ("A", 0, "Can you send the summary?")])
    assert weights(r[2].force_evidence, "verified_restatement") == []
    r = thread(spark, [("A", 48, "Can you send the summary?"), ("B", 24, "Looking."), ("A", 0, "Can you send the summary?")])
    assert weights(r[2].force_evidence, "verified_restatement", "unanswered") == [1.0]


def test_escalation_is_bounded(spark):
    r = thread(spark, [("A", h, "Can you send the summary?") for h in (90, 60, 40, 30)] + [("A", 0, "Following up, can you send the summary?")])
    total = sum(e.weight for e in r[4].force_evidence)
    assert total == pytest.approx(3.0) and all(e.capped for e in r[4].force_evidence)


def test_rule_tables():
    assert {k: len(v) for k, v in rules.TABLES.items()} == {"directness": 104, "downgraders": 90, "upgraders": 27, "temporal": 80, "consequence": 27, "dependency": 39}
    assert rules.action_forms()["submitted"] == "submit" and rules.action_forms()["updating"] == "update" and "business" not in rules.action_forms()


def test_adapters(spark, tmp_path):
    d = adapters.sample_threads(spark)
    assert {r.thread_id: r.suppressed for r in score_threads(d).where("ord = 0").collect()} == {"launch": None, "deadline": None, "nobody": "unresolved_addressee"}
    (tmp_path / "f.md").write_text('# One\n```json\n[{"id": "a", "text": "x"}, {"id": "a", "text": "y"}]\n```\n# Two\n```json\n[]\n```\n')
    rows = adapters.fixture_rows(spark, str(tmp_path / "f.md"), "# One", "id:string,text:string")
    assert [tuple(r) for r in rows.collect()] == [("a", "x"), ("a", "y")] and adapters.repeated_ids(rows).count() == 1
    assert adapters.composed(spark.createDataFrame([("d", "A", "B", "Send it.")], "draft_id string, sender string, recipient string, text string"), MONDAY).first().ts == MONDAY


def test_streaming_rescores_touched_threads(spark, tmp_path):
    from tonegauge.streaming import rescore

    source, history, results, state = (str(tmp_path / x) for x in ("in", "history", "results", "state"))
    first = [("t", 0, "m0", "A", ["B"], MONDAY, "Can you send the summary?"), ("u", 0, "u0", "A", ["B"], MONDAY, "Review the deck.")]
    spark.createDataFrame(first, MESSAGES).coalesce(1).write.json(source)
    rescore.start(rescore.read_messages(spark, source), history, results, state, "17:00").awaitTermination()
    spark.createDataFrame([("t", 1, "m1", "A", ["B"], "2026-08-18T09:00:00-04:00", "Can you send the summary?")], MESSAGES).coalesce(1).write.mode("append").json(source)
    rescore.start(rescore.read_messages(spark, source), history, results, state, "17:00").awaitTermination()
    got = {r.msg_id: r.force for r in rescore.latest(spark, results).collect()}
    assert got == {"m0": 3.0, "m1": 4.5, "u0": 3.0}
    # a message that comes again replaces itself, whatever order rows are read in
    spark.createDataFrame([("t", 0, "m0", "A", ["B"], MONDAY, "The numbers look fine.")], MESSAGES).coalesce(1).write.mode("append").json(source)
    rescore.start(rescore.read_messages(spark, source), history, results, state, "17:00").awaitTermination()
    assert {r.msg_id: r.force for r in rescore.latest(spark, results).collect()} == {"m0": None, "m1": 3.0, "u0": 3.0}
    assert [r.msg_id for r in rescore.latest(spark, results, ["u"]).collect()] == ["u0"]


def test_every_rule_has_an_example_that_it_matches():
    import re

    for r, text in zip([r for table in rules.TABLES.values() for r in table], corpus.examples(), strict=True):
        assert re.search(r.pattern, text, 0 if r.case else re.I), r.pattern


def test_rules_with_look_around_equal_pythons(spark, sf):
    import re

    import pyarrow.parquet as pq

    from tonegauge.queries import _RE2_UNSAFE, QUERIES

    said = corpus.examples()
    texts = [said[i % len(said)] for i in pq.read_table(f"{sf}/events.parquet").column("event_id").to_pylist()]
    texts += [r.text for r in corpus.messages(spark.read.parquet(f"{sf}/conversations.parquet")).collect()]
    want = {}
    for name, table in rules.TABLES.items():
        for r in table:
            if any(x in r.pattern for x in _RE2_UNSAFE) and (n := sum(bool(re.search(r.pattern, t, 0 if r.case else re.I)) for t in texts)):
                want[name, r.ord] = n
    assert {(r.lexicon, r.rule): r.messages for r in QUERIES["rule_hits_around"](spark, sf).collect()} == want and len(want) >= 10


def test_guard_raises(spark):
    from pyspark.sql import functions as F

    from tonegauge.operators import guard

    d = spark.createDataFrame([("The sender meant to press you.",)], "t string")
    with pytest.raises(Exception, match="(?i)intent"):
        d.select(guard.assert_no_intent_claims(F.col("t"))).collect()


def plain_mentions(rows):
    """By comparing every message with all before it."""
    out = {}
    for t, o, sender, to, sig, _, ms in rows:
        if t is None or sender is None or not sig:
            continue
        prior = sorted((r for r in rows if r[0] == t and r[1] < o), key=lambda r: r[1])
        chain = []
        for p in prior:
            if p[2] == sender:
                if p[4] and len(set(p[4]) & set(sig)) / len(set(p[4]) | set(sig)) >= 0.3:
                    chain.append(p)
            elif p[2] in (to or []) and p[5]:
                chain = []
        if chain:
            replies = [p[6] for p in prior if p[2] in (to or []) and p[6] is not None and ms is not None and p[6] < ms]
            last = chain[-1][6]
            answered = last is not None and any(x > last for x in replies)
            quick = len(chain) > 1 and None not in (ms, last, chain[-2][6]) and ms - last < last - chain[-2][6]
            out[t, o] = (len(chain), last, chain[-2][6] if len(chain) > 1 else None, not answered, quick)
    return out


_RECORD = "thread_id string, ord long, sender_id string, recipient_ids array<string>, signature array<string>, completion boolean, ms long"


def found_mentions(spark, rows):
    from pyspark.sql import functions as F

    from tonegauge.plans import mentions as M

    d = spark.createDataFrame(rows, _RECORD).repartition(3)
    times = d.select("thread_id", "ord", "ms")
    got = M.mentions(d).join(times, ["thread_id", "ord"]).withColumn("u", M.unanswered(F.col("earlier"), F.col("last_ms"), F.col("reply_ms"))).withColumn("a", M.accelerating(F.col("earlier"), F.col("ms"), F.col("last_ms"), F.col("before_ms")))
    return {(r.thread_id, r.ord): (r.earlier, r.last_ms, r.before_ms, r.u, r.a) for r in got.collect()}


def test_mentions_of_random_threads(spark):
    import random

    rng = random.Random(4)
    words = "send report plan budget review draft venue notes ticket login".split()
    rows = []
    for t in ("x", "y", "z", None):
        for o in range(0, 240, 2):
            ms = None if rng.random() < 0.03 else o * 1000 + (0 if t == "x" else rng.randrange(-9000, 9000))  # x is in order of time
            to = None if rng.random() < 0.05 else rng.sample("ABCD", rng.randrange(0, 4))
            sig = [rng.choice(words) for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 7]))]
            rows.append((t, o, None if rng.random() < 0.03 else rng.choice("ABC"), to, sig, rng.random() < 0.1, ms))
    want = plain_mentions(rows)
    assert found_mentions(spark, rows) == want and len(want) > 80
    assert found_mentions(spark, []) == {}


def test_mentions_of_equal_times_and_a_long_thread(spark):
    rows = [("t", o, "AB"[o % 2], ["BA"[o % 2]], ["send", "report"], o == 301, 5) for o in range(600)]
    assert found_mentions(spark, rows) == plain_mentions(rows)
    # 100,000 messages: a step of memory for each, no list of those before
    n = 100_000
    texts = [["send", "report"], ["send", "report", "now"], ["book", "venue"], []]
    long = [("t", o, "A" if o % 5 else "B", ["B" if o % 5 else "A"], texts[o % 4], o == n // 2, o * 1000) for o in range(n)]
    got = found_mentions(spark, long)
    mine = [o for o in range(n) if o % 5 and o % 4 in (0, 1)]
    assert got["t", mine[-1]][0] == sum(n // 2 < o < mine[-1] for o in mine) and got["t", mine[9]][0] == 9


def test_no_message_carries_its_history(spark):
    from tonegauge.plans import mentions as M

    plan = M.with_mentions(spark.createDataFrame([], "thread_id string, ord long, text string, sender_id string, recipient_ids array<string>, signature array<string>, completion boolean, ms long"))._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert windows and "collect_list" not in plan and not any("signature" in w.split("Window [")[1].split(" windowspecdefinition")[0] for w in windows)


def test_sweep_of_random_spans(spark):
    import random

    from tonegauge.plans import report

    rng = random.Random(1)
    texts = [(i, size, [(a, min(size, a + rng.choice([0, 1, 3, 9, 40])), f"{i}.{k}") for k in range(rng.randrange(9)) for a in [rng.randrange(size + 1)]]) for i, size in enumerate([0, 1, 2, 7, 30, 30, 80, 200])]
    texts.append((99, 5000, [(0, 5000, "all")] + [(k, k + 7, f"w{k}") for k in range(0, 4990, 3)]))
    want = set()
    for i, size, spans in texts:
        at = sorted({0, size, *[x for a, b, _ in spans for x in (a, b)]})
        for a, b in zip(at, at[1:], strict=False):
            ids = [n for x, y, n in spans if x <= a and y >= b]
            want.add((i, a, b, len(ids), tuple(ids)))
    d = spark.createDataFrame(texts, "key int, size int, spans array<struct<start:int,end:int,id:string>>")
    found = report.swept(d, "key")
    assert {(r.key, r.start, r.end, r.covering, tuple(r.evidence)) for r in found.collect()} == want
    assert "exists(" not in found._jdf.queryExecution().executedPlan().toString()


def test_upper_medians(spark):
    import random

    from tonegauge.plans import selection

    rng = random.Random(2)
    groups = {"a": [1.0], "b": [2.0, 1.0], "c": [5.0] * 9 + [-1e308, 1e308], "d": [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-300, 300) for _ in range(301)], None: [3.0, float("inf"), None, float("nan"), 4.0], "none": [None], "hot": [float(i * 7919 % 5000) / 8 for i in range(5000)], "tiny": [5e-324, 0.0, 1e-323, -5e-324]}
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    rng.shuffle(rows)
    got = {r.key: (r.n, r.median) for r in selection.upper_medians(spark.createDataFrame(rows, "key string, value double"), "key", "value").collect()}
    solid = {k: sorted(v for v in vs if v is not None and abs(v) < float("inf")) for k, vs in groups.items()}
    assert got == {k: (len(v), v[len(v) // 2]) for k, v in solid.items() if v}
