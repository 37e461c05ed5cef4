"""Rules found by the words they need, against rules tried one by one; levels against labels."""

import math
import re

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tonegauge import queries
from tonegauge.functions import automata, rules
from tonegauge.functions.needed import hits_sql, needed
from tonegauge.plans import labelled
from tonegauge.sources import corpus

EVERY = [r for table in rules.TABLES.values() for r in table]


def test_each_example_holds_a_word_that_its_rule_needs():
    for r, text in zip(EVERY, corpus.examples(), strict=True):
        assert not needed(r.pattern) or any(w in text.lower() for w in needed(r.pattern)), r.pattern
    assert sum(not needed(r.pattern) for r in EVERY) == 2


def test_needed_words_of_shapes():
    assert needed(r"\b(send|resend)\b") == ("send",)
    assert needed(r"(?:hey\s+)?(ping|call)\s+\w+") == ("call", "ping")
    assert needed(r"\bI'?m asking (you )?to\b") == ("m asking ",)
    assert needed(r"(urgent|\d+)!?") == () and needed(r"\s*[A-Z]+") == () and needed(r"(x|)y?") == ()
    assert needed(r"a(?=bc)d+") in (("a",), ("ad",), ("d",))


def test_documents_and_odd_texts_have_the_rules_that_a_plain_run_finds(spark, sf):
    for safe in (True, False):
        one, other = ({(r.lexicon, r.rule): r.documents for r in queries._in_documents(spark, sf, safe, indexed).collect()} for indexed in (True, False))
        assert one == other and len(one) >= (250 if safe else 5)  # 200 documents, two examples each
    said = corpus.examples()
    texts = ["", " ", "no", *said, *[s.upper() for s in said], *[f"x{s}" for s in said], *[f"{s}İK {said[i * 7 % len(said)]}" for i, s in enumerate(said)], " ".join(said)]
    rows = [(r.pattern, needed(r.pattern), {"n": str(i), "weight": f"{r.weight}D"}) for i, r in enumerate(EVERY) if not any(x in r.pattern for x in ("$", "\\s", "\\w", "\\b", "."))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = df.select("id", F.explode(F.expr(hits_sql("text", rows, n="{n}", start="{start}", end="{end}", weight="{weight}"))).alias("h")).select("id", "h.*").collect()
    want = {(i, n, m.start(), m.end(), EVERY[n].weight) for i, t in enumerate(texts) for p, _, own in rows if (m := re.search(p, t)) for n in [int(own["n"])]}
    assert {(r.id, r.n, r.start, r.end, r.weight) for r in got} == want and want


def test_rules_with_look_around_in_documents_equal_pythons(spark, sf):
    said = corpus.examples()
    d = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    texts = [f"{said[r['doc_id'] % len(said)]} {r['text'] or ''} {said[r['doc_id'] * 7 % len(said)]}" for r in d]
    odd = [(n, r) for n, table in rules.TABLES.items() for r in table if any(x in r.pattern for x in queries._RE2_UNSAFE)]
    want = {(n, r.ord): k for n, r in odd if (k := sum(bool(re.search(r.pattern, t, re.A | (0 if r.case else re.I))) for t in texts))}
    assert {(r.lexicon, r.rule): r.documents for r in queries._in_documents(spark, sf, safe=False).collect()} == want


def test_planted_wrong_labels_show(spark):
    results = spark.createDataFrame([(f"m{i}", (1 + i % 2,) if i % 4 else None) for i in range(400)], "msg_id string, head_act struct<level:int>")
    labels = spark.createDataFrame([(f"m{i}", 2 if i % 20 == 2 else (1 + i % 2 if i % 4 else 0)) for i in range(400)] + [("nowhere", 1), ("m1", None)], "msg_id string, label int")
    rows = {r.level: r for r in labelled.level_metrics(results, labels).collect()}
    assert set(rows) == {0, 1, 2} and (rows[0].precision, rows[0].recall) == (1.0, 1.0)
    assert (rows[1].found, rows[1].agreed, rows[1].labelled) == (100, 80, 80) and (rows[2].found, rows[2].agreed, rows[2].labelled) == (200, 200, 220)
    assert rows[1].precision_low < 0.8 < rows[1].precision_high and rows[1].precision_high - rows[1].precision_low < 0.25 and rows[1].recall_low == 1.0
    assert labelled.level_metrics(results.limit(0), labels).collect() == []


def test_weights_are_poisson_numbers(spark):
    w = [r[0] for r in spark.range(20_000).select(labelled._weight(F.col("id").cast("string"), F.lit(3))).collect()]
    assert abs(sum(w) / len(w) - 1) < 0.03 and abs(w.count(0) / len(w) - math.exp(-1)) < 0.02 and max(w) < 10


def test_matches_are_not_looked_for_again_without_bounds(spark, sf):
    from tonegauge.queries import QUERIES

    assert "regexp_instr" not in hits_sql("text", [("send", ("send",), {"n": "1"})], n="{n}")
    plan = QUERIES["document_rule_hits"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_instr" not in plan and "REPARTITION_BY_NUM" in plan  # texts are dealt out before their patterns are tried


def test_automata_count_odd_texts_as_patterns_tried_one_by_one(spark, tmp_path):
    said = corpus.examples()
    forms = [str.upper, lambda s: s.replace(" ", "\u00a0"), lambda s: s.replace(" ", "\u2003\t"), lambda s: s.replace("s", "\u017f"), lambda s: s.replace("k", "\u212a"), lambda s: s.replace(" ", "\u2028"), lambda s: f"{s}\n", lambda s: f"\n{s}\u0130", lambda s: f"x{s}x", lambda s: f"\u00e9{s}\u00e9", lambda s: s.replace(" ", " \U0001f600 ")]
    wide = ["x" * 41 + " needs doing", "a" * 40 + " needs doing", "unless " + "y" * 60 + "we'll", "unless " + "y" * 61 + "we'll", "unless it\nlands we'll", "", None, " needs  doing", "we'll go unless"]
    texts = [*wide, *[f(s) for f in forms for s in said], " ".join(said), "\n".join(reversed(said)) * 3]
    # multiples of the examples' count choose the same two examples for all, so that those in the texts count
    table = pa.table({"doc_id": [len(said) * k for k in range(len(texts))], "text": pa.array(texts, pa.string())})
    pq.write_table(table, f"{tmp_path}/documents.parquet")
    one, other = ({(r.lexicon, r.rule): r.documents for r in queries._in_documents(spark, str(tmp_path), True, indexed).collect()} for indexed in (True, False))
    assert one == other and len(one) > 300 and len(set(one.values())) > 10


def test_rules_in_documents_are_automata(spark, sf):
    plan = queries.document_rule_hits(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "RLIKE" not in plan


def test_gates_are_what_every_match_holds():
    assert automata._gate(r"\ba[b ]{0,40} c(d|e)\b") == r" c(d|e)\b" and automata._gate(r"a.{0,60}b.{1,12}c") == "c"
    assert not any(map(automata._gate, [r"a{0,40}b|c", r"(a{0,40}b)c", r"(x|a{0,40})b", r"a{0,40}?b", r"a{1,2}b", "ab"]))
