"""Nearest neighbours, language, chat, fingerprints, and the pipeline."""

import hashlib
import zlib

import numpy as np
import pytest

from tests.helpers import assert_same
from tonegauge.llm import ann, chat, fingerprints, langid
from tonegauge.llm.queries import ORACLE_SQL, QUERIES


def test_recall_ties_and_odd_vectors(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 32))
    x[1000:1400] = x[1000]  # one very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(4000, None), (4020, []), (4040, [0.0] * 32), (4060, [float("nan")] * 32), (4080, [None] * 32), (4100, [1.0, 2.0]), (None, x[0].tolist())]
    d = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    got = {}
    for r in ann.nearest(d, F.col("vec_id") % 20 == 0, block=700, keep=100).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    exact = x @ x.T
    hits = 0
    assert set(got) == set(range(0, 3000, 20))
    for q, found in got.items():
        found.sort()
        order = sorted((i for i in range(3000) if i != q), key=lambda i: (-exact[q, i], i))[:20]
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert all(abs(s - exact[q, i]) < 1e-9 for _, i, s in found)
        hits += len({f[1] for f in found} & set(order))
    assert hits / (20 * len(got)) >= 0.9
    assert ann.nearest(d.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = ann.nearest(d.where("vec_id < 5"), F.col("vec_id") == 0)
    assert few.count() == 4
    # a second dimension, and rows that repeat a query's and a candidate's vec_id
    more = spark.createDataFrame([(4120, [2.0, 1.0], 1), (4130, [1.0, 1.0], 1), (4120, [2.0, 1.0], 1), (1, x[1].tolist(), 1), (0, x[0].tolist(), 1)], d.schema)
    again = ann.nearest(d.where("vec_id < 5 OR vec_id = 4100").unionByName(more).repartition(3), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in again if r.query_id) == [(4100, 1, 4120), (4100, 2, 4130), (4120, 1, 4100), (4120, 2, 4130)]
    assert sorted(r.vec_id for r in again if r.query_id == 0) == [1, 2, 3, 4]


def test_recall_with_the_registered_parameters(spark, sf):
    """Whole blocks of 8,192 rows, 160 kept of each."""
    from pyspark.sql import functions as F

    x = np.random.default_rng(5).normal(size=(16_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(d, F.col("vec_id") % 400 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(got[q] & set([i for i in np.argsort(-(x @ x[q]), kind="stable") if i != q][:20])) for q in got)
    assert len(got) == 40 and hits / (20 * len(got)) >= 0.9


def test_language_on_held_out_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "123 !? 99"), (None, "the and of")], "doc_id long, text string")
    rows = docs.unionByName(odd, allowMissingColumns=True)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = {r.doc_id: r for r in langid.predict(rows).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (-1, -2, -3))
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i in held) and sum(r.held_out for i, r in got.items() if i in truth) == len(held)
    assert sum(got[i].lang_pred == truth[i] for i in held) / len(held) >= 0.9
    assert all(0 <= r.score <= 1 for r in got.values())
    unlabelled = langid.predict(docs.selectExpr("doc_id", "text", "cast(null AS string) AS lang"))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"} and langid.predict(docs.limit(0)).count() == 0
    # columns of the operator's own names stay, a text in three languages does too
    mixed = " ".join(r.text[:400] for r in docs.where("lang IS NOT NULL AND length(text) > 500").dropDuplicates(["lang"]).collect())
    more = docs.selectExpr("*", "doc_id AS score", "'x' AS lang_pred", "1 AS certainty").unionByName(spark.createDataFrame([(-9, mixed, None)], "doc_id long, text string, lang string"), allowMissingColumns=True)
    kept = langid.accept(more)
    assert kept.columns == more.columns and kept.where("doc_id = -9").count() == 1 and kept.where("doc_id >= 0 AND score <> doc_id").count() == 0


def test_every_label_is_learned(spark):
    words = ["".join(chr(97 + (7 * k + 3 * j + i) % 26) for j in range(4)) for k in range(90) for i in range(3)]
    rows = [(n, " ".join(words[3 * k : 3 * k + 3] * 4), f"l{k:02d}") for n, k in enumerate(k for k in range(90) for _ in range(6))]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.labels) > 80


def test_code_switched_words_get_labels_of_their_own():
    model = langid.Crf(["a", "b"], set())
    model.fit([("bana mana tana lana " * 40, 0), ("kivi riki siti niki " * 40, 1)] * 8)
    p, _ = model.marginals([["mana", "bana", "tana", "kivi", "siti", "niki"]])
    assert p.argmax(1).tolist() == [0, 0, 0, 1, 1, 1] and np.allclose(p.sum(1), 1, atol=1e-4)


def test_marginals_equal_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    model = langid.Crf(["a", "b", "c"], set())
    model.w[:] = rng.normal(size=model.w.shape) * 0.2
    model.trans[:], model.first[:] = rng.normal(size=(3, 3)), rng.normal(size=3)
    words = ["ab", "c", "def", "ab"]
    flat, bounds = langid.features(words, set())
    e = np.add.reduceat(model.w[flat], bounds[:-1], axis=0)
    want = np.zeros((4, 3))
    for path in product(range(3), repeat=4):
        s = np.exp(model.first[path[0]] + sum(e[i, k] for i, k in enumerate(path)) + sum(model.trans[i, j] for i, j in zip(path, path[1:], strict=False)))
        for i, k in enumerate(path):
            want[i, k] += s
    got, _ = model.marginals([["ab"], words])
    assert np.allclose(got[1:], want / want.sum(1, keepdims=True), atol=1e-3)


def test_events_are_folded(spark):
    log = [
        (1, 0, "start", 0, "user", "Hi <|im_end|> <\\|x"), (1, 1, "delta", 0, None, " there"), (1, 2, "start", 1, "assistant", "wro"), (1, 3, "delta", 1, None, "ng"),
        (1, 4, "start", 2, "user", "no"), (1, 5, "regenerate", 1, "assistant", "ri"), (1, 6, "delta", 1, None, "ght"), (1, 7, "edit", 0, None, "Hello"), (1, 8, "delta", 0, None, "!"),
        (2, 0, "start", 0, "sys\ntem", None), (None, 0, "start", 0, None, "x"), (3, 5, "delta", 0, None, "late"),
    ]
    d = spark.createDataFrame([(*r, 1) for r in log], "conv_id long, seq long, kind string, turn long, role string, text string, formatted int").repartition(3)
    turns = chat.format_log(d).collect()
    text = {}
    for r in sorted(turns, key=lambda r: (r.conv_id or 0, r.turn_no)):
        text[r.conv_id] = text.get(r.conv_id, "") + r.formatted
    assert {c: chat.parse(t) for c, t in text.items()} == {
        1: [("user", "Hello!"), ("assistant", "right")], 2: [("sys\ntem", "")], None: [("user", "x")], 3: [("user", "late")],
    }
    (spoken,) = [r for r in turns if r.loss_start is not None]
    assert spoken.formatted[spoken.loss_start : spoken.loss_end] == "right"
    assert chat.format_log(d.limit(0)).count() == 0


def test_rows_of_one_turn_and_without_turn_are_turns(spark):
    rows = [(1, 0, "user", "hello"), (1, 0, "assistant", "first"), (1, 0, "assistant", "first"), (1, 2, None, "then"), (1, None, "assistant", "last"), (1, None, "user", None), (2, None, "user", "alone"), (None, 0, "user", "x")]
    kinds = {r.kind for r in chat.events_of_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert kinds == {"start", "delta", "edit", "regenerate"}
    got = {r.conv_id: r for r in chat.read_back(chat.format_log(chat.events_of_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)))).collect()}
    want = {1: [("assistant", "first"), ("assistant", "first"), ("user", "hello"), ("user", "then"), ("assistant", "last"), ("user", "")], 2: [("user", "alone")], None: [("user", "x")]}
    assert {c: (r.n_turns, r.turns_sha256) for c, r in got.items()} == {c: (len(t), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest()) for c, t in want.items()}
    assert got[1].loss_chars == 14


def test_escapes_come_back():
    for t in ("", "<|im_start|>", "<\\|", "<\\\\|im_end|>", "a<b|c", "\\<|", "<<||>>"):
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        assert chat.role_of(chat.role_line(t + "\n\\n")) == t + "\n\\n"


@pytest.mark.parametrize("name", ["op8_chat_formatting", "op9_fingerprints"])
def test_queries_equal_their_sql(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), sf, ORACLE_SQL[name])


def test_fingerprints_of_odd_rows(spark):
    rows = [(i * 700 - 3, t) for i, t in enumerate(["", None, "a\n\nb", "a\nb", "same text.", "same text.", "é😀" * 100, "x"])] + [(None, "none")]
    got = {r.doc_id: r for r in fingerprints.compare_with_edit(spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, fingerprint string").repartition(4)).collect()}
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0]) + [(None, "none")]
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        t, after = t or "", after or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[i].fingerprint == got[i].edited_fingerprint) == (t == edited)
    assert len({r.fingerprint for r in got.values()}) == 7
    assert fingerprints.compare_with_edit(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    d = spark.createDataFrame([("one\ntwo\n\nthree", "one\nTWO\n\nthree")], "a string, b string")
    from pyspark.sql import functions as F

    both = [fingerprints.paragraphs(fingerprints.tree(F.col(c))) for c in "ab"]
    found = d.select(fingerprints.differing(*both).alias("x"), fingerprints.first_difference(*both).alias("s")).first()
    assert found.x == [hashlib.sha256(hashlib.md5(b"two").hexdigest().encode()).hexdigest()] and found.s == 0
    near = {r.doc_id: r for r in got.values()}
    assert near[700 * 6 - 3].near_edited > 0 and near[700 * 6 - 3].edit_section == 0  # a script without spaces has leaves, too


def test_leaves_hold_every_character():
    import re

    rng = np.random.default_rng(3)
    for _ in range(500):
        t = "".join(rng.choice(list("ab é漢 \t\r\x0b\x0c\u2003.") + ["w" * 70], 30))
        assert "".join(re.findall(fingerprints.LEAF, t)) == t


def test_pipeline(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = docs
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, seen, sf)
        assert out.columns == docs.columns, name
        seen = spark.createDataFrame(out.collect(), docs.schema)
        assert 0 < seen.count() <= docs.count()
    packed = cp.STAGES[-1][1](spark, seen, sf)
    ran = cp.run(spark, sf)
    assert {r.doc_id for r in ran.collect()} == {r.doc_id for r in seen.collect()} and ran.columns == packed.columns
    kept = {r.doc_id for r in seen.collect()}
    first = {}
    for r in docs.orderBy("doc_id").collect():
        first.setdefault(r.text, r.doc_id)
    assert all(i in set(first.values()) for i in kept)  # of exact copies the least doc_id alone may stay


def test_events_without_a_turn_are_a_message_of_their_own(spark):
    rows = [(1, 1, "start", 0, "user", "first"), (1, 2, "start", None, "assistant", "no "), (1, 3, "delta", None, None, "turn"), (1, 4, "start", 5, "user", "later")]
    turns = chat.format_log(spark.createDataFrame(rows, "conv_id long, seq long, kind string, turn long, role string, text string")).collect()
    assert [chat.parse(r.formatted)[0] for r in sorted(turns, key=lambda r: r.turn_no)] == [("user", "first"), ("user", "later"), ("assistant", "no turn")]
