"""n-gram join, repeated passages and lines against plain versions and SQL."""

import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from tests.helpers import assert_same
from tonegauge.llm import line_dedup, ngram_join, suffix_dedup
from tonegauge.llm.queries import ORACLE_SQL, QUERIES

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
W = [f"q{i}" for i in range(200)]


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def rows(sf):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    out = [(r["doc_id"], r["text"]) for r in t]
    near = [" ".join(W[:k] + [f"x{k}"] + W[k + 1 : 150]) for k in range(5, 140, 9)]
    out += [(6000 + i, x) for i, x in enumerate(near)] + [(6100 + i, near[0]) for i in range(40)]
    return out + [
        (5000, None), (5001, ""), (5002, " \t"), (5003, "One two"), (5004, "one  TWO"), (5005, "one"), (5006, "a b c"), (5007, " ".join(W[:60])), (5008, "x " + " ".join(W[5:70]) + " tail"),
        (5009, "z " * 200), (5010, "Z " * 120), (5011, " ".join(W[100:149])), (5012, "a\nb\nc\n\nd\nb\nc \nd\n"), (5013, "zz\nb\n\nc\nd"), (5014, "u\n" * 9),
    ]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 7) for r in rows] + [(None, "a b c d e f", 7), (5006, "a b c", 7)], "doc_id long, text string, component_id int").repartition(5)


def plain_components(rows, k, t):
    sets = {}
    for i, x in rows:
        w = _WORD.findall(fold(x))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    common, where, parent = Counter(), defaultdict(list), {i: i for i in sets}
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    for ids in where.values():
        ids.sort()
        common.update((a, b) for n, a in enumerate(ids) for b in ids[n + 1 :])

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), o in common.items():
        if t.denominator * o >= t.numerator * (len(sets[a]) + len(sets[b]) - o):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "t"), [(3, Fraction(9, 10)), (5, Fraction(4, 5)), (2, Fraction(1, 2))])
def test_components_equal_the_plain_version(docs, rows, k, t):
    got = ngram_join.jaccard_components(docs, k, t).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(rows, k, t)


@pytest.mark.parametrize(("k", "t"), [(3, Fraction(9, 10)), (5, Fraction(4, 5)), (2, Fraction(1, 2))])
def test_links_equal_the_plain_version(docs, rows, k, t):
    sets = {}
    for i, x in rows:
        w = words(x)
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    n_links = Counter()
    for a, s in sets.items():
        n_links[a] = sum(a != b and bool(s) and t.numerator * max(len(s), len(z)) <= t.denominator * min(len(s), len(z)) and t.denominator * len(s & z) >= t.numerator * len(s | z) for b, z in sets.items())
    got = ngram_join.link_counts(docs, k, t).collect()
    assert len(got) == len(sets) and {r.doc_id: (r.n_shingles, r.n_links) for r in got} == {i: (len(s), n_links[i]) for i, s in sets.items()}
    assert max(n_links.values()) > 40


def test_links_query_equals_its_sql(spark, sf):
    assert_same(QUERIES["op3_ngram_links"](spark, sf), sf, ORACLE_SQL["op3_ngram_links"])


def test_one_of_each_and_empty(docs, spark):
    kept = {r.doc_id for r in ngram_join.one_of_each(docs).collect()}
    assert {None, 5000, 5001, 5002, 5005, 6000} <= kept and not any(6100 <= (i or 0) < 6140 for i in kept)
    assert ngram_join.jaccard_components(docs.limit(0)).count() == 0


def plain_repeats(rows, units, least):
    found = {i: units(t or "") for i, t in rows}
    at = defaultdict(list)
    for i in sorted(found):
        for p in range(len(found[i]) - least + 1):
            at[tuple(found[i][p : p + least])].append((i, p))
    spots = defaultdict(set)
    for places in at.values():
        first = places[0]
        if len(places) > 1:
            for i, p in places:
                spots[i, i == first[0] and p < first[1] + least].add(p)
    out = set()
    for (i, is_first), ps in spots.items():
        start = stop = None
        for p in sorted(ps):
            if start is None or p > stop:
                if start is not None:
                    out.add((i, start, stop, is_first))
                start = p
            stop = p + least
        out.add((i, start, stop, is_first))
    return out


def words(t):
    return _WORD.findall(fold(t))


def solid_lines(t):
    return [x for x in (line.strip(" \t\r\x0b\x0c") for line in t.split("\n")) if x]


@pytest.mark.parametrize(("find", "units", "least"), [(suffix_dedup.passages, words, 50), (line_dedup.repeated_runs, solid_lines, 3)])
def test_repeats_equal_the_plain_version(docs, rows, find, units, least):
    got = [tuple(r) for r in find(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_repeats(rows, units, least)
    assert find(docs.limit(0)).count() == 0


def test_cutting_keeps_first_occurrences_and_columns(docs):
    left = {r.doc_id: r for r in suffix_dedup.without_repeats(docs).collect()}
    assert left[5008].text.split() == ["x", *W[60:70], "tail"] if 5007 in left else True
    assert left[5005].component_id == 7 and left[5011].text == " ".join(W[100:149]) and None in left
    lines = {r.doc_id: r.text for r in line_dedup.clean(docs).collect()}
    assert lines[5012] == "a\nb\nc\n\nd\n" and lines[5013] == "zz\n" and lines[5014] == "u\nu\nu\n"


def test_short_texts_and_wordy_lines_repeat(spark):
    long, half = " ".join(W[:50]), " ".join(W[:30])
    texts = {
        1: "short", 2: " short\n\n", 3: "short\nlines", 4: "short\nlines", 5: "short\nother\nthird", 6: f"p\n{long}\nq", 7: f"{long}\nr", 8: long + "\n" + long,
        9: f"s\n{half}\n{half} x\nt", 10: f"{half}\n{half} x", 11: " ".join(W[:49]) + "\nu\nv", 12: " ".join(W[:49]) + "\nw\ny", 13: None, 14: "", 15: f"{half}\nz\n{half} x",
        16: "a\nb\nc", 17: f"a\nb\nc\n{long}",
    }
    d = spark.createDataFrame([*texts.items(), (1, "short"), (None, "short")], "doc_id long, text string")
    kept = {**texts, 7: "r"}
    for gone in (2, 4, 8, 10, 17):
        del kept[gone]
    for parts in (1, 7):
        left = line_dedup.clean(d.repartition(parts)).collect()
        assert {r.doc_id: r.text for r in left if r.doc_id} == kept and sum(r.doc_id is None for r in left) == 1
    got = {r.doc_id: r.deleted_lines for r in line_dedup.digests(d, words=50).collect()}
    assert {i: n for i, n in got.items() if n} == {2: 1, 4: 2, 7: 1, 8: 2, 10: 2, 17: 4}
    assert line_dedup.clean(d.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op3_ngram_jaccard", "op5_suffix_dedup", "op6_line_dedup"])
def test_queries_equal_their_sql(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), sf, ORACLE_SQL[name])


def test_columns_of_any_name_stay(spark):
    long = " ".join(W[:120])
    rows = [(1, long, 10, 1, 2, "g"), (2, long, 11, 1, 2, "g"), (3, "other words", 12, 1, 2, None), (None, None, 13, 1, 2, "h")]
    d = spark.createDataFrame(rows, "doc_id long, text string, _id int, spans int, cuts int, _gone string")
    for stage in (line_dedup.clean, suffix_dedup.without_repeats, ngram_join.one_of_each):
        left = stage(d)
        assert left.columns == d.columns
        assert sorted((r.doc_id or 0, r._id, r.spans, r._gone) for r in left.collect()) == [(0, 13, 1, "h"), (1, 10, 1, "g"), (3, 12, 1, None)], stage


def test_components_say_when_they_are_not_complete(spark):
    from tonegauge.llm._graph import components

    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.component for r in components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        components(chain, most_rounds=1)


def test_a_doc_id_with_several_texts(spark):
    """Each text is a document of its own; none loses words that it doesn't repeat."""
    common = " ".join(f"c{i}" for i in range(70))
    own = " ".join(f"o{i}" for i in range(400))
    lines_ = "\n".join(f"line {i}" for i in range(9))
    rows = [(1, common + " " + own), (1, "short and " + common), (1, "short and " + common), (2, common), (3, "x\n" + lines_), (3, "y\nz\n" + lines_ + "\nw"), (3, "alone"), (4, "alone"), (None, common)]
    d = spark.createDataFrame([(*r, len(r[1]), 7, "h") for r in rows], "doc_id long, text string, n_chars long, _id int, _hash string").repartition(3)
    for left in (suffix_dedup.without_repeats(d), line_dedup.clean(d)):
        assert left.columns == d.columns
        assert all(r.n_chars == len(r.text) and r._id == 7 for r in left.collect())
    texts = [r.text for r in suffix_dedup.without_repeats(d.where("doc_id < 3 OR doc_id IS NULL")).collect()]
    # the first of doc_id 1's texts, by hash, keeps the passage; doc_id 2 was nothing else, the null doc_id takes no part
    assert len(texts) == 4 and sum(common in t for t in texts) in (2, 3) and sum(own in t for t in texts) == 1 and common in texts
    kept = [r.text for r in line_dedup.clean(d.where("doc_id IN (3, 4)")).collect()]
    assert sum(lines_ in t for t in kept) == 1 and sorted(t for t in kept if lines_ not in t)[0] == "alone" and kept.count("alone") == 1
    assert {r.doc_id for r in suffix_dedup.passages(d).collect()} == {1, 2} and line_dedup.digests(d).count() == len(rows)
