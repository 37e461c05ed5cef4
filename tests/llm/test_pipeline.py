"""run() of the pipeline against a plain version of its stages."""

import re
import zlib
from fractions import Fraction

import pytest

from tests.llm.test_near_copies import plain_components, plain_repeats, words
from tonegauge.llm import langid

BLANKS = " \t\r\x0b\x0c"


def plain_lines(rows):
    """Later runs of three lines, of fewer lines with fifty words, and later whole texts of fewer lines go."""
    solid = {i: [(n, x.strip(BLANKS)) for n, x in enumerate((t or "").split("\n")) if x.strip(BLANKS)] for i, t in rows}
    first, dead = {}, {i: set() for i in solid}
    for i in sorted(solid):
        bare = [x for _, x in solid[i]]
        for size in (1, 2, 3):
            for p in range(len(bare) - size + 1):
                run = tuple(bare[p : p + size])
                whole = size < 3 and len(bare) == size and sum(len(x.split()) for x in run) < 50
                if size == 3 or whole or sum(len(x.split()) for x in run) >= 50:
                    d0, p0 = first.setdefault((whole, run), (i, p))
                    if d0 != i or p >= p0 + size:
                        dead[i] |= {n for n, _ in solid[i][p : p + size]}
    out = [(i, t if not dead[i] else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in dead[i])) for i, t in rows]
    return [(i, t) for i, t in out if not dead[i] or t.strip()]


def plain_passages(rows):
    later = {}
    for i, a, b, is_first in plain_repeats(rows, words, 50):
        if not is_first:
            later.setdefault(i, set()).update(range(a, b))
    out = []
    for i, t in rows:
        if i in later:
            at = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)] + [len(t)]
            t = t[: at[0]] + "".join(t[at[n] : at[n + 1]] for n in range(len(at) - 1) if n not in later[i])
            if not t.strip():
                continue
        out.append((i, t))
    return out


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    long = docs.where("length(text) > 900").orderBy("doc_id").limit(2).collect()
    odd = [(90000, None, "en"), (90001, "", "en"), (90002, "12 34 !", "en"), (90003, long[0].text.replace(" ", "  "), None), (90004, long[1].text + " and then some more", "en"), (90005, "x " + long[0].text, "en")]
    extra = spark.createDataFrame([(i, t, lang, "web", len(t or "")) for i, t, lang in odd], docs.schema)
    docs.unionByName(extra).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_run_equals_the_plain_version(spark, source):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{source}/documents.parquet")
    model = langid.train(docs)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    kept = []
    for i, t in rows:
        (label,), (share,), (sure,) = model.label([t or ""])
        if label != "und" and (share >= 0.4 or sure >= 0.9):
            kept.append((i, t))
    kept = plain_lines(kept)
    groups = plain_components(kept, 5, Fraction(4, 5))
    kept = plain_passages([(i, t) for i, t in kept if groups[i][1] == i])

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, spots = {}, {}
    for r in cp.run(spark, source).collect():
        got.setdefault(r.doc_id, []).append(r)
        spots.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(got) == {i for i, _ in kept} and len(kept) > 50
    for i, t in kept:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(got[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            part = ids[at : at + r.length]
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
            at += r.length
        assert at == len(ids)
    for pieces in spots.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096


def test_stages_take_odd_tables(spark):
    """Nulls in every column, repeated rows, columns of the operators' names, an empty table."""
    import corpus_pipeline as cp

    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, component_id long, _id int"
    rows = [(1, "the cat and the dog went home", "en", None, None, 0.5, "s", 9, 1)] * 2 + [(None, None, None, None, None, None, None, None, None), (2, "", "fr", "x", 0, None, None, None, None), (3, "le chat et le chien", "fr", "x", 19, None, "t", 1, 2)]
    docs = spark.createDataFrame(rows, schema)
    for table in (docs, docs.limit(0)):
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, table, "")
            assert out.columns == docs.columns, name
            assert {r.spans for r in out.collect()} <= {"s", "t", None}, name
        assert cp.STAGES[-1][1](spark, table, "").count() == (5 if table is docs else 0)
