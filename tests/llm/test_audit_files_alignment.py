"""Filter audit, token files and cross-tokenizer alignment against plain versions."""

import hashlib
import re
import zlib
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest

from tests.helpers import assert_same
from tonegauge.llm import alignment, filter_audit, token_files
from tonegauge.llm.queries import ORACLE_SQL, QUERIES

WORDS = public_tokenizers.path("word_bpe_49k.json")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# -- filter audit


def plain_audit(docs, labels):
    quality, toxic = {}, {}
    for i, q, t in labels:
        quality[i], toxic[i] = quality.get(i) or q == 1, toxic.get(i) or t == 1
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    rows = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and least[text] < i}
        rows.append((lang or "", {x for x in f if f[x]}, i is not None and bool(quality.get(i)), i is not None and bool(toxic.get(i))))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                there = [r for r in own if not r[1] & set(order[: step - 1])]
                removed = [r for r in there if x in r[1]]
                shapley[x] += len(removed)
                out[part, "".join(order), step] = [len(there) - len(removed), len(removed), sum(x in r[1] for r in own) - len(removed), sum(r[1] == {x} for r in own), sum(r[2] for r in removed), sum(r[3] for r in removed)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(d):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in d.collect()}


def test_audit_of_odd_tables(spark):
    many = " ".join(f"w{i}" for i in range(210))
    docs = [(5, many, "en"), (3, many, "de"), (7, many, None), (9, None, "en"), (8, "", "en"), (2, "AB cd", "en"), (4, "x " * 300, "en"), (6, many + " #", "en"), (None, many, "en"), (None, "", ""), (7, many, None), (3, "other", "de"), (11, "é" * 5 + " A", "en"), (12, "y\x0bz " * 200000, "fr"), (13, "y\x0bz " * 200000, "fr")]
    docs += [(100 + i, "the common text", "en") for i in range(40)]
    labels = [(5, 1, 0), (5, 0, 1), (9, None, 1), (None, 1, 1), (100, 1, 0), (101, 0, 1), (12, 1, None)]
    d = spark.createDataFrame([(*r, "other") for r in docs], "doc_id long, text string, lang string, part string").withColumnRenamed("part", "fails").repartition(3)
    said = spark.createDataFrame([(*r, 1) for r in labels], "doc_id long, quality int, toxic int, n int")
    got = audited(filter_audit.audit(d, said))
    assert got == plain_audit(docs, labels) and len(got) == 600 * 4
    assert filter_audit.audit(d.limit(0), said).count() == 0
    assert audited(filter_audit.audit(d, said.limit(0))) == plain_audit(docs, [])


def test_audit_equals_its_sql(spark, sf):
    assert_same(QUERIES["op11_filter_audit"](spark, sf), sf, ORACLE_SQL["op11_filter_audit"])


def test_audit_counts_before_it_shuffles(spark, sf):
    found = filter_audit.audit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert all("text" not in line for line in plan.split("\n") if "Exchange" in line) and "CartesianProduct" not in plan


def test_edges_and_paths():
    assert len(filter_audit.paths()) == 600 and len({(applied, f) for _, _, applied, f in filter_audit.paths()}) == 80


# -- token files


class _Held:
    """A file in memory that counts the bytes read."""

    def __init__(self, data):
        self.data, self.read = data, 0

    def __call__(self, at, size):
        self.read += size
        return self.data[at : at + size]


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 511, 512, 513, 5000])
def test_codes_of_any_size(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.4, rng.integers(0, 256, n), np.where(rng.random(n) < 0.8, rng.integers(0, 50_000, n), rng.integers(0, 1 << 32, n))).astype(np.uint32)
    held = _Held(b"xyz" + token_files.encode_segment(ids))
    assert (token_files.decode_range(held, 3, n, 0, n) == ids).all()
    for i in range(0, n, max(1, n // 40)):
        held.read = 0
        assert token_files.token_at(held, 3, n, i) == ids[i]
        assert held.read <= 4 * (1 + 8 + token_files.RANKED // 8)  # four levels: a byte, two entries, bits since the entry
        j = min(n, i + 700)
        assert (token_files.decode_range(held, 3, n, i, j) == ids[i:j]).all()


def test_segments_and_documents_over_them(tmp_path):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    docs = [(None if i % 9 == 0 else i, rng.integers(0, 60_000, size).astype(np.uint32)) for i, size in enumerate([0, 5, 900, 0, 3, 250, 64, 64, 128, 1, 0])]
    with pa.OSFile(f"{tmp_path}/x.tok", "wb") as out:
        writer = token_files.FileWriter(out, segment=64)
        for doc_id, ids in docs:
            writer.add(doc_id, ids)
        writer.close()
    with pa.OSFile(f"{tmp_path}/x.tok", "rb") as source:
        reader = token_files.FileReader(source)
        rows = [r for batch in reader.documents(1000) for r in batch.to_pylist()]
        every = np.concatenate([x for _, x in docs])
        assert [(r["doc_id"], r["ids"]) for r in rows] == [(i, x.astype("<u4").tobytes()) for i, x in docs]
        assert [r["start"] for r in rows] == [1000 + int(x) for x in np.cumsum([0] + [len(x) for _, x in docs])[:-1]]
        assert (reader.tokens(40, 1200) == every[40:1200]).all() and all(reader.tokens(i, i + 1)[0] == every[i] for i in range(0, len(every), 37))


def library_ids(texts):
    from tokenizers import Tokenizer

    return [e.ids + [1] for e in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]


def test_files_of_odd_documents(spark, tmp_path):
    long = "long words and 日本語 <|endoftext|> it's 1234 " * 30_000
    docs = [(7, "seven"), (3, None), (None, "nobody's"), (5, ""), (3, "three"), (-4, long), (1 << 40, "far"), (None, None), (6, "six <|startoftext|>")] + [(9, f"nine {i % 3}") for i in range(60)]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, start int").repartition(4)
    path = f"{tmp_path}/files"
    token_files.write_corpus(d, WORDS, path)
    rows = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((i for i, _ in docs), key=lambda i: (i is not None, i))
    expected = sorted(((i is not None, i or 0, np.array(x, "<u4").tobytes()) for (i, _), x in zip(docs, library_ids([t or "" for _, t in docs]), strict=True)))
    assert sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.ids)) for r in rows) == expected
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist() and all(4 * r.n_tokens == len(r.ids) for r in rows)
    every = np.concatenate([np.frombuffer(r.ids, "<u4") for r in rows])
    wanted = [0, len(every) - 1, len(every), -1, None, *range(5, len(every), 9973)]
    found = token_files.tokens_at(spark.createDataFrame([(p, "x") for p in wanted], "position long, token string"), path).collect()
    assert sorted(((r.position, r.token) for r in found), key=repr) == sorted(((p, int(every[p]) if p is not None and 0 <= p < len(every) else None) for p in wanted), key=repr)
    with pytest.raises(Exception, match="token files already"):
        token_files.write_corpus(d, WORDS, path)
    token_files.write_corpus(d.limit(0), WORDS, f"{tmp_path}/none")
    assert token_files.read(spark, f"{tmp_path}/none").count() == 0


def test_files_query(spark, sf):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op12_token_files"](spark, sf).collect())
    start, expected = 0, []
    for (i, _), ids in zip(docs, library_ids([t for _, t in docs]), strict=True):
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == expected


# -- alignment


def plain_alignment(docs):
    """Whole texts through the libraries."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in visible} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in visible)}
    rows, counts = [], {}
    for doc_id, text in docs:
        raw, x, y, groups, links = f" {text or ''}".encode(), [], [], [], []
        if text:
            x, y = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
            p = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
            q = [bytes([int(t[3:5], 16)]) if b.is_byte(i) else t.replace("▁", " ").encode() for i, t in ((i, b.id_to_piece(i)) for i in y)]
            if b"".join(p) != raw or b"".join(q) != raw:
                x, y = [], []
        if x:
            ends = [np.cumsum([len(t) for t in side]).tolist() for side in (p, q)]
            i = j = 0
            for end in sorted(set(ends[0]) & set(ends[1])):
                k, m = ends[0].index(end, i), ends[1].index(end, j)
                groups.append(",".join(map(str, x[i : k + 1])) + "|" + ",".join(map(str, y[j : m + 1])))
                links.append((x[k], y[m]))
                counts[links[-1]] = counts.get(links[-1], 0) + 1
                i, j = k + 1, m + 1
        rows.append((doc_id, len(x), len(y), groups, links))
    best = {}
    for (_, v), n in counts.items():
        best[v] = max(best.get(v, 0), n)
    return sorted(((i, na, nb, len(g), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, na, nb, g, links in rows), key=repr)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = ["", None, " ", "  ", "a ", " a", "a  b", "a▁b c", "it's <s>x</s> <|endoftext|> <unk>", "\x1c x\x00y", "　a  b", "é ́x", "한국어 \U0001f600\U0001f468‍\U0001f469", "a\n\n b \r\n\tc", "  leading and trailing  ", "ﬁ Å   x", "x" * 3000]


def test_alignment_of_odd_texts(spark):
    rng = np.random.default_rng(0)
    letters = list("ab c  \n\t'sDt1.,!éß中▁ ́")
    docs = [(i, t) for i, t in enumerate(ODD)] + [(500 + i, "".join(rng.choice(letters, rng.integers(1, 60)))) for i in range(300)] + [(None, "no id here"), (2, "again two"), (2, "again two")]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, block string").repartition(3)
    expected = plain_alignment(docs)
    for block, heavy in ((alignment.BLOCK, alignment.HEAVY), (200, 10)):  # small blocks; few pairs by broadcast
        got = alignment.align(d, A, B, block_bytes=block, heavy=heavy)
        assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr) == expected
    assert alignment.align(d.limit(0), A, B).count() == 0
    assert [tuple(r[c] for c in COLUMNS[1:]) for r in alignment.align(d.where("text = ''"), A, B).collect()] == [(0, 0, 0, 0, 0, 0, "")]


def test_alignment_of_a_very_long_text(spark):
    text = "Thé quick-brown fox's  12345 jumps; " * 45_000
    got = alignment.align(spark.createDataFrame([(1, text), (2, text[:1000])], "doc_id long, text string"), A, B).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == plain_alignment([(1, text), (2, text[:1000])])


def test_alignment_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_token_alignment"](spark, sf).collect()), key=repr) == plain_alignment(docs)


def test_alignment_never_deals_a_block_out(spark, sf):
    from tonegauge.llm._common import bucketed, set_to

    with set_to(spark, alignment.ALL_KEYS, "false"), set_to(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        rows = bucketed(alignment.encoded(spark.read.parquet(f"{sf}/documents.parquet"), A, B), "block").where("chunk >= 0").select("block", "chunk", "lists")
        aligned = alignment._aligned(rows)
        plan = aligned._jdf.queryExecution().executedPlan().toString()
        known = alignment._scores(bucketed(aligned, "block"), alignment.pair_counts(aligned), 1 << 40)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert all("block" not in line for line in known.split("\n") if "Exchange hashpartitioning" in line)
    assert spark.conf.get(alignment.ALL_KEYS) == "true"


def test_alignment_holds_one_block_at_a_time(spark, sf, monkeypatch):
    plans = []
    for name in ("bucketed", "stored"):
        def kept(df, *args, write=getattr(alignment, name)):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return write(df, *args)

        monkeypatch.setattr(alignment, name, kept)
    assert alignment.align(spark.read.parquet(f"{sf}/documents.parquet"), A, B, block_bytes=20_000).count() > 0
    assert len(plans) == 4
    assert not any("ObjectHashAggregate" in plan for plan in plans)  # it holds the lists of up to 128 blocks


def test_alignment_reads_few_rows_at_a_time_and_collects_chunks_only(spark, sf, monkeypatch):
    scans, plans = [], []
    for name in ("bucketed", "stored"):
        def kept(df, *args, write=getattr(alignment, name)):
            scans.append(int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")))
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return write(df, *args)

        monkeypatch.setattr(alignment, name, kept)
    alignment.align(spark.read.parquet(f"{sf}/documents.parquet"), A, B, block_bytes=20_000, heavy=10)
    assert max(scans[1:]) < 100 < scans[0] == int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize"))  # 4096 rows would be all blocks of a bucket
    lists = [line for line in "".join(plans).split("\n") if "collect_list" in line]
    assert lists and all("chunk" in line for line in lists)


def test_alignment_words_encoded_as_one_text():
    two = alignment.TwoTokenizers(A, B)
    rng = np.random.default_rng(1)
    letters = list("abc'sDt1.,!éß中▁\t\n ") + ["<s>", "<|endoftext|>", "\x1c", "　", "́"]
    texts = [*filter(None, ODD), *["".join(rng.choice(letters, rng.integers(1, 40))) for _ in range(400)], "new\nlines and words", "a \nb", "a\n b", " a b", "a b "]
    assert all(two.words(t) == re.split(r"(?<=\S) ", t) for t in texts)
    given = []

    class Counting:
        def encode_batch_fast(self, batch, library=two.a, **how):
            given.append(len(batch))
            return library.encode_batch_fast(batch, **how)

    words = sorted({w for t in texts for w in two.words(t)})
    alone = [e.ids for e in two.a.encode_batch_fast([f" {w}" for w in words], add_special_tokens=False)]
    two.a = Counting()
    for kind in (False, True):  # after white space a space is no border: a word that ends in it, or is empty, ends a text
        some = [k for k, w in enumerate(words) if kind or (w and not w[-1].isspace())]
        (ids, counts), (_, more) = two.encode([words[k] for k in some])
        assert ids.tolist() == [i for k in some for i in alone[k]] and counts.tolist() == [len(alone[k]) for k in some] and len(more) == len(some)
    closed = sum(bool(w) and not w[-1].isspace() for w in words)
    assert len(given) == 2 and given[0] == -(-closed // alignment.JOINED) and given[1] <= given[0] + len(words) - closed + 1 < len(words)


def test_alignment_block_ends_by_distinct_words(monkeypatch):
    block = alignment._Block(alignment.TwoTokenizers(A, B), 0)
    monkeypatch.setattr(alignment, "WORDS", 3)
    block.add([1], ["a b a b"])
    assert not block.full(1000)
    block.add([2], ["c"])
    assert block.full(1000)
