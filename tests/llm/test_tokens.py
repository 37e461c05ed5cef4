"""BPE, token counts and packing against the libraries themselves."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tonegauge.llm import bpe, packing, token_counts

RANKS, PATTERN, WORDS = P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, _1 int"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def texts(sf):
    import pyarrow.parquet as pq

    rnd = random.Random(7)
    letters = "aetsnoi  \n\t\x1c\x00  ABZ09é日本😀́'sll're.,!?-_=*#xyz"
    odd = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    return pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()[:60] + odd + ["", " ", "a" * 5000, " " * 3000, "<|endoftext|>", "word " * 9000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None, 1) for i, t in enumerate(texts)] + [(9000, None, None, 1), (None, "no id", "en", None), (3, texts[3], None, 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_encoder_equals_the_library(library, texts):
    enc = bpe.encoder(RANKS, PATTERN)
    assert [enc.encode(t) for t in texts] == [library.encode_ordinary(t) for t in texts]
    assert all(enc.decode_packed(enc.encode_packed(t)) == t.encode() for t in texts)


def test_appends_and_edits_keep_the_table_exact():
    enc, rnd = bpe.encoder(RANKS, PATTERN), random.Random(3)
    piece = bpe.PieceTable(enc)
    for _ in range(40):
        piece.append(bytes(rnd.choice(b"aeitrns") for _ in range(rnd.randint(0, 9))))
        assert piece.ids() == enc.encode_piece(piece.piece)
        a = rnd.randint(0, len(piece.piece))
        piece.replace(a, min(len(piece.piece), a + rnd.randint(0, 4)), bytes(rnd.choice(b"aeitrns ") for _ in range(rnd.randint(0, 4))))
        assert piece.ids() == enc.encode_piece(piece.piece)


def test_no_token_is_looked_for_beyond_the_longest_with_its_end():
    import copy

    class Counted(dict):
        looked = 0

        def get(self, *a):
            self.looked += 1
            return super().get(*a)

    enc = copy.copy(bpe.encoder(RANKS, PATTERN))
    enc.ranks = Counted(enc.ranks)
    piece = b"zqxvjkwpzqxvjkwpzqxvjkwp"
    assert enc._table(piece) == bpe.encoder(RANKS, PATTERN)._table(piece) and enc.ranks.looked <= 4 * len(piece)


def test_digests(docs, library, texts):
    got = {r.doc_id: r for r in bpe.encode_decode_digests(docs, RANKS, PATTERN).collect()}
    for i, t in [*enumerate(texts), (9000, ""), (None, "no id")]:
        ids = np.array(library.encode_ordinary(t), "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert bpe.encode_decode_digests(docs.limit(0), RANKS, PATTERN).count() == 0
    both = bpe.decode_documents(bpe.encode_documents(docs, RANKS, PATTERN), RANKS, PATTERN)
    assert {r.doc_id: bytes(r.decoded) for r in both.collect()}[0] == texts[0].encode()


def test_counts_follow_edits(docs, library, texts):
    rnd = random.Random(5)
    enc = bpe.encoder(RANKS, PATTERN)
    for t in rnd.sample(texts[:460], 80):
        tree = token_counts.TokenTree(t, enc)
        for _ in range(4):
            a = rnd.randint(0, len(tree.text))
            b, by = min(len(tree.text), a + rnd.choice([0, 1, 3, 30])), "".join(rnd.choice("ae t's\n 9é") for _ in range(rnd.choice([0, 1, 8])))
            want = tree.text[:a] + by + tree.text[b:]
            assert tree.replace(a, b, by) == len(library.encode_ordinary(want)) and tree.text == want
    for r in token_counts.count_tokens(docs, RANKS, PATTERN).where("doc_id < 9000").collect():
        t = texts[r.doc_id]
        assert (r.n_tokens, r.edited_tokens) == (len(library.encode_ordinary(t)), len(library.encode_ordinary(token_counts.apply_edits(t, token_counts.sample_edits(t)))))


def test_packing_is_whole_gapless_and_tight(docs, texts):
    tokenizer = Tokenizer.from_file(WORDS)
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in [*enumerate(texts), (9000, ""), (None, "no id")]}
    rows = packing.pack(docs, WORDS).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, own in ids.items():
        covered = sorted(x for s, n in pieces[i] for x in range(s, s + n))
        assert covered == sorted(list(range(len(own))) * (2 if i == 3 else 1))
    padded = 0
    for parts in sequences.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0
        size = sum(n for _, n in parts)
        assert size <= 4096
        padded += 0 if size & (size - 1) == 0 else 4096 - size
    assert padded <= 0.02 * sum(map(len, ids.values()))


def test_harmonic_classes():
    for n in range(1, 9000, 37):
        cuts = packing.harmonic_cuts(n)
        assert sum(cuts) == n and all(0 < c <= 4096 for c in cuts)
