"""Cross-tokenizer alignment in relational steps.

Two tokenizers cut the same bytes (a space and the text) into tokens A and B. Where a token of each ends, a cut:
cuts divide a document into groups, and the two tokens that end at a cut are linked.

Neither tokenizer joins what stands on the two sides of a space after another character than white space, so a text
falls into words (with their white space) that are aligned alike wherever they stand. Documents are taken in blocks;
a block's distinct words, end to end, are its dictionary, in chunks of ``CHUNK`` words, and the relational steps run
over these instead of every occurrence:

1. tokens by ``posexplode`` of where they end in the chunk, cuts by an equi-join of A's and B's tokens on chunk and
   end; a chunk's cuts in order number its groups and give their texts and links;
2. counts of linked pairs of ids, each word's links times its occurrences; the highest of each B id;
3. links get their pair's count by a join: pairs that hold a ``1 / HEAVY`` of all links or more (so at most ``HEAVY``
   rows) by broadcast, the others, of which none is large, by shuffle;
4. each block's documents, as lists of word numbers, meet its dictionary's chunks (a cogroup), sum up and join their
   words' results in order.

Lists are collected by sorting: hash aggregation would hold up to 128 blocks' dictionaries in a task's heap, so as many
as a bucket has, which grows with the input. For the same reason tables are read back ``SCANNED`` rows at a time: Spark's
reader takes 4096 rows, and a bucket has fewer. The JVM has lists of a chunk only, Python those of one block at a time.

Defined results: a null or empty text has no tokens, nor has one whose joined tokens' bytes differ from its own (as
with U+2581); rows that repeat a doc_id, or have a null one, are documents of their own; a text without spaces is one
word, however long; special tokens' strings are plain text; ties of a B id's highest count all count as best; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bucketed, give_back, id_text, no_cycles, pieces, record_batch, set_to, stored, tidy

#: Bytes of texts in a block, and words (distinct in each piece that is added), after which it ends; words in a chunk of its dictionary; occurrences of words in a row of documents; words that the libraries get at a time.
BLOCK, WORDS, CHUNK, OCCURRENCES, AT_ONCE = 32_000_000, 2_000_000, 4096, 1_000_000, 20_000
#: Words that A's library gets as one text.
JOINED = 500
#: Pairs that hold at least this part of all links are broadcast.
HEAVY = 100_000
_BORDER = re.compile(r"(?<=\S) ")
#: Rows of documents, and of chunks, that Python gets at a time; rows of blocks or chunks that a scan reads at a time.
TEXTS, ROWS, SCANNED = 1000, 1, 4
#: chunk from 0: lists are A's ids, their ends and word numbers, B's ids and their ends, and each word's occurrences. Below 0: documents (doc_ids, tokens of each side, words).
_LISTS = pa.list_(pa.list_(pa.int32()))
_ENCODED = pa.schema([("block", pa.int64()), ("chunk", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int64())), ("n_b", pa.list_(pa.int64())), ("words", _LISTS), ("lists", _LISTS)])
ENCODED = "block long, chunk int, doc_ids array<long>, n_a array<long>, n_b array<long>, words array<array<int>>, lists array<array<int>>"


class TwoTokenizers:
    """Both libraries, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        from .packing import _byte_letters

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        back = {letter: byte for byte, letter in _byte_letters().items()}
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = {i: bytes(map(back.__getitem__, t)) for t, i in vocabulary.items() if all(x in back for x in t)}
        self.b = SentencePieceProcessor(model_file=b_path)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.a_sizes, self.b_sizes = np.zeros(max(self.a_bytes) + 1, np.int32), np.array([len(x) for x in self.b_bytes], np.int32)
        for i, x in self.a_bytes.items():
            self.a_sizes[i] = len(x)
        self.a_letters, self.b_letters = (np.frombuffer(b"".join(x), np.uint8) for x in ([self.a_bytes.get(i, b"") for i in range(len(self.a_sizes))], self.b_bytes))
        self.space = self.b.piece_to_id("▁")
        self.local = not any(re.search("[^▁]▁", p) for p in names)  # else a piece could join two words

    def words(self, text: str) -> list[str]:
        """Words, each without the space that it starts with."""
        if not self.local:
            return [text]
        if text[0] != " " and "  " not in text and "\n " not in text and text.replace("\n", "").isprintable():  # no other white space: every space is a border
            return text.split(" ")
        return _BORDER.split(text)

    def encode(self, words: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Tokens of some words, end to end, with how many each has, of both sides."""
        b = [x if w else [self.space] for w, x in zip(words, self.b.encode(words, num_threads=1), strict=True)]  # of the empty word only its space is left
        return self._a_tokens(words), (_flat(b), _counts(b))

    def _a_tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words are borders of a text of many, as they are of documents."""
        if self.local:
            bounds = sorted({*range(0, len(words), JOINED), *[i + 1 for i, w in enumerate(words) if not w or w[-1].isspace()], len(words)})  # after white space a space is no border
            ids = _flat([e.ids for e in self.a.encode_batch_fast([f" {' '.join(words[i:j])}" for i, j in pairwise(bounds)], add_special_tokens=False)])
            ends, wanted = np.cumsum(self.a_sizes[ids]), np.cumsum([len(w.encode()) + 1 for w in words])
            last = np.searchsorted(ends, wanted)
            if last[-1] == len(ids) - 1 and (ends[last] == wanted).all():
                return ids, np.diff(last, prepend=-1).astype(np.int32)
        each = [e.ids for e in self.a.encode_batch_fast([f" {w}" for w in words], add_special_tokens=False)]
        return _flat(each), _counts(each)

    def joined(self, a: list[int], b: list[int]) -> tuple[bytes, bytes]:
        return b"".join([self.a_bytes.get(i, b"") for i in a]), b"".join([self.b_bytes[i] for i in b])


_TOKENIZERS: dict[tuple[str, str], TwoTokenizers] = {}


def two_tokenizers(a_path: str, b_path: str) -> TwoTokenizers:
    if (a_path, b_path) not in _TOKENIZERS:
        _TOKENIZERS[a_path, b_path] = TwoTokenizers(a_path, b_path)
    return _TOKENIZERS[a_path, b_path]


def _nested(rows: list[list[np.ndarray] | None]) -> pa.Array:
    """A list of lists of numbers for each row."""
    solid = [x for row in rows for x in row or ()]
    inner = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in solid])]).astype(np.int32), np.concatenate([*solid, np.zeros(0, np.int32)]).astype(np.int32))
    bounds = np.concatenate([[0], np.cumsum([len(row or ()) for row in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(bounds, inner, mask=pa.array([row is None for row in rows]))


class _Block:
    """Documents as word numbers, and the words' tokens."""

    def __init__(self, two: TwoTokenizers, number: int):
        self.two, self.number, self.bytes = two, number, 0
        self.pieces: list[tuple[np.ndarray, pa.Array]] = []
        self.n_words = 0
        self.doc_ids: list[int | None] = []
        self.sizes: list[int] = []

    def add(self, doc_ids: list, texts: list[str]) -> None:
        words: list[str] = []
        for text in texts:
            own = self.two.words(text) if text else []
            words += own
            self.sizes.append(len(own))
            self.bytes += len(text)
        self.doc_ids += doc_ids
        found = pa.array(words, pa.string()).dictionary_encode()
        self.pieces.append((found.indices.to_numpy(), found.dictionary))
        self.n_words += len(found.dictionary)

    def _numbered(self) -> tuple[list[np.ndarray], pa.Array]:
        """Documents as word numbers, and the distinct words."""
        found = pa.concat_arrays([pa.array([], pa.string()), *[d for _, d in self.pieces]]).dictionary_encode()
        new = found.indices.to_numpy()
        firsts = np.cumsum([0, *[len(d) for _, d in self.pieces]]).tolist()
        flat = np.concatenate([_NONE, *[new[first:last][x] for (x, _), first, last in zip(self.pieces, firsts, firsts[1:], strict=False)]])
        self.pieces = []
        return np.split(flat, np.cumsum(self.sizes)[:-1]), found.dictionary

    def full(self, most_bytes: int) -> bool:
        return self.bytes >= most_bytes or self.n_words >= WORDS

    def _tokens(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Tokens of some words, with how many each has, of both sides; and which words they give back."""
        two = self.two
        sides = two.encode(words)
        raw = [f" {w}".encode() for w in words]
        sizes, whole = np.fromiter(map(len, raw), np.int64, len(raw)), np.frombuffer(b"".join(raw), np.uint8)
        fits = [_give_back(ids, n, of, letters, sizes, whole) for (ids, n), of, letters in zip(sides, (two.a_sizes, two.b_sizes), (two.a_letters, two.b_letters), strict=True)]
        return *sides, fits[0] & fits[1]

    def rows(self) -> Iterator[pa.RecordBatch]:
        give_back()
        docs, words = self._numbered()
        give_back()
        a_ids, a_counts, b_ids, b_counts, good = [_NONE], [_NONE], [_NONE], [_NONE], [np.zeros(0, bool)]
        for first in range(0, len(words), AT_ONCE):
            (x, n), (y, m), fine = self._tokens(words.slice(first, AT_ONCE).to_pylist())
            a_ids.append(x), a_counts.append(n), b_ids.append(y), b_counts.append(m), good.append(fine)
        a, b, n_a, n_b, good = (np.concatenate(x) for x in (a_ids, b_ids, a_counts, b_counts, good))
        give_back()
        if not good.all():
            a_ends, b_ends = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
            more_a, more_b = [], []
            for k, d in enumerate(docs):
                if good[d].all():
                    continue
                whole_a, whole_b = (np.concatenate([side[ends[i] : ends[i + 1]] for i in d.tolist()]) for side, ends in ((a, a_ends), (b, b_ends)))
                raw = f" {' '.join(words.take(pa.array(d)).to_pylist())}".encode()
                docs[k] = np.zeros(0, np.int32)
                if self.two.joined(whole_a.tolist(), whole_b.tolist()) == (raw, raw):  # equal as a whole only: a word of its own
                    docs[k] = np.array([len(n_a) + len(more_a)], np.int32)
                    more_a.append(whole_a), more_b.append(whole_b)
            a, b = np.concatenate([a, *more_a]), np.concatenate([b, *more_b])
            n_a, n_b = np.concatenate([n_a, _counts(more_a)]), np.concatenate([n_b, _counts(more_b)])
        del words
        times = np.zeros(len(n_a), np.int64)
        for first in range(0, len(docs), TEXTS):
            times += np.bincount(np.concatenate(docs[first : first + TEXTS]), minlength=len(n_a))
        used = times > 0
        renumbered = (np.cumsum(used) - 1).astype(np.int32)
        a, b = a[np.repeat(used, n_a)], b[np.repeat(used, n_b)]
        n_a, n_b, times = n_a[used], n_b[used], times[used]
        a_ends, b_ends = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
        a_of, b_of = self.two.a_sizes, self.two.b_sizes
        for chunk, first in enumerate(range(0, len(times), CHUNK)):
            last = min(first + CHUNK, len(times))
            x, y = a[a_ends[first] : a_ends[last]], b[b_ends[first] : b_ends[last]]
            yield self._batch(chunk, None, None, [x, np.cumsum(a_of[x]), np.repeat(np.arange(last - first), n_a[first:last]), y, np.cumsum(b_of[y]), times[first:last]])
        ends = np.cumsum([len(d) for d in docs])
        part = first = 0
        while first < len(docs):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + OCCURRENCES, side="right")))
            part -= 1
            own = [renumbered[d] for d in docs[first:last]]
            counts = [[int(n[d].sum()) for d in own] for n in (n_a, n_b)]
            yield self._batch(part, [self.doc_ids[first:last], *counts], own, None)
            first = last

    def _batch(self, chunk: int, about: list | None, words: list | None, lists: list | None) -> pa.RecordBatch:
        about = [pa.array([x], pa.list_(pa.int64())) for x in about or [None] * 3]
        return pa.RecordBatch.from_arrays([pa.array([self.number], pa.int64()), pa.array([chunk], pa.int32()), *about, _nested([words]), _nested([lists])], schema=_ENCODED)


_NONE = np.zeros(0, np.int32)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of so many values."""
    ends = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[np.concatenate([[0], np.cumsum(counts)])]
    return np.diff(ends)


def _taken(values: np.ndarray, counts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of so many values, picked by number, end to end, and how many values each has."""
    starts, sizes = (np.cumsum(counts) - counts)[at], counts[at]
    return values[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())], sizes


def _give_back(ids: np.ndarray, counts: np.ndarray, sizes_of: np.ndarray, letters: np.ndarray, sizes: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Of which words (their sizes, and their bytes end to end) the tokens' bytes are the word's."""
    fits = _sums(sizes_of[ids], counts) == sizes
    at = np.flatnonzero(fits)
    own, want = _taken(letters, sizes_of, _taken(ids, counts, at)[0])[0], _taken(whole, sizes, at)[0]
    fits[at] = _sums(own == want, sizes[at]) == sizes[at]
    return fits


def _flat(lists: list) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int32, sum(map(len, lists)))


def _counts(lists: list) -> np.ndarray:
    return np.fromiter(map(len, lists), np.int32, len(lists))


def encoded(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK) -> DataFrame:
    """Blocks of documents as lists of word numbers, and their dictionaries' tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = two_tokenizers(a_path, b_path)
        block = _Block(two, TaskContext.get().partitionId() << 33)
        with no_cycles():
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for x, y, texts in pieces(batch.column(1), min(block_bytes, 1_000_000)):
                    block.add(ids[x:y], texts)
                    if block.full(block_bytes):
                        yield from block.rows()
                        block = _Block(two, block.number + 1)
            if block.doc_ids:
                yield from block.rows()

    return id_text(docs).mapInArrow(tidy(run), ENCODED)


_OF_CHUNK = ["block", "chunk"]
#: False: rows that were dealt out by some of a join's keys on both sides stay where they are.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
#: False: lists are collected group by group from sorted rows.
BY_HASH = "spark.sql.execution.useObjectHashAggregateExec"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
SCAN_ROWS = "spark.sql.parquet.columnarReaderBatchSize"


def cuts(chunks: DataFrame) -> DataFrame:
    """block, chunk, a_pos, b_pos: the tokens that end together."""
    ends = lambda side, k: chunks.select(*_OF_CHUNK, F.posexplode(F.col("lists")[k]).alias(f"{side}_pos", "end"))
    return ends("a", 1).join(ends("b", 4), [*_OF_CHUNK, "end"]).drop("end")


#: A cut as one number: A's token, B's.
_SIDE = 1 << 32
_LINK = pa.struct([(c, pa.int32()) for c in ("word", "a", "b", "n")])
_ALIGNED = pa.schema([("block", pa.int64()), ("chunk", pa.int32()), ("texts", pa.list_(pa.string())), ("n_groups", pa.list_(pa.int32())), ("links", pa.list_(_LINK))])
ALIGNED = "block long, chunk int, texts array<string>, n_groups array<int>, links array<struct<word:int,a:int,b:int,n:int>>"


def _one(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _group_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with their cuts, in order, as their words' texts, numbers of groups, and links."""
    names: dict[str, np.ndarray] = {}

    def named(ids: np.ndarray, end: str) -> np.ndarray:
        """Ids as texts, each with what stands after it."""
        of = names.get(end, _NONE)
        if len(ids) and ids.max() >= len(of):
            of = names[end] = np.array([f"{i}{end}" for i in range(ids.max() + 1)], object)
        return of[ids]

    for batch in batches:
        for k in range(batch.num_rows):
            lists = batch.column(2)[k].values
            a, _, word, b, _, times = (lists[i].values.to_numpy() for i in range(6))
            p, q = np.divmod(batch.column(3)[k].values.to_numpy(), _SIDE)
            of = word[p]
            # A's tokens of a group stand before B's, after both sides' of the groups before
            parts = np.empty(len(a) + len(b), object)
            a_sizes, b_sizes = np.diff(p, prepend=-1), np.diff(q, prepend=-1)
            a_at, b_at = np.arange(len(a)) + np.repeat(q + 1 - b_sizes, a_sizes), np.arange(len(b)) + np.repeat(p + 1, b_sizes)
            parts[a_at], parts[b_at] = named(a, ","), named(b, ",")
            parts[a_at[p]], parts[b_at[q]] = named(a[p], "|"), named(b[q], ";")
            last = np.flatnonzero(np.diff(of, append=-1))
            parts[b_at[q[last]]] = named(b[q[last]], "\n")
            texts = "".join(parts.tolist()).split("\n")[:-1]
            links = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (of, a[p], b[q], times[of])], fields=list(_LINK))
            n_groups = pa.array(np.bincount(of, minlength=len(times)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), _one(pa.array(texts, pa.string())), _one(n_groups), _one(links)], schema=_ALIGNED)


def _aligned(chunks: DataFrame) -> DataFrame:
    """block, chunk; texts and n_groups of its words, in order; links (word, a, b, n)."""
    found = cuts(chunks).groupBy(*_OF_CHUNK).agg(F.sort_array(F.collect_list(F.col("a_pos") * F.lit(_SIDE) + F.col("b_pos"))).alias("cuts"))
    return chunks.select(*_OF_CHUNK, "lists").join(found, _OF_CHUNK).mapInArrow(tidy(_group_texts), ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, n: how many links of the corpus hold the two ids linked."""
    return aligned.select(F.inline("links")).groupBy("a", "b").agg(F.sum(F.col("n").cast("long")).alias("n"))


_SCORES = "array<struct<word:int,n_best:long,count_sum:long>>"


def _per_chunk(scored: DataFrame) -> DataFrame:
    """block, chunk, scores: (word, n_best, count_sum) of words."""
    sums = scored.groupBy(*_OF_CHUNK, "word").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return sums.groupBy(*_OF_CHUNK).agg(F.collect_list(F.struct("word", "n_best", "count_sum")).cast(_SCORES).alias("scores"))


def _scores(aligned: DataFrame, pairs: DataFrame, heavy: int) -> DataFrame:
    """block, chunk, texts, n_groups of words; scores, more: what links of frequent pairs and of others add to them."""
    most = pairs.groupBy("b").agg(F.max("n").alias("most"))
    rated = pairs.join(F.broadcast(most), "b").select("a", "b", F.col("n").alias("count_sum"), (F.col("n") == F.col("most")).cast("int").alias("n_best"))  # most: as many rows as B has tokens
    total, many = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    bound = -(-total // heavy) if many > heavy else 0
    links = aligned.select(*_OF_CHUNK, F.inline("links")).drop("n")
    joined = links.join(F.broadcast(rated.where(F.col("count_sum") >= bound)), ["a", "b"], "left")
    words = aligned.select(*_OF_CHUNK, "texts", "n_groups").join(_per_chunk(joined.where("count_sum IS NOT NULL")), _OF_CHUNK, "left")
    if not bound:
        return words.withColumn("more", F.lit(None).cast(_SCORES))
    light = joined.where("count_sum IS NULL").drop("n_best", "count_sum").join(rated.where(F.col("count_sum") < bound).hint("merge"), ["a", "b"])
    return words.join(_per_chunk(light).withColumnRenamed("scores", "more"), _OF_CHUNK, "left")


_DONE = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", pa.string())])
DONE = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _rows(table: pa.Table, name: str) -> list[pa.Array]:
    """A column's lists."""
    return [piece[i].values for piece in table.column(name).chunks for i in range(len(piece))]


def _documents(docs: pa.Table, dictionary: pa.Table) -> pa.Table:
    """A block's documents (doc_ids, n_a, n_b, words) with its dictionary (texts, n_groups, scores, more)."""
    order = np.argsort(dictionary.column("chunk").to_numpy()).tolist()
    n_groups, texts, scores, more = ([x[k] for k in order] for x in (_rows(dictionary, c) for c in ("n_groups", "texts", "scores", "more")))
    words = np.concatenate([_NONE, *[x.to_numpy() for x in n_groups]])
    added = np.zeros((2, len(words)), np.int64)
    for first, *found in zip(np.cumsum([0, *map(len, n_groups)]).tolist(), scores, more):
        for x in found:
            if x is not None:
                added[:, first + x.field(0).to_numpy()] += [x.field(1).to_numpy(), x.field(2).to_numpy()]
    named = pa.concat_arrays([pa.array([], pa.large_string()), *[x.cast(pa.large_string()) for x in texts]])
    batches = []
    give_back()
    for *about, lists in zip(*(_rows(docs, c) for c in ("doc_ids", "n_a", "n_b", "words")), strict=True):
        flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
        groups, n_best, count_sum = (_sums(x[flat], sizes) for x in (words, *added))
        joined = pc.binary_join(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), named.take(pa.array(flat))), pa.scalar(";", pa.large_string()))
        _, bounds, letters = joined.buffers()
        bounds, letters = np.frombuffer(bounds, np.int64)[: len(sizes) + 1].tolist(), memoryview(letters or b"")
        digests = [hashlib.sha256(letters[x:y]).hexdigest() if n else "" for x, y, n in zip(bounds, bounds[1:], sizes.tolist(), strict=False)]
        batches.append(record_batch(_DONE, [*about, groups, groups, n_best, count_sum, digests]))
    give_back()
    return pa.Table.from_batches(batches, _DONE)


def align(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    spark = docs.sparkSession
    with set_to(spark, ALL_KEYS, "false"):
        # a block is written once and never dealt out again: all steps over its chunks, words and documents run where its bucket is read
        with set_to(spark, BATCH_ROWS, str(TEXTS)):
            rows = bucketed(encoded(docs, a_path, b_path, block_bytes), "block")
        with set_to(spark, BY_HASH, "false"), set_to(spark, BATCH_ROWS, str(ROWS)), set_to(spark, SCAN_ROWS, str(SCANNED)):
            aligned = bucketed(_aligned(rows.where("chunk >= 0").select(*_OF_CHUNK, "lists")), "block")
            pairs = stored(pair_counts(aligned))
            blocks = rows.where("chunk < 0").select("block", "doc_ids", "n_a", "n_b", "words")
            return stored(blocks.groupBy("block").cogroup(_scores(aligned, pairs, heavy).groupBy("block")).applyInArrow(_documents, DONE))
