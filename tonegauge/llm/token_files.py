"""Token files of directly addressable codes.

A token id is cut into bytes, lowest first. Level 0 has the first byte of every token, level 1 the second byte of
those tokens that have one, and so on; a bitmap a level says which tokens go on, and a rank directory holds the
count of set bits before every 512. So the bytes of token i are found by one look into each level: level 0 at i,
level 1 at the number of tokens before i that go on, and so on. No block is decoded on the way.

A file holds the documents of one partition:

    segments, each of ``SEGMENT`` tokens (the last one: fewer), each as, for every level,
        bytes | bitmap (8 bits a byte, lowest first) | directory (unsigned 32-bit, one for every 512 bits, and one more)
    segment table: byte offset of each segment, and of the end (unsigned 64-bit)
    document table: doc_id, 0 or 1 for a null doc_id, first token in the file (three arrays of signed 64-bit, the last with one more)
    footer: 8 bytes ``TOKENDA1``, and tokens a segment, number of tokens, documents, segments, byte offset of the segment
        table (unsigned 64-bit)

All numbers are little-endian. A level's sizes follow from the one before (as many tokens as it has bits set), so
they aren't stored. Segments end where they end: documents run on over them, so memory is bounded by a segment and
a document.

``TokenFiles`` is a data source of Spark. Writers give files names of their own attempt; the commit writes
``manifest.json`` with the files in order of partition and the tokens before each, and readers go by it alone, so
files of lost or repeated attempts are never read. Paths are any that pyarrow's file systems know (file, hdfs, s3).

Defined results: a null doc_id stays null and comes first; rows that repeat a doc_id are documents of their own,
in the order of their ids' hash; null ids are no tokens; an empty table gives files without documents; further
columns are ignored; ids are of 32 bits.
"""

from __future__ import annotations

import json
import struct
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ._common import id_text, importable, no_cycles, pieces, record_batch, tidy
from .packing import packed_ids, word_tokenizer

#: Tokens of a segment; bits for each entry of a rank directory.
SEGMENT, RANKED = 1 << 20, 512
_MAGIC = b"TOKENDA1"
_FOOTER = struct.Struct("<8s5Q")
#: Bytes of tokens that a reader hands on at a time.
_BATCH = 1 << 22
READ = "doc_id long, start long, n_tokens long, ids binary"
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
MANIFEST = "manifest.json"


# -- codes


def _directory(bits: np.ndarray) -> np.ndarray:
    """Set bits before each RANKED of them, and all."""
    sums = np.add.reduceat(bits, np.arange(0, len(bits), RANKED), dtype=np.uint32) if len(bits) else np.zeros(0, np.uint32)
    return np.concatenate([[0], np.cumsum(sums)]).astype("<u4")


def encode_segment(ids: np.ndarray) -> bytes:
    """Levels of one segment's ids."""
    out, rest = [], ids.astype(np.uint32)
    while len(rest):
        more = rest > 0xFF
        out += [(rest & 0xFF).astype(np.uint8).tobytes(), np.packbits(more, bitorder="little").tobytes(), _directory(more).tobytes()]
        rest = rest[more] >> 8
    return b"".join(out)


#: Reads (offset, size) of some bytes.
Fetch = Callable[[int, int], bytes]


def _level_sizes(n: int) -> tuple[int, int]:
    """Bytes of a level's bitmap and directory."""
    return -(-n // 8), 4 * (-(-n // RANKED) + 1)


def decode_range(fetch: Fetch, at: int, n: int, start: int, stop: int) -> np.ndarray:
    """Ids of tokens [start, stop) of the segment at this offset, by the bytes of these tokens alone: of each level
    a slice of bytes, one of bits from the last directory entry on, and two entries of the directory."""
    out = np.zeros(stop - start, np.uint32)
    going, shift = np.arange(stop - start), 0
    while start < stop:
        bitmap, directory = _level_sizes(n)
        out[going] |= np.frombuffer(fetch(at + start, stop - start), np.uint8).astype(np.uint32) << np.uint32(shift)
        first = start // RANKED * RANKED
        bits = np.unpackbits(np.frombuffer(fetch(at + n + first // 8, -(-stop // 8) - first // 8), np.uint8), bitorder="little")[: stop - first].astype(bool)
        base = int.from_bytes(fetch(at + n + bitmap + 4 * (start // RANKED), 4), "little")
        total = int.from_bytes(fetch(at + n + bitmap + directory - 4, 4), "little")
        before = base + int(np.count_nonzero(bits[: start - first]))
        going = going[bits[start - first :]]
        at, n, start, stop, shift = at + n + bitmap + directory, total, before, before + len(going), shift + 8
    return out


def token_at(fetch: Fetch, at: int, n: int, i: int) -> int:
    """One token of the segment at this offset."""
    return int(decode_range(fetch, at, n, i, i + 1)[0])


# -- files


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:") or "://" not in path:
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


class FileWriter:
    """Writes one file, segment by segment."""

    def __init__(self, out: pa.NativeFile, segment: int = SEGMENT):
        self.out, self.segment = out, segment
        self.held, self.n_held, self.n_tokens = [], 0, 0
        self.ids, self.nulls, self.starts, self.offsets, self.at = [], [], [0], [0], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.n_tokens += len(ids)
        self.starts.append(self.n_tokens)
        while self.n_held + len(ids) >= self.segment:
            self.held.append(ids[: self.segment - self.n_held])
            ids = ids[self.segment - self.n_held :]
            self._flush()
        if len(ids):
            self.held.append(ids)
            self.n_held += len(ids)

    def _flush(self) -> None:
        data = encode_segment(np.concatenate(self.held))
        self.out.write(data)
        self.at += len(data)
        self.offsets.append(self.at)
        self.held, self.n_held = [], 0

    def close(self) -> None:
        if self.n_held:
            self._flush()
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        for x in (self.ids, self.nulls, self.starts):
            self.out.write(np.array(x, "<i8").tobytes())
        self.out.write(_FOOTER.pack(_MAGIC, self.segment, self.n_tokens, len(self.ids), len(self.offsets) - 1, self.at))


class FileReader:
    """Reads one file; what it holds is the two tables."""

    def __init__(self, source: pa.NativeFile):
        self.source, size = source, source.size()
        magic, self.segment, self.n_tokens, self.n_docs, n, at = _FOOTER.unpack(source.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != _MAGIC:
            raise ValueError("not a token file")
        tables = source.read_at(size - _FOOTER.size - at, at)
        self.offsets = np.frombuffer(tables, "<u8", n + 1)
        self.ids, self.nulls, self.starts = (np.frombuffer(tables, "<i8", self.n_docs + more, 8 * (n + 1 + i * self.n_docs)) for i, more in ((0, 0), (1, 0), (2, 1)))

    def fetch(self, offset: int, size: int) -> bytes:
        return self.source.read_at(size, offset)

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids of the file's tokens [start, stop)."""
        out = []
        while start < stop:
            k, first = start // self.segment, start % self.segment
            n = min(self.segment, self.n_tokens - k * self.segment)
            last = min(n, first + stop - start)
            out.append(decode_range(self.fetch, int(self.offsets[k]), n, first, last))
            start += last - first
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def documents(self, base: int) -> Iterator[pa.RecordBatch]:
        """READ rows; base: tokens in the files before."""
        a = 0
        while a < self.n_docs:
            b = max(a + 1, int(np.searchsorted(self.starts, self.starts[a] + _BATCH // 4, side="right")) - 1)
            ids = self.tokens(int(self.starts[a]), int(self.starts[b])).astype("<u4").tobytes()
            bounds = self.starts[a : b + 1] - self.starts[a]
            column = [ids[4 * x : 4 * y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield record_batch(_READ, [pa.array(self.ids[a:b], mask=self.nulls[a:b].astype(bool)), self.starts[a:b] + base, np.diff(bounds), column])
            a = b


# -- the data source


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str
    n_docs: int
    n_tokens: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path = path
        fs, at = _system(path)
        if not overwrite and fs.get_file_info(f"{at}/{MANIFEST}").type != pafs.FileType.NotFound:
            raise ValueError(f"{path} holds token files already")
        fs.create_dir(at, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.tok"
        fs, at = _system(self.path)
        with fs.open_output_stream(f"{at}/{name}") as out:
            writer = FileWriter(out)
            for batch in iterator:
                for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    buffer = ids.as_buffer()
                    writer.add(doc_id, np.frombuffer(buffer, "<u4") if buffer is not None else np.zeros(0, "<u4"))
            writer.close()
        return Written(task.partitionId(), name, len(writer.ids), writer.n_tokens)

    def commit(self, messages: list[Written | None]) -> None:
        files, start = [], 0
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
            files.append({"name": m.name, "start": start, "docs": m.n_docs, "tokens": m.n_tokens})
            start += m.n_tokens
        fs, at = _system(self.path)
        with fs.open_output_stream(f"{at}/{MANIFEST}") as out:
            out.write(json.dumps({"tokens": start, "files": files}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = _system(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{at}/{m.name}")


@dataclass
class Part(InputPartition):
    name: str
    start: int


def read_manifest(path: str) -> dict:
    fs, at = _system(path)
    with fs.open_input_stream(f"{at}/{MANIFEST}") as f:
        return json.loads(f.read())


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        return [Part(f["name"], f["start"]) for f in read_manifest(self.path)["files"] if f["docs"]]

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file has a document
            return
        fs, at = _system(self.path)
        with fs.open_input_file(f"{at}/{partition.name}") as source:
            yield from FileReader(source).documents(partition.start)


class TokenFiles(DataSource):
    """``spark.read.format("token_files").load(path)``: doc_id, start (tokens before), n_tokens, ids (little-endian
    unsigned 32-bit); written from doc_id, ids in the order of the partitions and of the rows in them."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


def registered(spark: SparkSession) -> SparkSession:
    importable(spark)
    spark.dataSource.register(TokenFiles)
    return spark


def write(encoded: DataFrame, path: str) -> None:
    """Write doc_id, ids as token files, in the order in which they stand."""
    registered(encoded.sparkSession)
    encoded.select("doc_id", "ids").write.format("token_files").mode("append").save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return registered(spark).read.format("token_files").load(path)


_TOKENS = pa.schema([("position", pa.int64()), ("token", pa.int64())])


def tokens_at(positions: DataFrame, path: str) -> DataFrame:
    """position, token of positions in the whole corpus (column position), by the files' directories alone.

    Positions are dealt out by file, so a task opens its files once; null positions and those outside have a null token.
    """
    spark = registered(positions.sparkSession)
    manifest = read_manifest(path)
    files = [f for f in manifest["files"] if f["tokens"]]
    starts = [f["start"] for f in files]
    total = manifest["tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _system(path)
        source = reader = None
        opened = -1
        try:
            for batch in batches:
                found = []
                for p in batch.column(0).to_pylist():
                    if p is None or not 0 <= p < total:
                        found.append(None)
                        continue
                    k = bisect_right(starts, p) - 1
                    if k != opened:
                        if source is not None:
                            source.close()
                        source, opened = fs.open_input_file(f"{at}/{files[k]['name']}"), k
                        reader = FileReader(source)
                    found.append(int(reader.tokens(p - starts[k], p - starts[k] + 1)[0]))
                yield record_batch(_TOKENS, [batch.column(0), found])
        finally:
            if source is not None:
                source.close()

    own = positions.select(F.col("position").cast("long").alias("position"))
    # neighbours in the corpus stand in one file, so sorted ranges open few files each
    return own.repartitionByRange("position").sortWithinPartitions("position").mapInArrow(run, "position long, token long")


# -- the corpus in order


_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text over partitions in ascending doc_id; a doc_id of many rows is spread over several."""
    d = id_text(docs).withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    return d.repartitionByRange("doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "row").select("doc_id", "text")


def encode(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """doc_id, ids (with the end id) of whole texts, row by row in the order given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = word_tokenizer(tokenizer_path), packed_ids([end_id])
        with no_cycles():
            for batch in batches:
                for a, b, texts in pieces(batch.column(1)):
                    yield record_batch(_ENCODED, [batch.column(0).slice(a, b - a), [ids + end for ids in tokenizer.encode_packed(texts)]])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, ids binary")


def write_corpus(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 1) -> None:
    """Token files of all documents in ascending doc_id. One shuffle, of the texts."""
    write(encode(in_order(docs), tokenizer_path, end_id), path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files."""
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
